"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

The ordinary dictionary is trained on windows of ordinary texts. The toxic one is trained on the words and word beginnings
of toxic texts that recur there `lift` times as often as in ordinary ones. (Trained on whole toxic windows it is no use: they
are ordinary words but for one or two; the README has the figures.) A window is compressed behind the ordinary dictionary
and behind the ordinary with the toxic one, so that its two lengths differ by what only toxic text explains. A text's windows
give the largest differences, their means and the share of windows over thresholds; logistic regression, fitted on labelled
texts that the dictionaries haven't seen, calibrates them to a probability. `lift` is chosen among LIFTS on such texts too.

Bounds of the sample: at most `sample` labelled rows of each class, of at most `max_chars` characters, by a hash of the id;
WINDOWS windows of them train the ordinary dictionary, by a hash of the window; ORDINARY and TOXIC are the dictionaries'
bytes. Defined results: null, empty and wordless texts have no window and get the score of zero differences; without labels
of both classes every score is 0; repeated rows are scored singly; a document with several label rows counts once per row in
training only; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded

WORD = re.compile(r"\w+")
WINDOW, LEVEL, LIFTS = 8, 9, (5.0, 10.0, 20.0, 40.0)
WINDOWS, ORDINARY, TOXIC = 50_000, 8192, 4096


def windows(text: str | None) -> list[bytes]:
    w = WORD.findall((text or "").lower())
    return [(" " + " ".join(w[i : i + WINDOW]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(w), WINDOW)]


def units(text: str) -> set[str]:
    """Whole words and word beginnings of 4 to 6 characters."""
    words = set(WORD.findall(text.lower()))
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples, which are repeated until they are enough to train on."""
    while samples:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            samples = samples * 2
    return b""


@lru_cache(2 * len(LIFTS) + 2)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=64, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def features(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    a, b = compressor(ordinary).compress, compressor(toxic).compress
    d = np.sort(np.array([len(a(w)) - len(b(w)) for w in windows(text)] or [0.0]))[::-1]
    return [d[0], d[:3].mean(), d[:10].mean(), d.mean(), (d >= 2).mean(), (d >= 4).mean(), np.log1p((d >= 3).sum()), np.log1p((d >= 5).sum()), np.log1p(len(d))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def area(x: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve of x for the labels y."""
    rank = pd.Series(x).rank().to_numpy()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def marks(toxic: list[str], ordinary: list[str]) -> dict[str, tuple[float, int]]:
    """How far more frequent each unit is in toxic texts than in ordinary ones, and in how many of them it occurs."""
    in_toxic, in_ordinary = Counter(), Counter()
    for many, count in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in many:
            count.update(units(t))
    base = max(1.0, 0.001 * len(ordinary)) / len(ordinary)
    often = {u: c for u, c in in_toxic.items() if c >= max(2, 0.02 * len(toxic))}
    return {u: ((c / len(toxic)) / (in_ordinary[u] / len(ordinary) + base), c) for u, c in often.items()}


def fit(rows: list[tuple[str, int]], weight: tuple[float, float] = (1.0, 1.0)) -> dict | None:
    """rows: (text, label); weight: rows of each class that one of the sample stands for.

    Even rows make the dictionaries, odd ones choose `lift` and calibrate.
    """
    toxic, ordinary = [t or "" for t, y in rows if y], [t or "" for t, y in rows if not y]
    if not toxic or not ordinary:
        return None
    half = lambda a: (a[::2], a[1::2] or a)
    (toxic, toxic2), (ordinary, ordinary2) = half(toxic), half(ordinary)
    found = marks(toxic, ordinary)
    drawn = sorted((w for t in ordinary for w in windows(t)), key=zlib.crc32)[:WINDOWS]
    o = dictionary(drawn, ORDINARY)
    both = toxic2 + ordinary2
    y = np.r_[np.ones(len(toxic2)), np.zeros(len(ordinary2))]
    best = (-1.0, b"", None)
    for lift in LIFTS:
        chosen = sorted((u for u in found if found[u][0] >= lift), key=lambda u: (found[u][0], u))
        # the marks themselves at the end, where matches cost least, as far as the dictionary's size goes
        t = dictionary([u.encode("utf-8", "surrogatepass") for u in chosen for _ in range(found[u][1])], TOXIC)
        t += "".join(chosen).encode("utf-8", "surrogatepass")[-TOXIC:]
        x = np.array([features(s, o, o + t) for s in both])
        best = max(best, (area(x[:, 1], y), t, x), key=lambda z: z[0])
    _, t, x = best
    mean, sd = x.mean(0), x.std(0) + 1e-9
    w = logistic(np.c_[(x - mean) / sd, np.ones(len(x))], y)
    w[-1] += np.log(weight[1] / weight[0])
    return {"ordinary": o, "toxic": o + t, "mean": mean, "sd": sd, "w": w}


def score_texts(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    if not texts:
        return np.zeros(0)
    x = (np.array([features(t, model["ordinary"], model["toxic"]) for t in texts]) - model["mean"]) / model["sd"]
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model["w"], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 3000, max_chars: int = 8000) -> DataFrame:
    """doc_id and score of every document; learns from labelled rows where `train` holds."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & train)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | ((F.col("toxic") == y) & (draw < min(1.0, sample / n)))
    ids = known.filter(chosen)  # some 2 * sample documents, of any number of label rows
    rows = docs.select("doc_id", "text").join(bounded(ids, ids.count()), "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = rows.orderBy("doc_id", "toxic").limit(4 * sample)
    share = tuple(max(1.0, counts.get(y, 0) / sample) for y in (0, 1))
    held = spark.sparkContext.broadcast(fit([(r["text"], r["toxic"]) for r in rows.collect()], share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score_texts(held.value, b["text"].tolist())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
