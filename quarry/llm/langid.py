"""Language ID: blended-spectrum n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its letter n-grams, n = 1 to 4 (lower case, everything else a blank), hashed to 2^16 bins. The kernel
of two texts is the size of the common set over the geometric mean of the sizes. Landmarks are some training texts of each
language; ridge regression works on the kernels with them, so that scoring is a product of a 0/1 matrix of a batch of
texts with the landmarks' matrix, then with the weights. Landmarks are drawn by a hash of the text; with many languages each
has fewer, so that the matrix stays below `MODEL_MB`.

Fitted on some `per_lang` labelled texts a language, `max_rows` in all, of which the first `max_chars` characters are taken
(the sample's bounds); every language takes part. Defined results: `und` with score 0 for null, empty or letterless texts; null with score 0 for texts
with letters when nothing was learned; ties go to the first language by name; rows without a language are not learned from;
repeated rows are answered singly; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, table

BINS, SIZES, BATCH = 1 << 16, 4, 128
#: The landmarks' matrix, 4 bytes a cell, is broadcast; its size is checked against this bound.
MODEL_MB = 256


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Sorted bins of the n-grams of the text's letters; none if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[c]
    if not alpha.any():
        return np.zeros(0, np.int64)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    c = np.concatenate([[np.uint32(0)], np.where(alpha, c, 0)[keep].astype(np.uint32), [np.uint32(0)]]).astype(np.uint32)
    flags, h = np.zeros(BINS, bool), np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(SIZES):
            if n >= len(c):
                break
            h = h[: len(c) - n] * np.uint32(0x01000193) + c[n:] + np.uint32(n + 1)
            x = h * np.uint32(0x9E3779B1)
            flags[x >> np.uint32(16)] = True
    return np.flatnonzero(flags)


def fit(sample: list[tuple[str, str]], landmarks: int = 40, ridge: float = 1e-2) -> dict | None:
    """sample: (lang, text). The model: languages, column of each bin, landmark matrix, weights."""
    rows = [(lang, g) for lang, t in sorted(sample) if len(g := grams(t))]
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    landmarks = max(1, min(landmarks, MODEL_MB * 1_000_000 // (4 * BINS * len(langs))))
    rows.sort(key=lambda r: zlib.crc32(r[1].tobytes()))
    marks = [g for k in langs for g in [g for lang, g in rows if lang == k][:landmarks]]
    used = np.unique(np.concatenate(marks))
    column = np.full(BINS, -1, np.int64)
    column[used] = np.arange(len(used))
    m = np.zeros((len(used), len(marks)), np.float32)
    for j, g in enumerate(marks):
        m[column[g], j] = 1 / np.sqrt(len(g))
    model = {"langs": langs, "column": column, "marks": m, "weights": None}
    k_mm, k_nm = kernels(model, marks).astype(float), kernels(model, [g for _, g in rows]).astype(float)
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in rows])
    share = np.array([1 / sum(lang == x for lang, _ in rows) for x in langs])
    weight = np.array([share[langs.index(lang)] for lang, _ in rows])[:, None]
    left = k_nm.T @ (weight * k_nm) + ridge * k_mm / len(marks) + 1e-6 * np.eye(len(marks))
    model["weights"] = np.linalg.solve(left, k_nm.T @ (weight * y)).astype(np.float32)
    return model


def kernels(model: dict, sets: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(sets), model["marks"].shape[0]), np.float32)
    for i, g in enumerate(sets):
        c = model["column"][g]
        x[i, c[c >= 0]] = 1 / np.sqrt(max(1, len(g)))
    return x @ model["marks"]


def training_sample(docs: DataFrame, train: Column, per_lang: int, max_chars: int, max_rows: int = 20_000) -> list[tuple[str, str]]:
    """Some per_lang texts of each language (fewer where that makes over max_rows), by a hash of the id; of long texts the beginning."""
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = table(counts, "langid-counts")
    each = min(per_lang, max(1, max_rows // max(1, langs := counts.count())))
    drawn = known.withColumn("draw", draw).join(bounded(counts, langs), "lang").filter(F.col("draw") < each / F.col("n"))
    return [(r["lang"], r["text"]) for r in drawn.select("lang", F.substring("text", 1, max_chars).alias("text")).collect()]


def identify(docs: DataFrame, train: Column, per_lang: int = 200, max_chars: int = 6000) -> DataFrame:
    """docs(doc_id, text, lang, ...) with lang_pred and score added; learns from rows where `train` holds."""
    model = fit(training_sample(docs, train, per_lang, max_chars))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            lang, best = np.full(len(b), "und", object), np.zeros(len(b))
            if m is None:
                lang = np.array([None if len(grams(t)) else "und" for t in b["text"]], object)
            for i in range(0, len(b) if m else 0, BATCH):
                sets = [grams(t) for t in b["text"].iloc[i : i + BATCH]]
                f = kernels(m, sets) @ m["weights"]
                top, ok = f.argmax(1), np.array([len(g) > 0 for g in sets])
                e = np.exp(4 * (f - f.max(1, keepdims=True)))
                lang[i : i + BATCH] = np.where(ok, np.array(m["langs"], object)[top], "und")
                best[i : i + BATCH] = np.where(ok, 1 / e.sum(1), 0)
            yield b.assign(lang_pred=lang, score=best)

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(names).mapInPandas(score, docs.select(names).schema.add("lang_pred", "string").add("score", "double"))
