"""I-Match fingerprints: terms of an inverse-document-frequency band, sorted, hashed over randomised lexicon subsets.

The lexicon holds the terms that between one in 2^LOW and one in 2^HIGH documents have (all documents are counted). The mean
document has few terms, so at most its number of distinct terms times 2^HIGH are in the band, however large the corpus; the
lexicon is broadcast as sorted 64-bit hashes. Above LEXICON entries it is halved by hash until it fits: a random subset, as
all below are.

A subset of level l keeps a term with chance 2^-l; the subsets of one number are nested. A document with D terms of the
lexicon is hashed over SUBSETS subsets of each of the levels floor(log2 D), + 1 and + 2, so that a subset keeps about one
of its terms whatever its length. The fingerprint is the level and one 16-bit hash a subset (`....` where it keeps none).
The likeness of two fingerprints is the share of equal hashes among the subsets that keep a term of either, over the levels
that both have: near the Jaccard similarity of their terms.

Defined results: a document without terms in the band uses all its terms, one without terms its text; null and empty texts
have an empty fingerprint; equal fingerprints have likeness 1, an empty and another one 0. The next document is the next row
by doc_id (null first), then text; rows that repeat an id follow each other; after the last comes the first; of a single row
the next is itself; an empty table gives no row. Very long texts are taken whole; columns besides id and text are dropped.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, keyed, table, terms

#: The band: between one in 2^LOW and one in 2^HIGH documents have the term.
LOW, HIGH = 4, 12
#: Entries of the broadcast lexicon (16 MB); subsets and levels of a fingerprint.
LEXICON, SUBSETS, LEVELS = 2_000_000, 24, 3
#: Ranges of ids for each shuffle partition, so that partitions that are dealt ranges by hash are even.
RANGES = 8
#: Distinct terms that a task counts before it sends its counts on.
HELD = 500_000
_ONE, _TWO = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"subset %d" % j) for j in range(SUBSETS)], np.uint64)[:, None]


def _hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def document_counts(docs: DataFrame) -> DataFrame:
    """term (64-bit hash), n: the documents with each term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def sent() -> pd.DataFrame:
            return pd.DataFrame({"term": _hashed(held.keys()).view(np.int64), "n": np.fromiter(held.values(), np.int64, len(held))})

        for b in batches:
            for t in b["text"]:
                held.update(set(terms(t)))
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    return docs.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Sorted hashes of the band's terms."""
    rows = docs.count()
    band = document_counts(docs).filter((F.col("n") * (1 << high) >= rows) & (F.col("n") * (1 << low) <= rows))
    band = table(band.select("term"), "imatch-band")
    bits = max(0, (-(-band.count() // LEXICON) - 1).bit_length())
    kept = band.filter(F.col("term").bitwiseAND(F.lit((1 << bits) - 1)) == 0)
    return np.sort(kept.toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))  # bounded by LEXICON, about


def fingerprint(text: str, known: np.ndarray) -> str:
    words = set(terms(text))
    if not words and not text:
        return ""
    own = np.sort(_hashed(words or [text.encode("utf-8", "surrogatepass")]))
    if len(known):
        banded = own[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]
        own = banded if len(banded) else own
    level = len(own).bit_length() - 1
    mixed = (own ^ _SEEDS) * _ONE
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _TWO
    mixed ^= mixed >> np.uint64(29)
    prints = []
    for l in range(level, level + LEVELS):
        keeps = mixed < np.uint64(1 << (64 - l)) if l else np.ones(mixed.shape, bool)
        prints += [f"{xxhash.xxh3_64_intdigest(own[k].tobytes()) & 0xFFFF:04x}" if k.any() else "...." for k in keeps]
    return f"{level:02d}:" + "".join(prints)


def likeness(a: str, b: str) -> float:
    if a == b or not a or not b:
        return float(a == b)
    la, lb = int(a[:2]), int(b[:2])
    first, last = max(la, lb), min(la, lb) + LEVELS
    width = 4 * SUBSETS
    same = either = 0
    for l in range(first, last):
        x, y = (p[3 + (l - k) * width : 3 + (l - k + 1) * width] for p, k in ((a, la), (b, lb)))
        for i in range(0, width, 4):
            u, v = x[i : i + 4], y[i : i + 4]
            some = u != "...." or v != "...."
            either += some
            same += some and u == v
    return same / either if either else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    docs = keyed(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [fingerprint(t, known.value) for t in b["text"]]})

    return docs.mapInPandas(run, "doc_id long, fingerprint string").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def in_order(docs: DataFrame) -> DataFrame:
    """Rows part, guest, doc_id, text, in ascending order within each part: ranges of doc_id, with a guest at the end of each.

    The guest is the first row of the next range (of the first, in the last), so that each row's next row is in its part.
    Ranges are cut at quantiles of the ids alone; a text is shuffled once, and again only where it is a guest.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = np.unique(np.array(cuts or [0], np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right"), dtype="int32")

    firsts = docs.groupBy(part("doc_id").alias("part")).agg(F.min("doc_id").alias("first")).orderBy("part").collect()  # one a part
    hosts = {r["first"]: before["part"] for r, before in zip(firsts, [firsts[-1], *firsts[:-1]] if firsts else [], strict=True)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(np.int64), "right").tolist()
        return pd.Series([[p, hosts[d]] if d in hosts else [p] for p, d in zip(own, ids.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "part"))
    return dealt.repartition("part").sortWithinPartitions("part", "guest", "doc_id", "text").select("part", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text whose last half is replaced by as many first characters of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document: doc_id, n_chars, edited_sha256, the fingerprints of its
    text and its edited text, near_edited and near_next, the likeness of its fingerprint to the edited text's and the next's.
    """
    docs = keyed(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None  # part; the row that waits for its next one
        for b in batches:
            out = []
            for part, guest, d, t in zip(b["part"].tolist(), b["guest"].tolist(), b["doc_id"].tolist(), b["text"], strict=True):
                if part != at:
                    at, held = part, None
                elif guest and held is None:
                    continue  # a guest's repeated rows
                own = fingerprint(t, known.value)
                if held is not None:
                    changed = edited(held[1], t)
                    other = fingerprint(changed, known.value)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), digest, held[2], other, likeness(held[2], other), likeness(held[2], own)))
                held = None if guest else (d, t, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = in_order(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
