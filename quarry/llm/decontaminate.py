"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A word is a lower-case run of letters and digits. Fixed masks over a window of 12 words pick nine positions each and
ignore three. Every window of a benchmark item and of a document is hashed, so a stretch of 12 equal words is always
found, and so is one with a single other word among 13 or more; with two other words or more a share of short stretches
meets no mask (the README has the figures). Hits give a document, an item and a diagonal; there the item's words are
compared with the document's one by one, whatever was substituted between hits.

Items of 5 to 11 words are matched whole and word by word: their hash is looked up among all windows of their length.

Defined results: null, empty or short texts have no match; items under 5 words, which ordinary text says by chance, cannot
match; repeated rows are matched singly by id; a document's best item is the one with most equal words, then the smallest
item_id; an empty benchmark has no match; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, table

SPAN, STRIDE, SHORTEST = 12, 1, 5
#: Positions that each mask reads (fixed values).
MASKS = ((0, 1, 2, 4, 5, 6, 8, 9, 11), (0, 1, 3, 4, 6, 7, 9, 10, 11), (0, 2, 3, 5, 6, 7, 8, 10, 11))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(hashes: Column, stride: int) -> Column:
    """Array of the hashes of all masks at every stride-th window: all of the first mask, then of the second, ..."""
    last = F.size(hashes) - SPAN
    at = F.sequence(F.lit(0), last, F.lit(stride))

    def masked(k: int) -> Column:
        return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + o) for o in MASKS[k]]))

    each = [masked(k) for k in range(len(MASKS))]
    return F.when(last >= 0, F.concat(*each)).otherwise(F.array().cast("array<bigint>"))


def _seeded(df: DataFrame, id_col: str, stride: int) -> DataFrame:
    """(id, seed, at) for every window and mask."""
    hashed = df.select(F.col(id_col).cast("long").alias(id_col), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    found = hashed.select(id_col, seeds(F.col("h"), stride).alias("s"))
    # outer: a plain explode infers a filter on the array's size, and the pushed filter hashes every text once for each word
    out = found.select(id_col, (F.size("s") / len(MASKS)).cast("int").alias("k"), F.posexplode_outer("s").alias("p", "seed")).filter(F.col("p").isNotNull())
    return out.select(id_col, "seed", (F.col("p") % F.col("k") * stride).alias("at"))


def _whole(df: DataFrame, id_col: str, n: int, alone: bool) -> DataFrame:
    """(id, seed, at) of the windows of n words, without masks; of texts of n words only, if alone."""
    hashed = df.select(F.col(id_col).cast("long").alias(id_col), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    fits = F.size("h") == n if alone else F.size("h") >= n
    each = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(F.lit(SPAN + n), *[F.get("h", i + j) for j in range(n)]))
    found = hashed.select(id_col, F.when(fits, each).alias("s"))
    return found.select(id_col, F.posexplode_outer("s").alias("at", "seed")).filter(F.col("at").isNotNull()).select(id_col, "seed", "at")


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, item_id, diagonal, equal_words, item_words: verified overlaps of at least `least` equal words, or of whole short items."""
    sizes = benchmark.select(F.size(words(F.col("text"))).alias("n")).filter(F.col("n").between(SHORTEST, SPAN - 1)).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # SPAN - SHORTEST numbers at most
    items = [_seeded(benchmark, "item_id", STRIDE), *(_whole(benchmark, "item_id", n, True) for n in short)]
    index = reduce(DataFrame.union, items).select("seed", "item_id", F.col("at").alias("item_at")).distinct()
    index = table(index, "seeds")
    texts = [_seeded(docs, "doc_id", STRIDE), *(_whole(docs, "doc_id", n, False) for n in short)]
    hits = reduce(DataFrame.union, texts).join(bounded(index, index.count()), "seed")
    diagonals = table(hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count("*").alias("hits")), "diagonals")
    n = diagonals.count()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("at"))  # bounded by the items
    near = d.join(bounded(ids, n), "doc_id").select("doc_id", words(F.col("text")).alias("w"), F.explode("at").alias("x"))
    near = near.select("doc_id", "x.item_id", "x.diagonal", "w")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("iw"))
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    both = near.join(bounded(items, chars, 20_000_000), "item_id")
    same = F.size(F.filter(F.sequence(F.lit(0), F.size("iw") - 1), lambda j: F.get(F.col("w"), j + F.col("diagonal")) == F.get(F.col("iw"), j)))
    out = both.select("doc_id", "item_id", "diagonal", same.alias("equal_words"), F.size("iw").alias("item_words"))
    whole = F.col("item_words").between(SHORTEST, SPAN - 1) & (F.col("equal_words") == F.col("item_words"))
    out = out.filter((F.col("equal_words") >= least) | whole)
    return out.dropDuplicates(["doc_id", "item_id", "diagonal"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 12) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, item_id (the best), equal_words, coverage."""
    best = F.max(F.struct("equal_words", (-F.col("item_id")).alias("neg"), "item_words")).alias("b")
    found = matches(docs, benchmark, least).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), best)
    return found.select("doc_id", "n_items", (-F.col("b.neg")).alias("item_id"), F.col("b.equal_words").cast("long").alias("equal_words"), (F.col("b.equal_words") / F.col("b.item_words")).alias("coverage"))
