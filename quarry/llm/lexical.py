"""Ranked lexical search by sort-based accumulation: every document is ranked for every item of a query table.

Items are dealt into blocks of a bounded number of (item, term) pairs. For a block, each document is cut into terms once and
keeps the block's terms with their counts; document frequencies and lengths are sums over all documents. Then each task
concatenates, for a chunk of documents, the arrays (item, document, impact) of all matches, radix sorts their packed keys,
adds up equal keys with reduceat and selects each item's best with a heap; all terms of a document are in its task, so a
score is whole before anything is shuffled. What tasks leave (top rows an item) is merged over groups of tasks, then again.

Scores: w = floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles, the rest in 64-bit integers rounding down,
m = 10 + 90 n N div L, and a document's score is the sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms.

Defined results: null or empty texts have no terms, and neither rank nor count; rows that repeat an id are documents of
their own; rows of one item are one item with all their terms, once each; ties go to the smaller doc_id (null first); an
empty table gives no row; very long texts are taken whole; columns besides id and text are ignored. Counters stay exact
while 90 n N is below 2^63 or beyond (whole numbers of any size).
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import NO_ID, keyed, table, terms

#: (item, term) pairs of a block, which is broadcast; twice as many at most, unless one item alone has more.
BLOCK_PAIRS = 250_000
#: Matches that a task sorts at once, or those of one document.
CHUNK = 2_000_000


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integer keys: one counting pass for each 16 bits, lowest first."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impacts by (item, doc), in that order."""
    width = int(doc.max(initial=0)).bit_length()
    keys = (item << width) | doc
    order = radix_order(keys)
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start] >> width, keys[start] & ((1 << width) - 1), np.add.reduceat(impact[order], start)


class Best:
    """The best rows of each item so far: heaps of (score, -doc_id), and the score that a full heap asks for."""

    def __init__(self, items: int, top: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least, self.top = np.zeros(items, np.int64), top

    def add(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        may = (score > 0) & (score >= self.least[item])
        item, doc_id, score = item[may], doc_id[may], score[may]
        order = np.lexsort((doc_id, -score, item))
        item, doc_id, score = item[order], doc_id[order], score[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        for i, d, s in zip(*(x[place < self.top].tolist() for x in (item, doc_id, score)), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        return ((i, -d, s) for i, heap in enumerate(self.heaps) for s, d in heap)


def _pairs(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, t.decode()) for i, text in zip(b["item_id"], b["text"], strict=True) for t in set(terms(text))]
            yield pd.DataFrame(found, columns=["item_id", "term"])

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id IS NOT NULL")
    return table(rows.mapInPandas(cut, "item_id string, term string").distinct(), "lexical-pairs")


def _blocks(pairs: DataFrame) -> tuple[DataFrame, int]:
    """pairs with a column block; blocks are halved until each is small or holds one item."""
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        sizes = dealt.groupBy("block", "item_id").count().groupBy("block").agg(F.sum("count").alias("n"), F.count("*").alias("items"))
        if sizes.filter((F.col("n") > 2 * BLOCK_PAIRS) & (F.col("items") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with terms: doc_id, n (its terms with repeats), terms and tfs (those of the vocabulary)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for b in batches:
            out = []
            for d, text in zip(b["doc_id"], b["text"], strict=True):
                words = terms(text)
                if words:
                    tf = Counter(filter(number.__contains__, words))
                    out.append((d, len(words), [number[w] for w in tf], list(tf.values())))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "tfs"])

    return docs.mapInPandas(post, "doc_id long, n long, terms array<int>, tfs array<long>")


def _scored(posted: DataFrame, weight: np.ndarray, first: np.ndarray, held: np.ndarray, n_items: int, n_docs: int, length: int, top: int) -> DataFrame:
    """item (number), doc_id, score: the best of each task. first and held: the items of each term, one after the other."""
    given = posted.sparkSession.sparkContext.broadcast((weight, first, held))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, first, held = given.value
        best = Best(n_items, top)
        for b in batches:
            if b.empty:
                continue
            ids = b["doc_id"].to_numpy(np.int64)
            m = np.array([10 + 90 * int(n) * n_docs // length for n in b["n"]], np.int64)
            doc = np.repeat(np.arange(len(b)), [len(x) for x in b["terms"]])
            term, tf = (np.concatenate(list(b[c])).astype(np.int64) for c in ("terms", "tfs"))
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            doc, term, impact = doc[impact > 0], term[impact > 0], impact[impact > 0]
            many = first[term + 1] - first[term]
            before = np.r_[0, np.cumsum(many)]
            start = 0
            while start < len(doc):  # whole documents, as many as a chunk holds
                stop = max(start + 1, int(np.searchsorted(before, before[start] + CHUNK, "right")) - 1)
                cut = np.searchsorted(doc, doc[stop]) if stop < len(doc) else len(doc)
                stop = int(cut) if cut > start else int(np.searchsorted(doc, doc[start], "right"))
                own = many[start:stop]
                at = np.repeat(np.arange(start, stop), own)
                place = np.arange(len(at)) - np.repeat(before[start:stop] - before[start], own)
                item, of, total = accumulate(held[first[term[at]] + place], doc[at] - doc[start], impact[at])
                best.add(item, ids[of + doc[start]], total)
                start = stop
        yield pd.DataFrame(best.rows(), columns=["item", "doc_id", "score"], dtype=np.int64)

    return posted.mapInPandas(score, "item int, doc_id long, score long")


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best of each item over all tasks: over groups of 64 tasks, of 64 groups, then all; a task and item have `top` rows."""
    best = [F.col("score").desc(), F.col("doc_id").asc()]
    found = found.withColumn("part", F.spark_partition_id())
    for _ in range(2):
        found = found.withColumn("part", F.shiftright("part", 6))
        place = F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))
        found = found.withColumn("rank", place).filter(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The `top` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col)
    pairs, blocks = _blocks(_pairs(items, item_col, item_text_col))
    out = []
    for block in range(blocks):
        got = pairs.filter(F.col("block") == block).select("item_id", "term").toArrow()  # bounded by BLOCK_PAIRS
        names, item = np.unique(got["item_id"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        vocabulary, term = np.unique(got["term"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        if not len(names):
            continue
        posted = table(postings(docs, {t.encode(): i for i, t in enumerate(vocabulary)}), "lexical-postings")
        n_docs, length = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        counts = posted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[counts["term"].to_numpy()] = counts["count"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        order = np.lexsort((item, term))
        first = np.r_[0, np.cumsum(np.bincount(term, minlength=len(vocabulary)))]
        found = _scored(posted, weight, first, item[order].astype(np.int64), len(names), n_docs, length, top)
        numbered = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "item int, item_id string")
        out.append(table(_merged(found.join(F.broadcast(numbered), "item"), top), "lexical-best"))
    kind = items.schema[item_col].dataType
    empty = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    best = reduce(DataFrame.union, out, empty)
    return best.select(F.col("item_id").cast(kind).alias("item_id"), "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
