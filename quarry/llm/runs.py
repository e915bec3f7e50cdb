"""Periodic runs of words: all maximal repetitions of a text, by longest previous factors.

For a batch of texts, each with an alphabet of its own, prefix doubling gives the suffix array and, for each power of two,
names of all stretches of that length; equal names are equal stretches, so the longest common extension of two places,
forward or backward, takes a step for each power. LCP values of neighbours in the suffix array give, with one stack, the
array of longest previous factors and their earlier places, and those the LZ blocks of the text. A run that touches a block
boundary is found by Main's extensions: for each period that the lengths of the two blocks allow, the run goes as far as the
text agrees with itself one period on, left and right of the boundary. A run inside a block is the copy of an earlier run:
runs are kept in buckets by start, and those of a block's earlier place are copied from left to right.

A run [s, e) that ends in block [b, c) and starts before b starts less than a period before the preceding block, since that
block would else be longer; so with at least `exponent` periods, the period is below (c - a) / (exponent - 1), a being the
start of the preceding block.

Defined results: null and empty texts have no words and no runs; rows are answered singly, repeated ones too; very long
texts are taken whole (about 4 bytes a word for each power of two up to the longest repeat, and some 200 bytes more);
columns besides id and text are dropped; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, keyed

#: Words of a batch of texts, or those of one text.
BATCH_WORDS = 200_000


def name_levels(x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words at each place, up to where all differ; own is the number of each place's text.

    x are dense numbers, different between texts. Stretches that pass the end of their text differ from all others. The last
    level holds the rank of each suffix. One more place at the end differs from all others.
    """
    n = len(x)
    count = np.bincount(x)
    rank = (np.cumsum(count) - count)[x]
    todo = np.flatnonzero(count[x] > 1)
    levels, h = [np.r_[rank, -1].astype(np.int32)], 1
    while len(todo):
        follow = todo + h
        inside = follow < n
        follow[~inside] = 0
        inside &= own[follow] == own[todo]
        keys = rank[todo] * (n + 1) + np.where(inside, rank[follow] + 1, 0)
        order = np.argsort(keys)
        keys, todo = keys[order], todo[order]
        old = rank[todo]
        group = np.r_[True, old[1:] != old[:-1]]
        part = np.r_[True, keys[1:] != keys[:-1]]
        at = np.arange(len(todo))
        rank[todo] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(np.r_[rank, -1].astype(np.int32))
        todo = np.sort(todo[~(part & np.r_[part[1:], True])])
        h *= 2
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places i and from places j (i < j) on are equal."""
    i, j, n = i.copy(), j.copy(), len(levels[0]) - 1
    begun = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(i, n)] == levels[k][np.minimum(j, n)]
        same &= j < n
        i += same << k
        j += same << k
    return j - begun


def extend_back(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words up to places i and up to places j (i < j), these included, are equal."""
    i, j = i.copy(), j.copy()
    begun = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - (1 << k) + 1, j - (1 << k) + 1
        same = (a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])
        i -= same << k
        j -= same << k
    return begun - j


def longest_previous(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that also starts earlier, and such an earlier place."""
    n = len(sa)
    length, source = [0] * n, [-1] * n
    after = np.r_[lcp[1:], 0]
    shared = (lcp > 0) | (after > 0)  # all others stand alone
    places, common = [-1], [0]
    for place, l in zip([*sa[shared].tolist(), -1], [*lcp[shared].tolist(), 0], strict=True):
        while place < places[-1]:
            top, below = places.pop(), common.pop()
            if below >= l:
                length[top], source[top] = below, places[-1]
            else:
                length[top], source[top], l = l, place, below
        places.append(place)
        common.append(l)
    return length, source


def lz_blocks(length: list[int]) -> list[int]:
    """Starts of the LZ blocks, and the end."""
    starts, i, n = [], 0, len(length)
    while i < n:
        starts.append(i)
        i += length[i] or 1
    return [*starts, n]


def touching(levels: list[np.ndarray], bounds: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a block boundary, by start, then end; each with its least period."""
    n, x = len(levels[0]) - 1, levels[0]
    size = np.diff(bounds)
    most = (np.r_[size, 0] + np.r_[0, size]) // (exponent - 1)
    b = np.repeat(bounds, most)
    q = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    for near in (b, b - q):  # the period right of the boundary, and left of it
        far = near + q
        ok = (near >= 0) & (far <= n)
        at, to, p = near[ok], far[ok], q[ok]
        ok = (x[at] == x[to]) | ((at > 0) & (x[at - 1] == x[to - 1]))
        at, to, p = at[ok], to[ok], p[ok]
        left, right = extend_back(levels, at - 1, to - 1), extend(levels, at, to)
        found.append(np.stack([at - left, to + right, p], 1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, exponent * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]] if len(rows) else rows


def copied(runs: np.ndarray, bounds: list[int], source: list[int], least: int) -> list[tuple[int, int, int]]:
    """runs with those inside blocks, which are copies of the runs inside the blocks' earlier places."""
    if not len(runs):
        return []
    bucket: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in runs.tolist():
        bucket.setdefault(s, []).append((e, q))
    for b, c in zip(bounds, bounds[1:], strict=False):
        if c - b < least + 2:
            continue
        back = b - source[b]
        for s in range(b + 1, c - least):
            for e, q in bucket.get(s - back, ()):
                if e + back < c:
                    bucket.setdefault(s, []).append((e + back, q))
    return sorted((s, e, q) for s, ends in bucket.items() for e, q in ends)


def find_runs(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each text the runs (start, length, period) of at least `exponent` periods and `least` words, by start, then period."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return [[] for _ in texts]
    numbers: list[int] = []
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
    x, own = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), sizes)
    levels = name_levels(x, own)
    sa = np.empty(len(x), np.int64)
    sa[levels[-1][:-1]] = np.arange(len(x))
    lcp = np.r_[0, extend(levels, np.minimum(sa[1:], sa[:-1]), np.maximum(sa[1:], sa[:-1]))]
    length, source = longest_previous(sa, lcp)
    bounds = lz_blocks(length)
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in copied(touching(levels, np.array(bounds), exponent, least), bounds, source, least):
        t = own[s]
        out[t].append((s - int(ends[t]) + sizes[t], e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs array<struct<start, length, period>> and collapsed, the kept words."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
        ids, texts, n = [], [], 0
        for b in batches:
            for d, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                ids.append(d)
                texts.append(t.encode("utf-8", "surrogatepass").split())
                n += len(texts[-1])
                if n >= BATCH_WORDS:
                    yield ids, texts
                    ids, texts, n = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in chunks(batches):
            found = find_runs(texts, exponent, least)
            cols = {name: [[r[k] for r in runs] for runs in found] for k, name in enumerate(("start", "length", "period"))}
            kept = [b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
            yield pd.DataFrame({"doc_id": ids, "n_words": [len(t) for t in texts], **cols, "collapsed": kept})

    rows = keyed(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    return rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")
