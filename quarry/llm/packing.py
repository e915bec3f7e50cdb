"""Packing by minimum bin slack: subset sums of the remaining lengths, as a bitset, fill each window closest to capacity.

A document's ids, then id 0, are cut at multiples of the window; full pieces are sequences of their own. The remaining
pieces of a shard of some thousand documents are a multiset of lengths. For each window the longest piece goes first,
the reachable sums of the others are bits of an integer, and the counts that reach the best sum are backtracked. A window
that cannot be filled takes a smaller power of two if the lengths reach one, since such sequences need no padding.

Defined results: null or empty text is id 0 alone; repeated rows are packed singly; shards are independent, so a sequence
id is shard * 2^40 + a running number.

Ids are those of the tokenizers library with the given vocabulary. Its ranks as a tiktoken file, where given, produce the
same ids five times as fast; texts that spell a special token always go through the tokenizers library.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import table

SHARD_DOCS = 4096


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(vocab: str, ranks: str | None):
    """texts -> lists of ids."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(vocab)
    plain = lambda t: slow.encode(t, add_special_tokens=False).ids
    if not ranks:
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda t: plain(t) if any(x in t for x in special) else fast.encode_ordinary(t)


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Counts by length of the next window: the longest piece and the others that come closest to capacity."""
    longest = int(np.flatnonzero(counts)[-1])
    room = capacity - longest
    wanted = [room] + [(1 << k) - longest for k in range(capacity.bit_length() - 1, -1, -1) if longest <= 1 << k < capacity]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, m = min(int(counts[n]) - (n == longest), room // n), 1
        while left > 0 and not reach >> room & 1:
            take = min(m, left)
            steps.append((n, take, reach))
            reach |= reach << take * n & mask
            left, m = left - take, m * 2
    at = next((x for x in wanted if reach >> x & 1), reach.bit_length() - 1)
    out = {longest: 1}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + take
            at -= take * n
    return out


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece of at most capacity."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    queues = {int(n): np.flatnonzero(lengths == n).tolist() for n in np.flatnonzero(counts)}
    window, offset, w = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while counts.any():
        pattern = fill(counts, capacity)
        for _ in range(min(int(counts[n]) // c for n, c in pattern.items())):
            at = 0
            for n, c in pattern.items():
                for i in (queues[n].pop() for _ in range(c)):
                    window[i], offset[i] = w, at
                    at += n
                counts[n] -= c
            w += 1
    return window, offset


def pack(docs: DataFrame, vocab: str, ranks: str | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocab, ranks)
        for b in batches:
            n, crcs = [], []
            for t in b["text"]:
                ids = np.array([*(encode(t) if t else ()), 0], "<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, len(ids), capacity)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "doc_tokens": n, "crcs": crcs})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = table(rows.mapInPandas(count, "doc_id long, doc_tokens long, crcs array<long>"), "pack-counts")
    shards = max(1, -(-counted.count() // SHARD_DOCS))

    def place(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("doc_id")
        tokens = b["doc_tokens"].to_numpy()
        pieces = (tokens + capacity - 1) // capacity
        doc = np.repeat(np.arange(len(b)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, tokens[doc] - start)
        window, offset = pack_lengths(length, capacity)
        first = int(b["shard"].iloc[0]) << 40
        return pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc], "start": start, "length": length, "ids_crc32": np.concatenate([np.asarray(x) for x in b["crcs"]]), "doc_tokens": tokens[doc], "sequence_id": first + window, "offset": offset})

    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
