"""Exact dedup: binary-fuse filters of immutable snapshots screen a new batch's digests; positives meet the exact buckets.

A snapshot holds one row per distinct text: digest, keep_id, group_size. Its filters are one binary-fuse filter (three
16-bit fingerprints a key) per shard of the digest; they depend on the snapshot alone, so save_filters() keeps them with it
and later batches read them. Any number of snapshots may be screened one after the other. The new batch is grouped by
digest first, so that copies within it, however many, are one row with a count when they meet the filter. Only digests that
a filter lets pass are joined with the snapshot's bucket, where the texts themselves are compared.

Defined results: null counts as empty text; all empty texts are one group; the smallest id stays; repeated rows count
singly, and an id may repeat with another text; very long texts are taken whole; an empty snapshot or batch gives the
other's groups. Where the byte check finds two texts under one digest, the snapshot's and the batch's rows are two groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded, table

#: Keys that a shard of the snapshot holds on average.
SHARD_KEYS = 20_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, seg: int, segs: int) -> np.ndarray:
    """Three slots in three neighbouring segments, as a binary-fuse filter has them."""
    first = ((h >> np.uint64(32)) * np.uint64(segs) >> np.uint64(32)).astype(np.int64)
    at = [(h >> np.uint64(s)).astype(np.int64) & (seg - 1) for s in (0, 11, 22)]
    return np.stack([(first + i) * seg + a for i, a in enumerate(at)])


def _print16(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, segments, fingerprints; keys are peeled in rounds and given slots in reverse."""
    keys = np.unique(keys)
    n = max(1, len(keys))
    seg = 1 << max(2, min(11, int(np.log(n) / np.log(3.33) + 1.25) if n > 1 else 2))
    grow, seed = max(1.23, 0.875 + 0.25 * np.log(1e6) / np.log(max(2, n))), 1
    while True:
        segs = max(1, int(np.ceil(n * grow / seg)) - 2) + 1
        size = (segs + 2) * seg
        h = _mix(keys, seed)
        at = _slots(h, seg, segs)
        live, rounds = np.arange(len(keys)), []
        while len(live):
            count = np.bincount(at[:, live].ravel(), minlength=size)
            free = count[at[:, live]] == 1
            can = free.any(0)
            if not can.any():
                break
            rounds.append((live[can], free.argmax(0)[can]))
            live = live[~can]
        if not len(live):
            break
        seed, grow = seed + 1, grow * 1.05
    out, own = np.zeros(size, np.uint16), _print16(h)
    for ids, which in reversed(rounds):
        slots = at[:, ids]
        target = slots[which, np.arange(len(ids))]
        out[target] = 0
        out[target] = own[ids] ^ out[slots[0]] ^ out[slots[1]] ^ out[slots[2]]
    return seed, seg, segs, out.tobytes()


def may_hold(keys: np.ndarray, seed: int, seg: int, segs: int, prints: bytes) -> np.ndarray:
    f = np.frombuffer(prints, np.uint16)
    h = _mix(keys, seed)
    a, b, c = _slots(h, seg, segs)
    return (f[a] ^ f[b] ^ f[c]) == _print16(h)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(digest: Column) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _shards(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("key", _key(F.col("digest"))).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def filters(digests: DataFrame, shards: int) -> DataFrame:
    """digests(digest) of one snapshot -> one filter a shard."""

    def build(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(b["shard"].iloc[0]), *build_filter(b["key"].to_numpy().astype(np.uint64)))], columns=["shard", "seed", "seg", "segs", "prints"])

    return _shards(digests, shards).select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, seed int, seg int, segs int, prints binary")


def screen(batch: DataFrame, snapshot_filters: DataFrame, shards: int) -> DataFrame:
    """batch(digest, ...) with a column hit: false only where the snapshot surely lacks the digest."""
    keyed = _shards(batch, shards)

    def test(b: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        keys = b["key"].to_numpy().astype(np.uint64)
        hit = may_hold(keys, *f.iloc[0][["seed", "seg", "segs", "prints"]]) if len(f) else np.zeros(len(b), bool)
        return b.drop(columns=["key", "shard"]).assign(hit=hit)

    return keyed.groupBy("shard").cogroup(snapshot_filters.groupBy("shard")).applyInPandas(test, batch.withColumn("hit", F.lit(True)).schema)


def save_filters(digests: DataFrame, shards: int, path: str) -> None:
    """Keep a snapshot's filters beside it: a snapshot never changes, so they are built once."""
    filters(digests, shards).withColumn("shards", F.lit(shards)).write.parquet(path)


def load_filters(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The filters that save_filters() has written, and their number of shards."""
    kept = spark.read.parquet(path)
    return kept.drop("shards"), kept.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]


def groups(digests: DataFrame) -> DataFrame:
    """digests(digest, doc_id) -> one row a digest: the id that stays and the number of rows."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows where `snapshot` holds are the immutable snapshot, the others the new batch.

    Returns for every row doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.coalesce(snapshot, F.lit(False)).alias("old"))
    rows = table(rows, "dedup-digests")
    old, new = table(groups(rows.filter("old")), "dedup-old"), table(groups(rows.filter("not old")), "dedup-new")
    shards = max(64, -(-max(old.count(), new.count()) // SHARD_KEYS))
    tested = table(screen(new, filters(old.select("digest"), shards), shards), "dedup-tested")
    met = tested.filter("hit").join(old.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size")), "digest")
    met = table(met, "dedup-met")
    # byte checks: the text of each positive's first row against the text that the bucket's first row has
    ids = met.select(F.col("keep_id").alias("doc_id"), "digest").union(met.select(F.col("old_id"), "digest"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = plain.join(bounded(ids, 2 * met.count()), "doc_id").select("digest", normalised(F.col("text")).alias("text"))
    texts = texts.filter(F.unhex(F.sha2("text", 256)) == F.col("digest"))  # an id may have other texts as well
    same = texts.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    both = F.array(F.lit(True), F.lit(False))
    met = met.join(same.filter("same"), "digest").select("digest", F.explode(both).alias("old"), F.least("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size"))
    met = table(met, "dedup-joined")
    sides = old.withColumn("old", F.lit(True)).union(tested.select(*old.columns).withColumn("old", F.lit(False)))
    alone = sides.join(met.select("digest", "old"), ["digest", "old"], "left_anti").select("digest", "old", "keep_id", "group_size")
    # two texts under one digest stay two groups, one a side
    out = rows.join(alone.union(met), ["digest", "old"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
