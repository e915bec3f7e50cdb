"""Streams that count: an idempotent counter merge by micro-batch, and quotas with state that timers clear."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def count_into(events: DataFrame, path: str, checkpoint: str, keys: list[str], counts: dict[str, Column], **trigger) -> StreamingQuery:
    """Run a stream whose counters (sums of the given columns) by key add up below path; read_counts() reads the totals.

    Each micro-batch writes its own folder batch=<id>, over what an earlier attempt of the same batch left there. A batch that
    is replayed after a failure so changes nothing, and no total is read to be written. One stream owns the path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in counts.items()])
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(**(trigger or {"availableNow": True})).start()


def read_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The totals of all batches, those that compact() has folded among them."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    first = _folded(spark, path)
    if first is not None:
        rows = rows.filter(F.col("batch") > first).drop("batch").unionByName(spark.read.parquet(f"{path}/base-{first}"))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "batch")])


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Fold the batches up to a number, all of which are committed, into one base; the batches' own folders may then go."""
    first = _folded(spark, path)
    if first is not None and first >= upto:
        return
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch").between(-1 if first is None else first + 1, upto)).drop("batch")
    if first is not None:
        rows = rows.unionByName(spark.read.parquet(f"{path}/base-{first}"))
    rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys]).write.mode("overwrite").parquet(f"{path}/base-{upto}")


def _folded(spark: SparkSession, path: str) -> int | None:
    """The number of the newest finished base."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base-*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return max((int(x.getPath().getParent().getName().removeprefix("base-")) for x in found or []), default=None)


QUOTA = "event_id long, user_id long, ts timestamp, used int, used_month int, allowed boolean"


def quotas(events: DataFrame, by_day: int, by_month: int, late: str = "1 hour") -> DataFrame:
    """events(event_id, user_id, ts) of a stream, each with its user's uses of its UTC day and month and whether it is allowed.

    A use that is refused is not counted. The state holds the counts of the days that the watermark has not left; a late event
    counts on its own day, and one older than the watermark is dropped. A timer drops days and months that are over, so that a
    silent user leaves no state behind. Rows of a user may come in several pieces.
    """

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = datetime.fromtimestamp(state.getCurrentWatermarkMs() / 1000, UTC)
        days, months = (dict(zip(*x, strict=True)) for x in ((state.get[0], state.get[1]), (state.get[2], state.get[3]))) if state.exists else ({}, {})
        open_ = f"{mark:%Y-%m-%d}"
        days, months = {d: n for d, n in days.items() if d >= open_}, {m: n for m, n in months.items() if m >= open_[:7]}
        if not state.hasTimedOut:
            for b in pieces:
                out = []
                for e, t in zip(b["event_id"], b["ts"], strict=True):
                    d = f"{t:%Y-%m-%d}"
                    ok = days.get(d, 0) < by_day and months.get(d[:7], 0) < by_month
                    days[d], months[d[:7]] = days.get(d, 0) + ok, months.get(d[:7], 0) + ok
                    out.append((e, key[0], t, days[d], months[d[:7]], ok))
                yield pd.DataFrame(out, columns=["event_id", "user_id", "ts", "used", "used_month", "allowed"])
        if months:
            state.update((list(days), list(days.values()), list(months), list(months.values())))
            last = max(months)
            over = datetime(int(last[:4]) + (last[5:] == "12"), int(last[5:]) % 12 + 1, 1, tzinfo=UTC)
            state.setTimeoutTimestamp(int(max(over, mark + timedelta(milliseconds=1)).timestamp() * 1000))
        elif state.exists:
            state.remove()

    rows = events.select("event_id", "user_id", "ts").withWatermark("ts", late).groupBy("user_id")
    return rows.applyInPandasWithState(step, QUOTA, "days array<string>, day_n array<int>, months array<string>, month_n array<int>", "append", GroupStateTimeout.EventTimeTimeout)
