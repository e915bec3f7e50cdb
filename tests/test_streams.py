"""Streams on files: replayed batches, restarts, late events, quotas and their timers."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from quarry.streaming import counters, telemetry

DDL = "event_id long, user_id long, ts timestamp, event_type string"


def put(folder: Path, name: str, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(dict(zip(("event_id", "user_id", "ts", "event_type"), r, strict=True))) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def stream(spark, folder):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(str(folder))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    src, out, at = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    put(src, "a", [(i, i % 2, "2024-01-01 00:00:00", "x") for i in range(5)])
    put(src, "b", [(i, 7, "2024-01-02 00:00:00", "y") for i in range(3)])
    run = lambda: counters.count_into(stream(spark, src), out, str(at), ["user_id", "event_type"], {"n": F.lit(1), "ids": F.col("event_id")}).awaitTermination()
    totals = lambda: sorted(tuple(r) for r in counters.read_counts(spark, out, ["user_id", "event_type"]).select("user_id", "event_type", "n", "ids").collect())
    run()
    want = [(0, "x", 3, 6), (1, "x", 2, 4), (7, "y", 3, 3)]
    assert totals() == want
    # the last batch ends before its commit: it is run again after the restart
    (at / "commits" / "1").unlink()
    (at / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert totals() == want
    put(src, "c", [(9, 7, "2024-01-03 00:00:00", "y")])
    run()
    want[2] = (7, "y", 4, 12)
    assert totals() == want
    counters.compact(spark, out, ["user_id", "event_type"], 1)
    assert totals() == want
    counters.compact(spark, out, ["user_id", "event_type"], 2)
    assert totals() == want


def test_late_events_and_restart(spark, tmp_path):
    """What comes after the watermark is dropped; the state outlives a restart."""
    src, at, out = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")
    put(src, "a", [(1, 1, "2024-01-01 00:10:00", "x"), (2, 1, "2024-01-01 00:50:00", "x")])

    def run():
        telemetry.windowed(stream(spark, src)).writeStream.format("parquet").option("checkpointLocation", at).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    put(src, "b", [(3, 1, "2024-01-01 00:55:00", "x"), (4, 1, "2024-01-01 03:00:00", "x")])
    run()
    put(src, "c", [(5, 1, "2024-01-01 00:20:00", "x"), (6, 1, "2024-01-01 06:00:00", "x")])
    run()
    put(src, "d", [(7, 1, "2024-01-01 09:00:00", "x")])
    run()
    got = sorted((str(r["start"]), r["n"]) for r in spark.read.parquet(out).collect())
    assert got[:2] == [("2024-01-01 00:00:00", 3), ("2024-01-01 03:00:00", 1)]


def test_quotas(spark, tmp_path):
    """Two a day, three a month; late uses count on their own day, those older than the watermark are dropped; timers clear the state."""
    src, at, out = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")

    def run():
        q = counters.quotas(stream(spark, src), 2, 3).writeStream.format("parquet").option("checkpointLocation", at).option("path", out).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    put(src, "a", [(1, 1, "2024-01-30 10:00:00", "x"), (2, 1, "2024-01-30 11:00:00", "x"), (3, 1, "2024-01-30 12:00:00", "x"), (4, 2, "2024-01-30 12:00:00", "x")])
    run()
    put(src, "b", [(5, 1, "2024-01-31 00:10:00", "x"), (6, 2, "2024-01-30 23:50:00", "x")])
    run()
    put(src, "c", [(7, 1, "2024-01-31 00:20:00", "x"), (8, 2, "2024-01-31 05:00:00", "x")])
    run()
    put(src, "d", [(9, 2, "2024-01-30 01:00:00", "x"), (10, 1, "2024-02-01 00:30:00", "x"), (11, 3, "2024-03-05 00:00:00", "x")])
    run()
    put(src, "e", [(12, 3, "2024-03-05 01:00:00", "x")])
    last = run()
    got = {r["event_id"]: (r["used"], r["used_month"], r["allowed"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (1, 1, True), 2: (2, 2, True), 3: (2, 2, False), 4: (1, 1, True), 5: (1, 3, True), 6: (2, 2, True), 7: (1, 3, False), 8: (1, 3, True),
        10: (1, 1, True), 11: (1, 1, True), 12: (2, 2, True),
    }
    assert last["stateOperators"][0]["numRowsTotal"] == 1  # users 1 and 2 are gone
