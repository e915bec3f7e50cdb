"""Cut the lineage of loops, keep staged tables, log runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new local one only for a local master where that is unset (tests)."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    at = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a new Parquet table in the shared folder: made once, however often it is used, with statistics for later plans."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, folder: str, phases: list[tuple[str, Callable[..., DataFrame]]], redo_from: str | None = None) -> dict[str, DataFrame]:
    """Each phase's table, written once below the folder: a finished one is read again, unless it is `redo_from` or comes after it.

    A phase takes the tables of those before it by name.
    """
    out: dict[str, DataFrame] = {}
    redo = False
    for name, build in phases:
        redo = redo or name == redo_from
        path = f"{folder}/{name}"
        if redo or not _finished(spark, path):
            build(**out).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def _finished(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def export_csv(df: DataFrame, path: str) -> None:
    """Header, quoted fields, nulls as empty cells: what read_csv reads back."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def load_log(name: str, rows_in: DataFrame, rows_out: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """One audit row of a run: loader, rows_in, rows_out, matched, unmatched; counted on the executors."""
    count = lambda df, c: df.agg(F.count("*").alias(c))
    row = count(rows_in, "rows_in").crossJoin(count(rows_out, "rows_out"))  # one row each
    row = row.crossJoin(count(matched if matched is not None else rows_out, "matched"))
    return row.select(F.lit(name).alias("loader"), "rows_in", "rows_out", "matched", (F.col("rows_in") - F.col("matched")).alias("unmatched"))


def newest_log(log: DataFrame, recency: str) -> DataFrame:
    """The newest row of each loader."""
    rest = [c for c in log.columns if c != "loader"]
    return log.groupBy("loader").agg(F.max_by(F.struct(*rest), recency).alias("x")).select("loader", "x.*")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small report table; the first `most` rows."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])
