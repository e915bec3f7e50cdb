"""Tables that several loaders share, each owning its rows: the change set of a run, swapped in at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _digest(columns: list[str]) -> Column:
    """Hash of a row; nulls are told from absent values."""
    return F.sha2(F.to_json(F.struct(*[F.struct(F.col(c).alias("v")).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, change: insert, update, delete or unchanged, by the hashes of the rows; keys are unique, and null keys are equal."""
    rest = [c for c in new.columns if c not in keys]
    a, b = (df.select(*[F.col(k).alias(f"{e}_{k}") for k in keys], _digest(rest).alias(f"{e}_h")) for e, df in (("a", old), ("b", new)))
    same = reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    kind = F.when(F.col("a_h").isNull(), "insert").when(F.col("b_h").isNull(), "delete").when(F.col("a_h") == F.col("b_h"), "unchanged").otherwise("update")
    return a.join(b, same, "full_outer").select(*[F.coalesce(f"b_{k}", f"a_{k}").alias(k) for k in keys], kind.alias("change"))


def replace_owner(df: DataFrame, path: str, owner: str, keys: list[str]) -> dict[str, int]:
    """Make df the owner's rows of the table below path; returns the number of rows by change.

    The rows are written as a new version first; only then the owner's pointer is moved to it, in one rename. A run that
    breaks before leaves the table as it was, other owners' rows are never touched, and rows that this run did not produce
    are gone with the old version. An empty run and one with repeated keys are refused.
    """
    spark = df.sparkSession
    version = f"{path}/{owner}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    new = spark.read.schema(df.schema).parquet(version)
    if new.isEmpty():
        raise ValueError(f"an empty run does not replace the rows of {owner}")
    if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"the rows of {owner} repeat a key of {', '.join(keys)}")
    before = current(spark, path, owner)
    old = spark.read.parquet(before) if before else new.limit(0)
    counts = {r["change"]: r["count"] for r in changes(old, new, keys).groupBy("change").count().collect()}  # four rows at most
    _point(spark, f"{path}/{owner}", version.rpartition("/")[2])
    return counts


def current(spark: SparkSession, path: str, owner: str) -> str | None:
    """The folder of the owner's current version."""
    fs, at = _file(spark, f"{path}/{owner}/_current")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{path}/{owner}/{stream.readLine()}"
    finally:
        stream.close()


def read_owned(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of all owners, with a column owner."""
    fs, at = _file(spark, path)
    owners = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())
    parts = [(o, where) for o in owners if (where := current(spark, path, o))]
    if not parts:
        raise ValueError(f"no owner has published rows below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(w).withColumn("owner", F.lit(o)) for o, w in parts])


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Move the pointer by a rename over the old one, which other readers see whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, fresh = _file(spark, f"{folder}/_next-{version}")
    out = fs.create(fresh)
    out.writeBytes(version)
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    to = hadoop.Path(f"{folder}/_current")
    hadoop.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(to), over)
