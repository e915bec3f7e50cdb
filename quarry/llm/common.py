"""Shared helpers: the shared folder, written tables, bounded joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a table of a few longs a row may be broadcast (some 40 MB at most).
BROADCAST_ROWS = 500_000
#: Stands for a null id inside an operator: sorts first, as nulls do.
NO_ID = -(1 << 63)
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset (tests).

    A machine-local folder serves a local master only; on a cluster the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(written: DataFrame) -> None:
    """Delete a table that table() has written and that no later step reads."""
    spark = written.sparkSession
    for path in {f.rpartition("/")[0] for f in written.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; a null id is NO_ID, a null text empty."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def terms(text: str | None) -> list[bytes]:
    """Stretches of ASCII letters, digits and all characters beyond ASCII, in UTF-8; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) long -> (node, component): the smallest node reachable, for every node that has a link.

    Rounds of taking the least label of all neighbours, then the label of that label; each round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = table(both.distinct(), "edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = table(first.select("node", F.least("node", "m").alias("component"), F.lit(True).alias("changed")), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), "component")
        near = edges.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hop = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("hop"))
        up = labels.select(F.col("node").alias("hop"), F.col("component").alias("jump"))
        to = F.least("hop", "jump")
        following = table(hop.join(up, "hop").select("node", to.alias("component"), (to < F.col("old")).alias("changed")), "labels")
        drop(labels)
        labels = following
        if labels.filter("changed").isEmpty():
            drop(edges)
            return labels.select("node", "component")
