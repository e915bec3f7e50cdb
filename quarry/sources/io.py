"""Readers for the catalog's formats and idempotent writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_xml(spark: SparkSession, path: str, tag: str, schema: StructType) -> DataFrame:
    """One row per element; a schema is needed, since a single child and a repeated one are inferred differently."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields, embedded newlines; missing cells are empty strings."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines that read_jsonl drops, to be counted or kept: value. They come from the same parse; blank lines are none."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("_bad", StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
    # a scan has to read another column as well; of its text no character is taken
    rest = F.substring(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "_bad"])), 1, 0)
    return rows.filter("_bad IS NOT NULL").select(F.concat("_bad", rest).alias("value"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON: one row a feature with its properties (a DDL schema) and its geometry's type."""
    shape = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"))


def read_json_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON record a file, with the file's name without its ending as slug."""
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("slug", slug)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    r"""Tab-separated rows without a header, \N for null, as members of a table archive have them once unpacked."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)


def read_members(spark: SparkSession, path: str, member: str, schema: StructType) -> DataFrame:
    """The named members of tar archives (plain, gz or bz2) as rows: each archive is streamed by one task, in pieces of lines."""
    import io
    import tarfile

    def lines(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for info in tar:
                        if info.isfile() and info.name.rpartition("/")[2] == member:
                            for piece in iter(lambda f=tar.extractfile(info): f.readlines(1 << 20), []):
                                yield pd.DataFrame({"value": [x.decode("utf-8").rstrip("\r\n") for x in piece]})

    value = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
    cells = F.transform(F.split("value", "\t", -1), lambda x: F.when(x != "\\N", x))
    row = value.select(cells.alias("c"))
    return row.select(*[F.get("c", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Request-log entries of text files: method, route, status, ms."""
    from ..operators.feeds import log_entries

    return log_entries(spark.read.text(path))


def resume(raw: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The raw rows beyond the largest key that the target holds: a restart goes on where it stopped."""
    top = target.agg(F.max(key).alias("_top"))  # one row
    return raw.crossJoin(F.broadcast(top)).filter(F.col("_top").isNull() | (F.col(key) > F.col("_top"))).drop("_top")


def newest_batch(batches: DataFrame, table: DataFrame) -> DataFrame:
    """The newest active or checked batch that has rows in the table: batches(id, status, created), table(batch_id, ...)."""
    held = table.select(F.col("batch_id").alias("id")).distinct()
    live = batches.filter(F.col("status").isin("active", "qa")).join(held, "id", "left_semi")
    return live.agg(F.max_by("id", "created").alias("batch_id"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One file, one row: slug and text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("slug"), F.col("value").alias("text"))


def dump_date(name: Column) -> Column:
    """The first eight-digit date of a file name."""
    return F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")


def append_new(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: one per key, and only keys that the target lacks."""
    return df.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def replace_owned(df: DataFrame, path: str, owner: str) -> None:
    """Rewrite only the partitions of the sources that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)
