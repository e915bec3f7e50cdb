"""The corpus pipeline: language ID, exact dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and rereads it for the next.

Defined results: an empty table of documents gives no row in any stage; an empty benchmark takes nothing away; documents with
null or letterless texts go in the first stage; of rows that repeat an id and text, all stay or all go together; columns
besides those of documents are dropped in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import decontaminate, exact_dedup, langid, ngram_join, packing
from quarry.llm.common import read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter have no language and go; the others stay, whatever their language."""
    return langid.identify(docs.select(COLUMNS), F.lit(True)).filter(~F.col("lang_pred").eqNullSafe("und")).select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of equal texts stays."""
    kept = exact_dedup.exact_dedup(docs, F.pmod("doc_id", F.lit(2)) == 0).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    stay = ngram_join.ngram_components(docs, k=5, pct=80).filter("doc_id = component_id").select("doc_id")
    return docs.join(stay, "doc_id", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark overlap go."""
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("exact_dedup", dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: Language ID, near duplicates and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
