"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, html_text, imatch, langid, lexical, licenses, ngram_join, packing, pii, runs, toxicity, warc
from .common import read, table


def remainder(k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), k=3, pct=90)


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(read(spark, sf_dir, "documents"), k=3, pct=90)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), remainder(4) != 2)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; n_added counts what the classifier added, spans lists both."""
    found = pii.detect(read(spark, sf_dir, "documents"))
    counts = [_count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, the best item and its overlap (null if there is none)."""
    docs = read(spark, sf_dir, "documents")
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", "equal_words", "coverage")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even ids stand for the immutable snapshot, the odd ones for the new batch; the result depends on neither."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(2)) == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, remainder(5) != 0)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder and read back; every column comes from the records read.

    Gaps are written to a log of their own and reported; the records around them come back all the same, so a page that is
    lost shows in an anti join with the pages.
    """
    blobs = table(warc.archives(read(spark, sf_dir, "pages")), "warc")
    back = table(warc.records(blobs, payloads=False), "warc-records")
    gaps = table(warc.quarantine(back), "warc-gaps")
    if lost := gaps.count():
        logging.getLogger(__name__).warning("%d gaps in the archives, logged in %s", lost, gaps.inputFiles()[0].rpartition("/")[0])
    back = back.filter("kind = 'record'")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    refers = F.when(F.col("refers_to").isNotNull(), page("refers_to"))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Of ids whose crc32 h is a multiple of ten, the words from place a = g % n on repeat the p words there (g = h div 10)."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.selectExpr("*", "h div 10 AS g", "size(w) AS n").selectExpr("*", "CASE WHEN n > 0 THEN CAST(g % n AS int) END AS a")
    rows = rows.selectExpr("*", "CAST(1 + (n - a) div (3 + g % 8) AS int) AS p")
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS int))), 1, n - a)"
    return rows.selectExpr("doc_id", f"CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(concat(slice(w, 1, a), {tail}), ' ') ELSE text END AS text")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periodic_tails(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.selectExpr("doc_id", "n_runs", "-best.start AS start", "best.length AS length", "-best.period AS period", "1000 * best.length div -best.period AS exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_next(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op1_ngram_links, op2_html, op3_toxicity, op4_pii, op5_decontaminate, op6_licenses, op7_exact_dedup, op8_language, op9_warc, op10_packing, op11_lexical, op12_runs, op13_imatch, pipeline)}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
             n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
             common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common.k >= 90 * (x.k + y.k - common.k)),
             reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
        SELECT w.doc_id, coalesce(any_value(n.k), 0) AS n_shingles, min(r) AS component_id FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY 1""",
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM f""",
    "op11_lexical": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
             m AS (SELECT doc_id, 10 + (90 * len(ts) * docs) // total AS m FROM d, s WHERE len(ts) > 0),
             p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY 1),
             r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""",
}
