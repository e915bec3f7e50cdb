"""Named queries over the driver's tables, with an independent SQL oracle for each.

Stand-ins: customer = artist, supplier = label, orders = master, lineitem = release credits, part = styles and names,
nation and region = scenes, events = telemetry, labels = quality verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators.feeds import percentiles
from ..sources.io import read_table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""SELECT l_suppkey, o_custkey, c_name, count(*) AS n_credits, count(DISTINCT l_orderkey) AS n_masters FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, o_custkey) <= 10""")
def label_roster(s, d):
    """The ten artists with most credits on each label."""
    li = R.dealt(t(s, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    j = li.join(t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy("l_suppkey", "o_custkey", "l_orderkey").agg(F.count("*").alias("n")).groupBy("l_suppkey", "o_custkey").agg(F.sum("n").alias("n_credits"), F.count("*").alias("n_masters"))
    top = R.top_n(g, ["l_suppkey"], [F.desc("n_credits"), F.asc("o_custkey")], 10).drop("rank")
    return top.join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("l_suppkey", "o_custkey", "c_name", "n_credits", "n_masters")


@query("""WITH g AS (SELECT l_suppkey, style, count(*) AS n FROM (SELECT l_suppkey, unnest(string_split(p_name, ' ')) AS style FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)
SELECT l_suppkey, style, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 4) AS share FROM g""")
def label_styles_share(s, d):
    per = t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    j = per.join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("styles")), "l_partkey")
    return R.share_of_total(j.select("l_suppkey", "n", F.explode("styles").alias("style")), ["l_suppkey", "style"], "n", ["l_suppkey"], "share")


@query("""SELECT o_custkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_suppkey) = 1""")
def artist_primary_labels(s, d):
    j = t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(t(s, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    return R.keep_first(j.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n")), ["o_custkey"], [F.desc("n"), F.asc("l_suppkey")])


@query("""SELECT o_custkey, o_orderkey, year(o_orderdate) AS year, CASE WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'ep' ELSE 'album' END AS kind
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def artist_masters_classified(s, d):
    n = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("n") <= 3, "ep").otherwise("album")
    return t(s, d, "orders").join(n, "o_orderkey").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), kind.alias("kind"))


@query("""SELECT r_name, n_name, s_suppkey, s_name, s_acctbal FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey
QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY s_acctbal DESC, s_suppkey) <= 5""")
def scene_wall(s, d):
    """The five heaviest labels of each scene."""
    places = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    j = t(s, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return R.top_n(j, ["r_name"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 5).select("r_name", "n_name", "s_suppkey", "s_name", "s_acctbal")


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS labels FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def scene_list(s, d):
    n = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    per = t(s, d, "nation").join(n, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"), F.sum("k").alias("labels"))
    return t(s, d, "region").join(per, "r_regionkey", "left").select("r_name", F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("labels", F.lit(0)).cast("long").alias("labels"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (250000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(s, d):
    return R.keyset_page(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (250000.0, 0), 50)


@query("""SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) GROUP BY 1""")
def quality_gate_failopen(s, d):
    return R.gate_fail_open(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels"), "doc_id", F.col("quality") == 0).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) GROUP BY 1""")
def quality_gate_failclosed(s, d):
    return R.gate_fail_closed(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels"), "doc_id", F.col("quality") == 1).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN 'invalid' WHEN regexp_matches(c_name, '^[0-9]+$') THEN 'low_value' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) THEN 'unlinked' ELSE 'active' END AS status FROM customer""")
def quality_classify(s, d):
    linked = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("linked")).distinct()
    status = F.when(F.trim("c_name") == "", "invalid").when(F.col("c_name").rlike("^[0-9]+$"), "low_value").when(F.col("linked").isNull(), "unlinked").otherwise("active")
    return t(s, d, "customer").select("c_custkey", "c_name").join(linked, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("""SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY CAST(floor(o_totalprice / 50000) AS BIGINT) DESC)::BIGINT AS kept FROM orders GROUP BY 1""")
def weight_histogram(s, d):
    """Masters per weight bucket, and how many a threshold there would keep; the window runs over the few buckets."""
    g = t(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("kept", F.sum("n").over(Window.orderBy(F.desc("bucket"))))


@query("""SELECT l_orderkey, l_suppkey AS label, l_linenumber AS line, l_shipdate::DATE AS day FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_shipdate) = 1""")
def canonical_release(s, d):
    """The least line of each master, by one partial aggregate instead of a sort."""
    first = F.min(F.struct("l_linenumber", "l_suppkey", "l_shipdate")).alias("x")
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", F.col("x.l_suppkey").alias("label"), F.col("x.l_linenumber").alias("line"), F.to_date("x.l_shipdate").alias("day"))


@query("""SELECT o_orderkey, 'customer' AS kind, o_custkey AS id FROM orders UNION ALL SELECT o_custkey, 'order', o_orderkey FROM orders""")
def relationship_edges_bidir(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey")
    return o.select(F.explode(F.array(F.struct("o_orderkey", F.lit("customer").alias("kind"), F.col("o_custkey").alias("id")), F.struct(F.col("o_custkey").alias("o_orderkey"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))).alias("x")).select("x.*")


@query("""SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_daily(s, d):
    from ..streaming.telemetry import daily

    return daily(t(s, d, "events"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY 1""")
def latency_percentiles(s, d):
    """Nearest rank: values are counted first, so that no task holds all values of a key."""
    return percentiles(t(s, d, "events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select("event_type", "p50", "p95", F.col("max").alias("top"))


@query("""SELECT user_id, event_type, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2""")
def upsert_latest(s, d):
    """The first half of the month as the target, the second as the update."""
    e = t(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"))
    return R.upsert_latest(e.filter("last_event % 2 = 0"), e.filter("last_event % 2 = 1"), ["user_id", "event_type"], "last_event")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1""")
def raw_flatten_json(s, d):
    e = t(s, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_k"), F.sum("k").alias("sum_k"))


@query(r"""SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""")
def linkout_extract(s, d):
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return t(s, d, "pages").select("page_id", T.host(F.col("url")).alias("host"), links.alias("links"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS name_key FROM part""")
def name_norm(s, d):
    return t(s, d, "part").select("p_partkey", T.name_key(F.col("p_name")).alias("name_key"))


@query("""SELECT n_name, count(*) AS artists, round(avg(c_acctbal), 4) AS mean, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def seo_cohorts(s, d):
    g = t(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("artists"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    return g.join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "artists", "mean", "negative")
