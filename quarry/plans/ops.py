"""Queries of generic operators, feeds and telemetry, with SQL oracles; stand-ins as in catalog.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import build as B, feeds, lineage, relational as R
from ..operators.lineage import shared_dir
from ..sources.io import read_table as t
from ..streaming.counters import count_into, read_counts
from .catalog import query


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%GEAR' OR p_name ILIKE 'Red%' OR p_name ILIKE p_type")
def any_ilike(s, d):
    p = t(s, d, "part").select("p_partkey", "p_name", "p_type")
    return p.filter(R.any_ilike(F.col("p_name"), F.array(F.lit("%GEAR"), F.lit("Red%"), F.col("p_type")))).select("p_partkey")


@query("""SELECT l_orderkey, nullif(l_linestatus, 'O') AS status, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, nullif(l_linestatus, 'O') ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def null_safe_dedupe(s, d):
    """A null status equals another: the first line of each order and status stays."""
    li = t(s, d, "lineitem").select("l_orderkey", F.nullif("l_linestatus", F.lit("O")).alias("status"), "l_linenumber", "l_partkey", "l_suppkey")
    return B.null_safe_dedupe(li, ["l_orderkey", "status"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]).drop("l_suppkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_size % 3 = 0 THEN 'big' ELSE p_brand END AS p_brand, p_size FROM part")
def write_back(s, d):
    p = t(s, d, "part").select("p_partkey", "p_brand", "p_size")
    new = p.filter("p_size > 25").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "big").alias("p_brand"))
    return R.write_back(p, new, ["p_partkey"])


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'artist' WHEN 'view' THEN 'label' ELSE 'master' END AS kind, user_id AS ref FROM events)
SELECT event_id, kind, ref, coalesce(c_name, s_name, p_name) AS name FROM e LEFT JOIN customer ON kind = 'artist' AND ref = c_custkey LEFT JOIN supplier ON kind = 'label' AND ref = s_suppkey LEFT JOIN part ON kind = 'master' AND ref = p_partkey""")
def polymorphic_names(s, d):
    """A reference by type and id: one join against the union of all types."""
    kind = F.when(F.col("event_type") == "click", "artist").when(F.col("event_type") == "view", "label").otherwise("master")
    e = t(s, d, "events").select("event_id", kind.alias("kind"), F.col("user_id").alias("ref"))
    table = lambda n, k, c: t(s, d, n).select(F.col(k).alias("id"), F.col(c).alias("name"))
    return R.named(e, {"artist": table("customer", "c_custkey", "c_name"), "label": table("supplier", "s_suppkey", "s_name"), "master": table("part", "p_partkey", "p_name")}, "kind", "ref").select("event_id", "kind", "ref", "name")


@query("""WITH n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey FROM n QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) = 1""")
def modal_region(s, d):
    return R.modal(t(s, d, "customer"), ["c_mktsegment"], "c_nationkey")


@query("""WITH p AS (SELECT p_brand, p_type, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'north' ELSE 'south' END AS region, p_size % 2 = 0 AS live FROM part),
n AS (SELECT p_brand, p_type, region, count(*) AS n FROM p WHERE region IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT p_brand, p_type, region FROM n QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n DESC, region) = 1)
SELECT p.p_brand AS name, p.p_type AS title, m.region, count(*) FILTER (WHERE live) AS live, count(*) AS wines FROM p LEFT JOIN m ON p.p_brand = m.p_brand AND p.p_type = m.p_type GROUP BY 1, 2, 3""")
def load_spine(s, d):
    """Producers are the distinct (title, name) pairs of the wines, with their modal region and their live wines."""
    region = F.when(F.col("p_size") % 3 == 1, "north").when(F.col("p_size") % 3 == 2, "south")
    w = t(s, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("title"), region.alias("region"), (F.col("p_size") % 2 == 0).alias("live"))
    n = w.groupBy("name", "title").agg(F.count_if("live").alias("live"), F.count("*").alias("wines"))
    return n.join(R.modal(w, ["name", "title"], "region"), ["name", "title"], "left")


@query("""SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(p_type)))[1:3], ',') AS styles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def top_styles_slice(s, d):
    """The first three of each label's sorted styles."""
    per = t(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return per.groupBy("l_suppkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 3), ",").alias("styles"))


@query("""SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey), o_orderkey) <= 5""")
def bucket_samples(s, d):
    """Five orders of each status in an order that a hash draws; sampling is the feature."""
    return R.sample_per_bucket(t(s, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 5, 7)


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE p_partkey // (p_partkey & -p_partkey) END AS BIGINT) AS owner FROM part")
def merge_apply(s, d):
    """Every even part merges into its half: chains end at an odd number, whatever their length."""
    from ..operators.resolve import apply_merges

    p = t(s, d, "part").select("p_partkey", F.col("p_partkey").alias("owner"))
    auto = p.filter("p_partkey % 2 = 0 AND p_partkey > 0").select(F.col("p_partkey").alias("merge_id"), F.floor(F.col("p_partkey") / 2).alias("keep_id"), F.lit(1).alias("weight"))
    worse = auto.select("merge_id", (F.col("keep_id") + 1).alias("keep_id"), F.lit(0).alias("weight"))
    return apply_merges(p, "owner", auto.unionByName(worse)).select("p_partkey", "owner")


@query("""SELECT 'parts' AS loader, (SELECT count(*) FROM part) AS rows_in, (SELECT count(*) FROM part WHERE p_size > 10) AS rows_out, (SELECT count(*) FROM part WHERE p_size > 10 AND p_brand = 'Brand#2') AS matched,
(SELECT count(*) FROM part) - (SELECT count(*) FROM part WHERE p_size > 10 AND p_brand = 'Brand#2') AS unmatched""")
def load_log(s, d):
    p = t(s, d, "part").select("p_size", "p_brand")
    out = p.filter("p_size > 10")
    return lineage.load_log("parts", p, out, out.filter("p_brand = 'Brand#2'"))


@query("""SELECT event_type AS loader, arg_max(value, event_id) AS rate, max(event_id) AS run FROM events GROUP BY 1""")
def join_report(s, d):
    """The newest log row of each loader."""
    log = t(s, d, "events").select(F.col("event_type").alias("loader"), F.col("value").alias("rate"), F.col("event_id").alias("run"))
    return lineage.newest_log(log, "run")


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN s_name ELSE coalesce(c_name, s_name) END AS name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def guarded_upsert(s, d):
    """Curated rows (a balance below zero) are immune; the others take the new name; new ids come in."""
    old = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("auto"))
    new = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("auto"))
    return R.guarded_upsert(old, new, ["id"], F.col("auto")).select("id", "name")


@query("""WITH b AS (SELECT event_id, event_id // 20 AS batch, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events),
n AS (SELECT batch FROM (SELECT event_id // 20 AS batch FROM events UNION ALL SELECT event_id // 20 FROM events WHERE (event_id // 20) % 3 = 0 AND event_id % 20 < 10) GROUP BY 1 HAVING count(*) <= 25)
SELECT event_id, event_type, 'p_k=' || k AS properties FROM b WHERE event_type IN ('click', 'purchase') AND user_id % 10 <> 0 AND batch IN (SELECT batch FROM n)""")
def events_valid(s, d):
    """Batches over 25 events, unknown names and missing sessions are refused; simple properties get a prefix."""
    session = F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    e = t(s, d, "events").select("event_id", F.floor(F.col("event_id") / 20).alias("batch"), F.col("event_type").alias("event"), session.alias("session"), F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "deep": {"x": 1}}')).alias("properties"))
    again = e.filter("batch % 3 = 0 AND event_id % 20 < 10").withColumn("event", F.lit("other"))
    ok = feeds.valid_events(e.unionByName(again), ["click", "purchase"])
    listed = F.array_join(F.transform(F.map_entries("properties"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return ok.select("event_id", F.col("event").alias("event_type"), listed.alias("properties"))


@query("""SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS failed, round(count(*) FILTER (WHERE value > 20) / count(*), 4) AS rate FROM events GROUP BY 1, 2""")
def timeout_windows(s, d):
    return feeds.failure_windows(t(s, d, "events"), "ts", F.col("value") > 20, ["event_type"])


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY user_id, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS month_n FROM d)
SELECT *, n > 3 OR month_n > 40 AS over FROM m""")
def quota_usage(s, d):
    return feeds.quota_usage(t(s, d, "events"), "user_id", "ts", 3, 40)


@query("""SELECT days, event_type, count(*) AS n FROM events, (VALUES (1), (7), (30)) v(days) WHERE date_diff('day', ts::DATE, DATE '2024-01-30') BETWEEN 0 AND days - 1 GROUP BY 1, 2""")
def window_snapshot_days(s, d):
    """Counts over the last 1, 7 and 30 days of the month."""
    e = t(s, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    return feeds.window_counts(e, "day", "event_type", "2024-01-30", [1, 7, 30])


_NEAREST = "list_sort(list(ms))[greatest(ceil({p} * count(*))::BIGINT, 1)]"


@query(f"""WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/v1/' || event_type || '/:id' AS route, round(value * 10)::BIGINT AS ms, user_id FROM events WHERE event_id % 7 <> 0)
SELECT method, route, count(*) AS n, {_NEAREST.format(p='0.5')} AS p50, {_NEAREST.format(p='0.95')} AS p95, {_NEAREST.format(p='0.99')} AS p99, max(ms) AS max, round({_NEAREST.format(p='0.95')} * sqrt(count(*)))::BIGINT AS impact FROM l GROUP BY 1, 2""")
def query_shapes(s, d):
    """Log lines (plain, wrapped in a message, and noise) to routes, nearest-rank percentiles and impact."""
    e = t(s, d, "events")
    method = F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET")
    url = F.concat(F.lit("/v1/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("?q=1"))
    ms = F.round(F.col("value") * 10)
    plain = F.to_json(F.struct(F.struct(method.alias("method"), url.alias("url")).alias("req"), F.struct(F.lit(200).alias("statusCode")).alias("res"), ms.alias("responseTime")))
    wrapped = F.to_json(F.struct(F.to_json(F.struct(method.alias("method"), url.alias("reqUrl"), ms.alias("elapsed_ms"))).alias("message")))
    value = F.when(F.col("event_id") % 7 == 0, "noise").when(F.col("event_id") % 2 == 0, plain).otherwise(wrapped)
    entries = feeds.log_entries(e.select(value.alias("value")))
    p = feeds.percentiles(entries, ["method", "route"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.withColumn("impact", F.round(F.col("p95") * F.sqrt("n")).cast("long"))


@query("""SELECT 'event_type' AS path, count(*) AS rows, count(event_type) AS present, 1 AS least, 1 AS most, 1.0 AS non_empty, min(event_type) AS sample FROM events
UNION ALL SELECT 'inner.k', count(*), count(*), 1, 1, 1.0, min(json_extract_string(props, '$.k')) FROM events
UNION ALL SELECT 'tags[].name', count(*), count(*) FILTER (WHERE user_id % 3 > 0), 0, 2, round(sum(CASE WHEN user_id % 3 = 2 THEN 1 WHEN user_id % 3 = 1 THEN 1 ELSE 0 END) / sum(user_id % 3), 4), min(CASE WHEN user_id % 3 > 0 THEN CASE WHEN user_id % 3 = 2 THEN '' ELSE 'a' END END) FROM events""")
def profile_fields(s, d):
    """Presence, occurrences and non-empty share of every path of nested rows, in one pass."""
    tag = lambda x: F.struct(F.lit(x).alias("name"))
    tags = F.when(F.col("user_id") % 3 == 2, F.array(tag("b"), tag(""))).when(F.col("user_id") % 3 == 1, F.array(tag("a"))).otherwise(F.array().cast("array<struct<name:string>>"))
    rows = t(s, d, "events").select("event_type", F.from_json("props", "k long").alias("inner"), tags.alias("tags"))
    return B.profile(rows)


@query("""WITH c AS (SELECT c_custkey AS id, 'Q' || c_custkey AS q, c_name, c_nationkey, c_mktsegment, 1950 + c_custkey % 50 AS y, c_custkey % 4 AS k FROM customer)
SELECT id, 'bio' AS context_type, CASE WHEN k = 1 THEN 'genre_qids=Q1,Q2;' WHEN k = 2 THEN 'genre_qids=Q1;' ELSE '' END || 'name=' || c_name || CASE WHEN k = 3 THEN ';summary=a ' || c_mktsegment ELSE '' END AS content, q AS source_id, 0.85::DOUBLE AS confidence, 'wikidata:artist:' || id || ':bio' AS context_key FROM c WHERE k > 0
UNION ALL SELECT id, 'location', 'location_of_formation_qid=Q' || c_nationkey, q, 0.85::DOUBLE, 'wikidata:artist:' || id || ':location' FROM c WHERE k = 2
UNION ALL SELECT id, 'timeline_note', 'formed=' || CASE WHEN k = 1 THEN y::VARCHAR ELSE y || '-03-09' END, q, 0.85::DOUBLE, 'wikidata:artist:' || id || ':timeline_note' FROM c WHERE k < 3""")
def context_rows(s, d):
    """Statements of external entities to bio, location and timeline rows."""
    k = F.col("c_custkey") % 4
    snak = lambda v: F.array(F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak")))
    ids = lambda *q: F.array(*[F.struct(F.struct(F.struct(F.struct(F.lit(x).alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")) for x in q])
    time = F.concat(F.lit("+"), (F.lit(1950) + F.col("c_custkey") % 50).cast("string"), F.lit("-03-09T00:00:00Z"))
    formed = snak(F.struct(time.alias("time"), F.when(k == 1, 9).otherwise(11).alias("precision")))
    claims = F.struct(F.when(k == 1, ids("Q1", "Q2")).when(k == 2, ids("Q1")).alias("P136"), F.when(k == 2, snak(F.struct(F.concat(F.lit("Q"), F.col("c_nationkey").cast("string")).alias("id")))).alias("P740"), F.when(k < 3, formed).alias("P571"))
    en = lambda v, c: F.when(c, F.struct(F.struct(v.alias("value")).alias("en")))
    body = F.to_json(F.struct(en(F.col("c_name"), k > 0).alias("labels"), en(F.concat(F.lit("a "), "c_mktsegment"), k == 3).alias("descriptions"), claims.alias("claims")))
    rows = feeds.context_rows(t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), body.alias("json")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("content"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";")
    return rows.withColumn("content", listed)


@query("""SELECT s_suppkey AS artist_id, strftime(DATE '2020-01-01' + (s_suppkey % 28)::INT, '%Y-%m-%d') AS event_date, s_name AS venue_name, 'City ' || s_nationkey AS city_name, 'C' || s_nationkey AS country_code, s_nationkey / 2.0 AS latitude, CASE WHEN s_suppkey % 2 = 0 THEN 'Tour' END AS tour_name, (s_suppkey % 3) + 2 AS song_count, 'e' || s_suppkey AS setlist_id FROM supplier WHERE s_suppkey % 5 > 0""")
def event_rows(s, d):
    """Set lists to event rows: day-month-year dates, songs over all sets; those without an address are left out."""
    p, n = t(s, d, "supplier"), F.col("s_suppkey")
    song = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(i.cast("string").alias("name")))
    sets = F.struct(F.array(F.struct(F.when(n % 3 > 0, song(F.greatest((n % 3).cast("int"), F.lit(1)))).alias("song")), F.struct(song(F.lit(2)).alias("song"))).alias("set"))
    nation = F.col("s_nationkey").cast("string")
    city = F.struct(F.concat(F.lit("City "), nation).alias("name"), F.struct((F.col("s_nationkey") / 2).alias("lat")).alias("coords"), F.struct(F.concat(F.lit("C"), nation).alias("code")).alias("country"))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (n % 28).cast("int")), "dd-MM-yyyy")
    body = F.to_json(F.struct(F.concat(F.lit("e"), n.cast("string")).alias("id"), F.when(n % 5 > 0, "http://x").alias("url"), day.alias("eventDate"), F.when(n % 2 == 0, F.struct(F.lit("Tour").alias("name"))).alias("tour"), F.struct(F.col("s_name").alias("name"), city.alias("city")).alias("venue"), sets.alias("sets")))
    return feeds.setlist_events(p.select(n.alias("artist_id"), body.alias("json")))


@query("""SELECT s_suppkey AS label, 'bandcamp' AS provider, 'https://label' || s_suppkey || '.bandcamp.com' AS url FROM supplier
UNION ALL SELECT s_suppkey, 'instagram', 'https://instagram.com/' || CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'label' || s_suppkey END FROM supplier""")
def label_linkouts(s, d):
    """The surest, then shortest account of each label and provider among its links."""
    n = F.col("s_suppkey").cast("string")
    made = F.array(F.concat(F.lit("https://label"), n, F.lit(".bandcamp.com/album/x")), F.concat(F.lit("https://www.instagram.com/label"), n, F.lit("/")), F.lit("https://instagram.com/p/abc"), F.when(F.col("s_suppkey") % 2 == 0, "http://instagram.com/A").otherwise("http://example.org"))
    urls = t(s, d, "supplier").select(F.col("s_suppkey").alias("label"), F.explode(made).alias("url"))
    return feeds.best_linkouts(urls, "label").select("label", "provider", "url")


@query("""SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_counts(s, d):
    """The events as a stream: counters of each micro-batch merged below a shared folder, read back as totals."""
    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    keys = ["event_type", "user_id"]
    count_into(events, f"{at}/counts", f"{at}/checkpoint", keys, {"n": F.lit(1), "total": F.col("value")}).awaitTermination()
    return read_counts(s, f"{at}/counts", keys).select(*keys, "n", F.round("total", 4).alias("total"))
