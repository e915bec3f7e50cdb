"""Named queries of the scope build, credit graph, search and resolution, with SQL oracles; stand-ins as in catalog.py.

Here a master is in scope if its status is F; weight is the master's price; a supplier below zero balance is a curated label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C, text as T
from ..operators import relational as R
from ..sources.io import read_table as t
from .catalog import query


def _credits(s, d) -> DataFrame:
    """Credits with the master's artist: one shuffled join on the master, columns pruned at the scan."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.col("o_custkey").alias("artist"), F.col("o_totalprice").alias("weight"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("master"), F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("role"))
    return R.dealt(li, "master").join(o, "master")


_CREDITS = "c AS (SELECT l_orderkey AS master, l_suppkey AS label, l_partkey AS part, l_linenumber AS line, l_returnflag AS role, o_custkey AS artist, o_totalprice AS weight, year(o_orderdate) AS year, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {_CREDITS}, m AS (SELECT DISTINCT label, master, weight, year FROM c)
SELECT label, master, weight, year, row_number() OVER (PARTITION BY label ORDER BY weight DESC NULLS LAST, year, master) AS place FROM m
QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC NULLS LAST, year, master) <= 20""")
def label_spine_weight(s, d):
    m = _credits(s, d).select("label", "master", "weight", "year").distinct()
    return R.top_n(m, ["label"], [F.desc_nulls_last("weight"), F.asc("year"), F.asc("master")], 20, "place")


@query(f"""WITH {_CREDITS}, m AS (SELECT DISTINCT label, master, year FROM c)
SELECT label, master, year FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY year NULLS LAST, master) <= 20""")
def label_spine_chronological(s, d):
    m = _credits(s, d).select("label", "master", "year").distinct()
    return R.top_n(m, ["label"], [F.asc_nulls_last("year"), F.asc("master")], 20).drop("rank")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber <> 1, year(l_shipdate), l_linenumber, l_suppkey, l_partkey) AS place FROM lineitem""")
def notable_versions(s, d):
    """Versions of each master: the main one first, then by year and number."""
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") != 1, F.year("l_shipdate"), "l_linenumber", "l_suppkey", "l_partkey")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.row_number().over(w).alias("place"))


@query(f"""WITH {_CREDITS}, known AS (SELECT DISTINCT part FROM c WHERE status = 'F')
SELECT part, master, min(year) AS year, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM c WHERE status <> 'F' AND part IN (SELECT part FROM known) GROUP BY 1, 2""")
def cross_scope_credits(s, d):
    """Credits of in-scope artists on masters out of scope, one row for each pair."""
    c = _credits(s, d)
    known = c.filter("status = 'F'").select("part").distinct()
    out = c.filter("status <> 'F'").join(known, "part", "left_semi")
    return out.groupBy("part", "master").agg(F.min("year").alias("year"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


@query("""SELECT l_orderkey, l_suppkey, l_returnflag, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3""")
def master_credits_dedup(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.min("l_linenumber").alias("line"))


@query(f"""WITH {_CREDITS}, g AS (SELECT label, part, role, count(*) AS n FROM c GROUP BY 1, 2, 3),
r AS (SELECT label, part, sum(n)::BIGINT AS n_credits, string_agg(role, ',' ORDER BY n DESC, role) AS roles FROM g GROUP BY 1, 2)
SELECT label, part, n_credits, roles FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY n_credits DESC, part) <= 5""")
def label_top_credits(s, d):
    """The five most credited artists of each label, their roles by frequency, then name."""
    g = _credits(s, d).groupBy("label", "part", "role").agg(F.count("*").alias("n"))
    ranked = g.groupBy("label", "part").agg(F.sum("n").alias("n_credits"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "role"))).alias("r"))
    top = R.top_n(ranked, ["label"], [F.desc("n_credits"), F.asc("part")], 5)
    return top.select("label", "part", "n_credits", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@query(f"""WITH {_CREDITS}, m AS (SELECT artist, count(DISTINCT master) AS masters, min(year) AS first_year, max(year) AS last_year, max(weight) AS top FROM c GROUP BY 1),
f AS (SELECT artist, role, count(DISTINCT master) AS n FROM c GROUP BY 1, 2), l AS (SELECT artist, string_agg(role || ':' || n, ',' ORDER BY role) AS families FROM f GROUP BY 1)
SELECT m.*, families FROM m JOIN l USING (artist)""")
def artist_identity_roles(s, d):
    """Masters, year range, top weight and masters by role family, in one pass over (artist, role, master)."""
    c = _credits(s, d).groupBy("artist", "role", "master").agg(F.max("year").alias("year"), F.max("weight").alias("weight"))
    f = c.groupBy("artist", "role").agg(F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.max("weight").alias("w"))
    fam = f.groupBy("artist").agg(F.min("y0").alias("first_year"), F.max("y1").alias("last_year"), F.max("w").alias("top"), F.sort_array(F.collect_list(F.concat("role", F.lit(":"), "n"))).alias("fam"))
    n = c.select("artist", "master").distinct().groupBy("artist").agg(F.count("*").alias("masters"))
    return fam.join(n, "artist").select("artist", "masters", "first_year", "last_year", "top", F.array_join("fam", ",").alias("families"))


@query(f"""WITH {_CREDITS}, m AS (SELECT DISTINCT label, master, weight, year FROM c JOIN supplier ON label = s_suppkey WHERE s_acctbal >= 0)
SELECT label, master, row_number() OVER (PARTITION BY label ORDER BY weight DESC NULLS LAST, year, master) AS place FROM m
QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC NULLS LAST, year, master) <= 8""")
def core_run_auto(s, d):
    """The eight heaviest masters of each label that nobody curated."""
    curated = t(s, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("label"))
    m = _credits(s, d).select("label", "master", "weight", "year").distinct().join(curated, "label", "left_anti")
    return R.top_n(m, ["label"], [F.desc_nulls_last("weight"), F.asc("year"), F.asc("master")], 8, "place").select("label", "master", "place")


@query(f"""WITH {_CREDITS}, m AS (SELECT DISTINCT s_nationkey AS scene, label, master, weight, year FROM c JOIN supplier ON label = s_suppkey WHERE year IS NOT NULL),
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, year, master) <= 8)
SELECT scene, label, master, row_number() OVER (PARTITION BY scene ORDER BY weight DESC, label, master) AS place FROM p
QUALIFY row_number() OVER (PARTITION BY scene ORDER BY weight DESC, label, master) <= 50""")
def scene_playlist(s, d):
    """Up to eight masters a label, fifty a scene."""
    places = t(s, d, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_nationkey").alias("scene"))
    m = _credits(s, d).filter("year IS NOT NULL").select("label", "master", "weight", "year").distinct()
    p = R.top_n(m, ["label"], [F.desc("weight"), F.asc("year"), F.asc("master")], 8).join(places, "label")
    return R.top_n(p, ["scene"], [F.desc("weight"), F.asc("label"), F.asc("master")], 50, "place").select("scene", "label", "master", "place")


@query("""SELECT DISTINCT l_orderkey AS release FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'SMALL') AND year(l_shipdate) BETWEEN 1995 AND 2000""")
def scope_seed(s, d):
    """Releases of the listed styles within the window of years."""
    p = t(s, d, "part").filter(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("l_partkey"))
    li = t(s, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp")))
    return li.select("l_orderkey", "l_partkey").join(p, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("release")).distinct()


@query(f"""WITH {_CREDITS}, f AS (SELECT * FROM c WHERE status = 'F')
SELECT 'artist' AS kind, artist AS id FROM f UNION SELECT 'label', label FROM f UNION SELECT 'part', part FROM f""")
def scope_closure(s, d):
    """Every artist, label and part that a master in scope reaches."""
    c = _credits(s, d).filter("status = 'F'")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("artist", "label", "part")])
    return c.select(F.explode(pairs).alias("x")).select("x.*").distinct()


_WEIGHT = f"""{_CREDITS}, w AS (SELECT master, least(count(*), 5) + least(count(DISTINCT label), 3) + CASE WHEN bool_or(s_acctbal > 5000) THEN 10 ELSE 0 END
+ CASE WHEN max(year) IS NULL THEN 0 ELSE 1 END + CASE max(status) WHEN 'F' THEN 5 WHEN 'O' THEN 2 ELSE -5 END AS scene_weight FROM c LEFT JOIN supplier ON label = s_suppkey GROUP BY 1)"""


def _scene_weight(s, d) -> DataFrame:
    tier1 = t(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("label"), F.lit(True).alias("tier1"))
    per = _credits(s, d).groupBy("master", "label").agg(F.count("*").alias("n"), F.max("year").alias("year"), F.max("status").alias("status")).join(tier1, "label", "left")
    g = per.groupBy("master").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.coalesce("tier1", F.lit(False))).alias("tier1"), F.max("year").alias("year"), F.max("status").alias("status"))
    bucket = F.when(F.col("status") == "F", 5).when(F.col("status") == "O", 2).otherwise(-5)
    points = F.least("n", F.lit(5)) + F.least("labels", F.lit(3)) + F.when(F.col("tier1"), 10).otherwise(0) + F.when(F.col("year").isNull(), 0).otherwise(1) + bucket
    return g.select("master", points.cast("long").alias("scene_weight"))


@query(f"WITH {_WEIGHT} SELECT master, scene_weight::BIGINT AS scene_weight FROM w")
def scene_weight(s, d):
    """Additive weight: releases, labels, first-tier label, known year, quality bucket."""
    return _scene_weight(s, d)


@query(f"WITH {_WEIGHT} SELECT threshold::BIGINT AS threshold, count(*) FILTER (WHERE scene_weight >= threshold) AS kept FROM w, (VALUES (0), (5), (10), (15), (20)) v(threshold) GROUP BY 1")
def kept_at_threshold(s, d):
    """Counts by weight first, a handful of rows; only those meet the thresholds."""
    n = _scene_weight(s, d).groupBy("scene_weight").agg(F.count("*").alias("n"))
    at = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 5, 10, 15, 20)]))
    return n.select(at.alias("threshold"), "scene_weight", "n").groupBy("threshold").agg(F.sum(F.when(F.col("scene_weight") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("kept"))


@query(f"""WITH {_CREDITS} SELECT master, min(artist) AS artist, arg_min(label, line * 1000000 + label) AS primary_label, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS styles, max(weight) AS weight
FROM c JOIN part ON part = p_partkey GROUP BY 1""")
def master_denorm(s, d):
    """One wide row per master: its artist, first label, styles and weight."""
    style = t(s, d, "part").select(F.col("p_partkey").alias("part"), "p_type")
    g = _credits(s, d).join(style, "part").groupBy("master").agg(F.min("artist").alias("artist"), F.min(F.struct("line", "label")).alias("x"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("styles"), F.max("weight").alias("weight"))
    return g.select("master", "artist", F.col("x.label").alias("primary_label"), "styles", "weight")


@query("""SELECT user_id, event_id, ts, event_type, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def timeline(s, d):
    """The twenty latest events of each user and the user's total, counted apart so that the window may prune."""
    e = t(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    total = e.groupBy("user_id").agg(F.count("*").alias("total"))
    return R.top_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).drop("rank").join(total, "user_id").select("user_id", "event_id", "ts", "event_type", "total")


@query(f"""WITH {_CREDITS}, e AS (SELECT DISTINCT artist, label FROM c), a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY artist ORDER BY label) = 1)
SELECT artist, label FROM a QUALIFY row_number() OVER (PARTITION BY label ORDER BY artist) = 1""")
def crosswalk_first_wins(s, d):
    """The first external id of each artist, then the first artist of each id: two partial minima."""
    first = _credits(s, d).groupBy("artist").agg(F.min("label").alias("label"))
    return first.groupBy("label").agg(F.min("artist").alias("artist")).select("artist", "label")


@query("""SELECT DISTINCT prefix, p_name FROM part JOIN (SELECT DISTINCT substr(p_name, 1, 2) AS prefix FROM part WHERE p_partkey % 20 = 0) ON starts_with(p_name, prefix) OR contains(p_name, ' ' || prefix)""")
def typeahead_prefix(s, d):
    """The names with a word that begins as every twentieth name does: an equi-join on the words' beginnings."""
    p = t(s, d, "part").select("p_partkey", "p_name")
    asked = p.filter("p_partkey % 20 = 0").select(F.substring("p_name", 1, 2).alias("prefix")).distinct()
    begins = F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 2))
    return p.select("p_name").distinct().select("p_name", F.explode(F.array_distinct(begins)).alias("prefix")).join(asked, "prefix").select("prefix", "p_name")


@query("""SELECT lang, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def quality_distribution(s, d):
    j = t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("n", F.lit(1))
    return R.share_of_total(j, ["lang", "quality"], "n", ["lang"], "share")


@query("""SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(text) > 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.5 * length(text) AS garbled, len(string_split(text, chr(10))) AS lines FROM documents""")
def doc_sections(s, d):
    """Lengths, lines, and whether less than half of a text is letters."""
    x = t(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("letters"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return x.select("doc_id", "chars", "letters", ((F.col("chars") > 0) & (F.col("letters") < 0.5 * F.col("chars"))).alias("garbled"), "lines")


@query("""SELECT ts::DATE AS day, count(*) AS searches, count(*) FILTER (WHERE event_type = 'error') AS zero, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS zero_rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def search_quality_daily(s, d):
    g = t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), F.count_if(F.col("event_type") == "error").alias("zero"), F.count_distinct("user_id").alias("users"))
    return g.select("day", "searches", "zero", F.round(F.col("zero") / F.col("searches"), 4).alias("zero_rate"), "users")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS top FROM events GROUP BY 1, 2""")
def window_snapshot(s, d):
    g = t(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("top"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "mean", "top")


@query("""SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks FROM events GROUP BY 1""")
def counter_merge(s, d):
    """Counters of two halves of the month add up to those of the whole."""
    e = t(s, d, "events").withColumn("early", F.dayofmonth("ts") <= 15)
    half = lambda c: e.filter(c).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return R.counter_merge([half(F.col("early")), half(~F.col("early"))], ["user_id"], ["n", "clicks"])


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def upsert_keep_if_null(s, d):
    """Suppliers upserted into customers: what a row has stays, what it lacks is filled."""
    old = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    new = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return R.upsert_keep_if_null(old, new, ["id"], first_wins=True)


@query(" UNION ALL ".join(f"SELECT '{x}' AS col, count(*) AS n, count(*) - count({x}) AS nulls, approx.n AS values FROM documents, (SELECT count(DISTINCT {x}) AS n FROM documents) approx GROUP BY approx.n" for x in ("text", "lang", "source")))
def qa_null_rates(s, d):
    """Rows, nulls and distinct values of each column; the columns are told apart in one scan."""
    docs = t(s, d, "documents").select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.xxhash64(c).alias("h"), F.col(c).isNull().alias("gone")) for c in ("text", "lang", "source")])).alias("x")).select("x.*")
    g = docs.groupBy("col", "h", "gone").agg(F.count("*").alias("k"))
    return g.groupBy("col").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("gone"), F.col("k")).otherwise(0)).alias("nulls"), F.count_if(~F.col("gone")).alias("values"))


@query(r"""SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, sum(len(regexp_extract_all(text, '\?')))::BIGINT AS questions, sum(len(regexp_extract_all(text, 'https?://[^\s]+')))::BIGINT AS links FROM conversations GROUP BY 1""")
def citation_extract(s, d):
    """Questions and cited links of each conversation."""
    n = lambda p: F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), n(r"\?").alias("questions"), n(r"https?://[^\s]+").alias("links"))


@query("""WITH b AS (SELECT item_id, array_to_string(string_split(trim(text), ' ')[1:3], ' ') AS phrase FROM benchmark), p AS (SELECT phrase, min(item_id) AS item_id FROM b WHERE len(string_split(phrase, ' ')) = 3 GROUP BY 1)
SELECT doc_id, phrase, item_id FROM documents JOIN p ON contains(' ' || text || ' ', ' ' || phrase || ' ')""")
def phrase_named_in(s, d):
    """Three-word phrases that occur whole in a text: an equi-join on the text's own word triples, not a containment join."""
    b = t(s, d, "benchmark").select("item_id", F.slice(F.split(F.trim("text"), " "), 1, 3).alias("w")).filter(F.size("w") == 3)
    p = b.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min("item_id").alias("item_id"))
    w = F.split("text", " ")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " ")))
    docs = t(s, d, "documents").select("doc_id", w.alias("w")).filter(F.size("w") >= 3).select("doc_id", F.explode(grams).alias("phrase"))
    return docs.join(p, "phrase").select("doc_id", "phrase", "item_id")
