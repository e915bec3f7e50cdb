"""Further contracts of the catalog's operators, whole: rosters, primary labels, weights, gates, versions, documents; oracles as ever."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C, links as L, text as T
from ..operators import taste as TA
from ..operators import build as B, geo as G, relational as R, resolve as V, search as S
from ..sources.io import read_table as t
from .build import _RELEASES, _releases
from .catalog import query


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS label, o_custkey AS artist, l_orderkey AS master, year(o_orderdate) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT label, artist, count(*) AS masters, min(year) AS first_year, max(year) AS last_year FROM m GROUP BY 1, 2), n AS (SELECT label, count(*) AS total FROM g GROUP BY 1),
p AS (SELECT g.*, total, row_number() OVER (PARTITION BY g.label ORDER BY masters DESC, first_year NULLS LAST, c_name) AS place FROM g JOIN n ON n.label = g.label JOIN customer ON c_custkey = artist)
SELECT label, artist, masters, first_year, last_year, place, CASE WHEN total > 20 THEN -1 ELSE total END AS total FROM p WHERE place <= 20""")
def label_roster_years(s, d):
    """The twenty artists with most masters on each label, with their years; the total is -1 where the list is cut."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist"), F.year("o_orderdate").alias("year"))
    m = R.dealt(t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("label")), "l_orderkey").distinct().join(o, "l_orderkey")
    g = m.groupBy("label", "artist").agg(F.count("*").alias("masters"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    total = g.groupBy("label").agg(F.count("*").alias("total"))
    named = g.join(t(s, d, "customer").select(F.col("c_custkey").alias("artist"), "c_name"), "artist")
    top = R.top_n(named, ["label"], [F.desc("masters"), F.asc_nulls_last("first_year"), F.asc("c_name")], 20, "place").join(total, "label")
    return top.select("label", "artist", "masters", "first_year", "last_year", F.col("place").cast("long").alias("place"), F.when(F.col("total") > 20, -1).otherwise(F.col("total")).alias("total"))


@query("""WITH m AS (SELECT o_custkey AS artist, l_suppkey AS label, count(DISTINCT l_orderkey) AS masters FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT artist, label, s_name AS name, masters, row_number() OVER (PARTITION BY artist ORDER BY masters DESC, s_name) AS place FROM m JOIN supplier ON label = s_suppkey QUALIFY row_number() OVER (PARTITION BY artist ORDER BY masters DESC, s_name) <= 5""")
def primary_labels_ranked(s, d):
    """The five labels with most distinct masters of each artist, by count, then name."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist"))
    pairs = t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("label")).distinct()  # a master has one artist
    n = pairs.join(o, "l_orderkey").groupBy("artist", "label").agg(F.count("*").alias("masters"))
    named = n.join(t(s, d, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_name").alias("name")), "label")
    return R.top_n(named, ["artist"], [F.desc("masters"), F.asc("name")], 5, "place").select("artist", "label", "name", "masters", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT l_suppkey AS label, l_partkey AS artist, l_orderkey AS master, l_returnflag || l_linestatus AS role FROM lineitem), n AS (SELECT label, artist, count(DISTINCT master) AS masters, count(*) AS credits FROM c GROUP BY 1, 2),
r AS (SELECT label, artist, role, row_number() OVER (PARTITION BY label, artist ORDER BY count(*) DESC, role) AS rn FROM c GROUP BY 1, 2, 3), l AS (SELECT label, artist, string_agg(role, ',' ORDER BY rn) AS roles FROM r WHERE rn <= 5 GROUP BY 1, 2),
p AS (SELECT n.*, row_number() OVER (PARTITION BY label ORDER BY masters DESC, credits DESC, artist) AS place FROM n) SELECT p.label, p.artist, masters, credits, roles FROM p JOIN l ON l.label = p.label AND l.artist = p.artist WHERE place <= 10""")
def label_credits_ranked(s, d):
    """The ten artists credited on most masters of each label, with their five most frequent roles."""
    c = t(s, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("artist"), F.col("l_orderkey").alias("master"), F.concat("l_returnflag", "l_linestatus").alias("role"))
    per = c.groupBy("label", "artist", "master", "role").agg(F.count("*").alias("k"))
    n = per.groupBy("label", "artist", "master").agg(F.sum("k").alias("k")).groupBy("label", "artist").agg(F.count("*").alias("masters"), F.sum("k").alias("credits"))
    top = R.top_n(n, ["label"], [F.desc("masters"), F.desc("credits"), F.asc("artist")], 10, "place").drop("place")
    roles = per.groupBy("label", "artist", "role").agg((-F.sum("k")).alias("n")).groupBy("label", "artist").agg(F.sort_array(F.collect_list(F.struct("n", "role"))).alias("r"))
    return top.join(roles, ["label", "artist"]).select("label", "artist", "masters", "credits", F.array_join(F.transform(F.slice("r", 1, 5), lambda x: x["role"]), ",").alias("roles"))


@query(f"""WITH {_RELEASES}, y AS (SELECT o_orderkey AS master, year(o_orderdate) AS my FROM orders)
SELECT release FROM (SELECT release, r.master, CASE WHEN release % 4 > 0 THEN year END AS year FROM r) x LEFT JOIN y ON y.master = x.master WHERE coalesce(year, my) BETWEEN 1995 AND 1998""")
def scope_window(s, d):
    """Releases whose own year, or else their master's, lies in the window."""
    r = _releases(s, d).select("release", "master", F.when(F.col("release") % 4 > 0, F.col("year")).alias("year"))
    y = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.year("o_orderdate").alias("my"))
    return r.join(y, "master", "left").filter(F.coalesce("year", "my").between(1995, 1998)).select("release")


@query(f"""WITH {_RELEASES}, b AS (SELECT o_orderkey AS master, CASE o_orderpriority WHEN '1-URGENT' THEN 'Correct' WHEN '2-HIGH' THEN 'Needs Vote' WHEN '3-MEDIUM' THEN 'Entirely Incorrect' ELSE 'Unknown' END AS q, o_orderkey % 9 > 0 AS known, o_custkey % 5 > 0 AS named FROM orders),
g AS (SELECT master, least(count(*), 5) + least(count(DISTINCT country), 3) + CASE WHEN bool_or(l_quantity > 45) THEN 3 ELSE 0 END + CASE WHEN bool_or(s_acctbal > 5000) THEN 10 ELSE 0 END AS pts FROM r JOIN supplier ON l_suppkey = s_suppkey WHERE master IS NOT NULL GROUP BY 1)
SELECT b.master, CASE q WHEN 'Correct' THEN 5 WHEN 'Needs Vote' THEN 2 WHEN 'Entirely Incorrect' THEN -5 ELSE 0 END + coalesce(pts, 0) + CASE WHEN b.master % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN named THEN 2 ELSE 0 END + CASE WHEN known THEN 1 ELSE 0 END AS scene_weight FROM b LEFT JOIN g ON g.master = b.master""")
def scene_weight_full(s, d):
    """All eight parts of the weight: quality, releases, countries, both kinds of video, first-tier label, named artist, known year."""
    p = F.col("o_orderpriority")
    o = t(s, d, "orders").select(
        F.col("o_orderkey").alias("master"), F.when(p == "1-URGENT", "Correct").when(p == "2-HIGH", "Needs Vote").when(p == "3-MEDIUM", "Entirely Incorrect").otherwise("Unknown").alias("data_quality"),
        F.when(F.col("o_orderkey") % 9 > 0, 1999).alias("year"), F.when(F.col("o_custkey") % 5 > 0, "Ann").alias("artist"), (F.col("o_orderkey") % 3 == 0).alias("video"),
    )
    tier1 = t(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("tier1"))
    r = _releases(s, d).filter("master IS NOT NULL").withColumn("video", F.col("l_quantity") > 45).join(tier1, "l_suppkey", "left")
    return B.scene_weight(o, r)


@query("""WITH q AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'suppressed' WHEN 'MACHINERY' THEN 'low_value' ELSE CASE WHEN c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'low_value' ELSE 'active' END END AS status FROM customer)
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM q GROUP BY 1""")
def quality_classified(s, d):
    """The classifier over all artists, by status with shares."""
    seg = F.col("c_mktsegment")
    linked = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("linked")).distinct()
    data = F.when(seg == "BUILDING", "Entirely Incorrect").when(seg == "MACHINERY", "Needs Major Changes").otherwise("Needs Vote")
    c = t(s, d, "customer").select("c_custkey", "c_name", data.alias("q"), F.when(F.col("c_custkey") % 3 > 0, "a profile").alias("profile")).join(linked, "c_custkey", "left")
    said = C.quality(F.col("c_name"), F.col("q"), True, F.col("profile"), None, F.coalesce("linked", F.lit(False)))
    n = c.groupBy(said["status"].alias("status")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row a status


@query("""SELECT 'artists' AS cohort, c_custkey AS id FROM customer WHERE c_custkey % 3 > 0 AND length(trim(c_mktsegment)) > 8
UNION ALL SELECT 'releases', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' UNION ALL SELECT 'labels', s_suppkey FROM supplier WHERE s_name <> 'Supplier#000000001' AND s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def seo_cohort_filters(s, d):
    """Artists with a profile, masters that are active and have genres (fail closed), labels with a master and a real name."""
    artists = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("profile")).filter(F.length(F.trim("profile")) > 8)
    o = t(s, d, "orders")
    masters = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.array("o_orderpriority")).alias("genres")).filter(F.coalesce(F.size("genres"), F.lit(0)) > 0)
    masters = R.gate_fail_closed(masters, o.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id", F.col("o_orderstatus") == "F")
    used = t(s, d, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    labels = t(s, d, "supplier").filter(~F.col("s_name").isin("Supplier#000000001")).select(F.col("s_suppkey").alias("id")).join(used, "id", "left_semi")
    parts = {"artists": artists, "releases": masters, "labels": labels}
    return reduce(DataFrame.unionAll, [df.select(F.lit(k).alias("cohort"), F.col("id").cast("long").alias("id")) for k, df in parts.items()])


@query(f"""WITH {_RELEASES} SELECT o_orderkey AS master, o_orderpriority AS title, release AS main_release, country FROM orders LEFT JOIN (SELECT * FROM r WHERE is_main) m ON m.master = o_orderkey""")
def main_release_join(s, d):
    """Masters with their main pressing, joined on the id and the mark together; a master without one stays."""
    r = _releases(s, d).select("master", F.col("release").alias("main_release"), "country", "is_main")
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("title"))
    return o.join(r, (F.col("o") == F.col("master")) & F.col("is_main"), "left").select(F.col("o").alias("master"), "title", "main_release", "country")


@query("""WITH v AS (SELECT l_orderkey AS master, CASE WHEN l_linenumber % 2 = 0 THEN 'master' ELSE 'release' END AS source_type, l_linenumber * 1000000 + l_partkey AS id FROM lineitem)
SELECT master, source_type, id, row_number() OVER (PARTITION BY master ORDER BY source_type, id) AS place FROM v""")
def master_videos(s, d):
    """Videos of each master: its own before those of its releases, then by id."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "master").otherwise("release")
    v = t(s, d, "lineitem").select(F.col("l_orderkey").alias("master"), kind.alias("source_type"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("master").orderBy("source_type", "id")).cast("long"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || CASE WHEN user_id % 2 = 0 THEN '","user":"' || user_id ELSE '' END || '"}' AS merged, user_id % 2 = 0 AS has_user FROM events""")
def json_merge(s, d):
    """JSON objects merged key by key, nulls left out, and the test for a key."""
    more = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))), lambda k, v: v.isNotNull())
    both = F.map_concat(F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: v), more)
    k = F.concat(F.lit('{"k":'), both["k"], F.lit(","))
    rest = F.substring(F.to_json(F.map_filter(both, lambda key, v: key != "k")), 2, 1000)
    return t(s, d, "events").select("event_id", F.concat(k, rest).alias("merged"), F.map_contains_key(both, "user").alias("has_user"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, i - 1 AS i, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE starts_with(regexp_replace(lower(w[i]), '[^\p{L}\p{N}]+', '', 'g'), 'the')),
s AS (SELECT doc_id, greatest(0, least(min(i) - 12, any_value(n) - 25)) AS s FROM h GROUP BY doc_id, i // 60),
p AS (SELECT doc_id, 1 AS k, min(s) AS s FROM s GROUP BY 1 UNION ALL SELECT p.doc_id, k + 1, min(s.s) FROM p JOIN s ON s.doc_id = p.doc_id AND s.s >= p.s + 25 WHERE k < 3 GROUP BY 1, 2),
f AS (SELECT doc_id, string_agg(array_to_string(w[s + 1:s + 25], ' '), ' ... ' ORDER BY s) AS t FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(t, array_to_string(w[1:60], ' ')) AS headline FROM d LEFT JOIN f USING (doc_id)""")
def headline_hits(s, d):
    """Up to three fragments of 25 words around hits, of all texts; the first sixty words of a text without one."""
    docs = t(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return S.headline(docs, F.lit("the")).withColumnRenamed("id", "doc_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'garbled' WHEN event_id % 5 = 1 THEN 'short' WHEN event_id % 5 = 2 THEN 'cotes-de-bourg' ELSE 'cotes-de-bourg,bourg' END AS sections FROM events""")
def doc_split(s, d):
    """Bundles split at their headers: repeats of one header merged, short sections dropped, garbled texts refused."""
    k = F.col("event_id") % 5
    body = F.repeat(F.lit("Texte du cahier. "), 200)
    head = lambda n: F.concat(F.lit("\n Cahier des charges de l'appellation d'origine contrôlée « "), F.lit(n), F.lit(" »\n"))
    one = F.concat(head("Côtes de Bourg"), F.lit("x\n"), head("Côtes de Bourg"), body)
    text = F.when(k == 0, F.repeat(F.lit("#% 12 "), 500)).when(k == 1, F.concat(head("Bourg"), F.lit("too short " * 25))).when(k == 2, one).otherwise(F.concat(one, head("Bourg"), body))
    # the texts are long and the table is small, so its rows are dealt over all tasks before they are made
    events = t(s, d, "events").select("event_id").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    rows = V.split_sections(events.select("event_id", text.alias("text")), "event_id")
    named = rows.groupBy("event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "slug"))), lambda x: x["slug"]), ",").alias("sections"))
    out = events.select("event_id", V.garbled(text).alias("bad")).join(named, "event_id", "left")
    return out.select("event_id", F.when(F.col("bad"), "garbled").otherwise(F.coalesce("sections", F.lit("short"))).alias("sections"))


@query("""WITH x AS (SELECT user_id AS entity, event_id AS id, ts, value / 40 AS confidence FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY entity) AS total FROM x WHERE confidence >= 0.7)
SELECT entity, id, confidence, total FROM k QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, id DESC) <= 10""")
def timeline_gated(s, d):
    """Rows over the confidence gate, newest first, ten each with the total before the cut."""
    e = t(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("id"), "ts", (F.col("value") / 40).alias("confidence")).filter("confidence >= 0.7")
    total = e.groupBy("entity").agg(F.count("*").alias("total"))
    return R.top_n(e, ["entity"], [F.desc("ts"), F.desc("id")], 10, "place").join(total, "entity").select("entity", "id", "confidence", "total")


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS scene, l_suppkey AS label, o_orderkey AS master, o_totalprice AS weight, year(o_orderdate) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
v AS (SELECT l_orderkey AS master, min(l_linenumber) AS k FROM lineitem GROUP BY 1), p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, year, master) <= 8),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY scene ORDER BY weight DESC, label, master) <= 50)
SELECT scene, label, c.master, lpad(k::VARCHAR, 11, 'a') AS video FROM c JOIN v ON v.master = c.master WHERE k % 2 = 1""")
def playlist_videos(s, d):
    """Eight masters a label and fifty a scene, cut before those without a playable video are dropped."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.col("o_totalprice").alias("weight"), F.year("o_orderdate").alias("year"))
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("master"), F.col("l_suppkey").alias("label"), F.col("l_linenumber").alias("k"))
    places = t(s, d, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_nationkey").alias("scene"))
    m = li.select("master", "label").distinct().join(o, "master").filter("year IS NOT NULL")
    p = R.top_n(m, ["label"], [F.desc("weight"), F.asc("year"), F.asc("master")], 8).drop("rank").join(places, "label")
    c = R.top_n(p, ["scene"], [F.desc("weight"), F.asc("label"), F.asc("master")], 50).drop("rank")
    first = li.groupBy("master").agg(F.min("k").alias("k"))
    url = F.when(F.col("k") % 2 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(F.col("k").cast("string"), 11, "a"))).otherwise("https://vimeo.com/9")
    return c.join(first, "master").withColumn("video", L.video_id(url)).filter("video IS NOT NULL").select("scene", "label", "master", "video")


@query("""SELECT p_partkey AS key, min(k) AS id FROM (SELECT p_partkey, 'grand vin ' || p_name AS label FROM part), (SELECT min(p_partkey) AS k, p_name AS name FROM part GROUP BY 2) WHERE contains(' ' || label || ' ', ' ' || name || ' ') AND length(name) >= 8 GROUP BY 1""")
def contained_names(s, d):
    """Labels that hold a known name of eight characters or more whole, by an anchor join; the least id on a tie."""
    p = t(s, d, "part")
    labels = p.select(F.col("p_partkey").alias("key"), F.concat(F.lit("grand vin "), "p_name").alias("label"))
    known = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return V.contained(labels, known, 8)


@query("""WITH k AS (SELECT p_partkey AS id, p_name AS name, 'reserve ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' magnum' ELSE '' END AS dn, p_brand AS producer, p_type AS country, p_partkey % 3 > 0 AS live FROM part),
a AS (SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'reserve ' || p_name WHEN 2 THEN 'la grande ' || p_name ELSE p_name || ' DOC' END AS label,
CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS producer, CASE WHEN p_partkey % 7 > 0 THEN p_type END AS country FROM part),
q AS (SELECT *, ' ' || lower(label) || ' ' AS f FROM a WHERE NOT label LIKE '% DOC'),
p AS (SELECT key, CASE WHEN q.producer = k.producer AND lower(label) IN (name, dn) THEN 0
WHEN q.producer = k.producer AND (contains(' ' || name || ' ', f) OR contains(' ' || dn || ' ', f) OR contains(f, ' ' || name || ' ') OR contains(f, ' ' || dn || ' ')) THEN 1
WHEN (q.country IS NULL OR q.country = k.country) AND lower(label) IN (name, dn) THEN 2
WHEN (q.country IS NULL OR q.country = k.country) AND length(label) >= 10 AND (contains(' ' || name || ' ', f) OR contains(' ' || dn || ' ', f)) THEN 3 END AS stage, length(dn) AS n, NOT live AS dead, id FROM q, k),
c AS (SELECT key, stage, count(*) AS m, arg_min(id, (n, dead, id)) AS id FROM p WHERE stage IS NOT NULL GROUP BY 1, 2),
b AS (SELECT key, min(stage) AS stage FROM c GROUP BY 1)
SELECT key, CASE WHEN stage < 3 OR m <= 50 THEN c.id END AS id, CASE WHEN stage IS NULL THEN 'none' WHEN stage = 3 AND m > 50 THEN 'too_many' ELSE ['producer_exact', 'producer_contains', 'exact', 'contains'][stage + 1] END AS method FROM q LEFT JOIN b USING (key) LEFT JOIN c USING (key, stage)""")
def label_match(s, d):
    """Labels to items: of their producer by equal and contained names, else equal names, else names that hold the label."""
    p, n = t(s, d, "part"), F.col("p_partkey")
    reserve = F.concat(F.lit("reserve "), "p_name")
    known = p.select(n.alias("id"), F.col("p_name").alias("name"), F.concat(reserve, F.when(n % 5 == 0, " magnum").otherwise("")).alias("display_name"), F.col("p_brand").alias("producer"), F.col("p_type").alias("country"), (n % 3 > 0).alias("live"))
    label = F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 1, reserve).when(n % 4 == 2, F.concat(F.lit("La Grande "), "p_name")).otherwise(F.concat("p_name", F.lit(" DOC")))
    return V.label_match(p.select(n.alias("key"), label.alias("label"), F.when(n % 3 < 2, F.col("p_brand")).alias("producer"), F.when(n % 7 > 0, F.col("p_type")).alias("country")), known)


@query(r"""SELECT doc_id, regexp_replace(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '[^a-z0-9]+', '-', 'g') = '' AS empty, len(regexp_extract_all(text, 'https?://[^\s]+')) AS links FROM documents WHERE text IS NOT NULL""")
def document_links(s, d):
    """Links in each text, and whether its slug is empty (letters beyond ASCII that have a plain form count)."""
    docs = t(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", (T.slug(F.col("text")) == "").alias("empty"), F.size(F.regexp_extract_all("text", F.lit(r"https?://[^\s]+"), F.lit(0))).cast("long").alias("links"))


_LAEA = """k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f), e AS (SELECT a, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM k),
c AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, sin(radians(52)) AS s0 FROM e),
z AS (SELECT *, asin((1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) / qp) AS b0, a * sqrt(qp / 2) AS rq FROM c),
w AS (SELECT *, a * cos(radians(52)) / (sqrt(1 - e2 * s0 * s0) * rq * cos(b0)) AS d FROM z),
p AS (SELECT c_custkey, c_nationkey, radians(c_custkey % 40 - 10 - 10) AS dl, sin(radians(36 + c_nationkey + (c_custkey % 7) / 10.0)) AS s FROM customer),
q AS (SELECT p.*, w.*, asin((1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) / qp) AS beta FROM p, w),
r AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) AS b FROM q),
xy AS (SELECT c_custkey, c_nationkey, b * d * cos(beta) * sin(dl) AS x, b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)) AS y FROM r)"""


def _projected(s, d):
    lon, lat = F.col("c_custkey") % 40 - 10, F.lit(36) + F.col("c_nationkey") + (F.col("c_custkey") % 7) / 10
    return t(s, d, "customer").select("c_custkey", "c_nationkey", G.project(lon, lat, 10.0, 52.0).alias("p")).select("c_custkey", "c_nationkey", "p.x", "p.y")


@query(f"WITH {_LAEA} SELECT c_custkey, round(x, 2) AS x, round(y, 2) AS y FROM xy")
def map_points(s, d):
    """Places on the map: equal-area projection on the ellipsoid."""
    return _projected(s, d).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"""WITH {_LAEA}, bx AS (SELECT c_nationkey, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM xy GROUP BY 1)
SELECT a.c_nationkey AS c_nationkey_a, b.c_nationkey AS c_nationkey_b FROM bx a JOIN bx b ON a.c_nationkey < b.c_nationkey AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def map_overlaps(s, d):
    """Nations whose bounds overlap, by the grid cells that they cover."""
    return G.overlapping(G.bounds(_projected(s, d), "c_nationkey"), "c_nationkey", 100_000.0)


@query("""WITH p AS (SELECT s_suppkey AS shelf, s_name AS name FROM supplier), m AS (SELECT DISTINCT l_suppkey AS shelf, l_partkey AS member FROM lineitem),
n AS (SELECT shelf, count(*) AS members FROM m GROUP BY 1), r AS (SELECT m.shelf, p_name, row_number() OVER (PARTITION BY m.shelf ORDER BY p_size DESC, p_partkey) AS rn FROM m JOIN part ON member = p_partkey)
SELECT p.shelf, name, coalesce(members, 0) AS members, coalesce((SELECT string_agg(p_name, ',' ORDER BY rn) FROM r WHERE r.shelf = p.shelf AND rn <= 12), '') AS shown FROM p LEFT JOIN n ON n.shelf = p.shelf""")
def shelves(s, d):
    """Every shelf with the number of its members and its first twelve by weight."""
    m = t(s, d, "lineitem").select(F.col("l_suppkey").alias("shelf"), F.col("l_partkey").alias("p_partkey")).distinct()
    n = m.groupBy("shelf").agg(F.count("*").alias("members"))
    rows = R.top_n(m.join(t(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey"), ["shelf"], [F.desc("p_size"), F.asc("p_partkey")], 12, "rn")
    shown = rows.groupBy("shelf").agg(F.sort_array(F.collect_list(F.struct("rn", "p_name"))).alias("l"))
    core = t(s, d, "supplier").select(F.col("s_suppkey").alias("shelf"), F.col("s_name").alias("name"))
    out = core.join(n, "shelf", "left").join(shown, "shelf", "left")
    names = F.coalesce(F.array_join(F.transform("l", lambda x: x["p_name"]), ","), F.lit(""))
    return out.select("shelf", "name", F.coalesce("members", F.lit(0)).alias("members"), names.alias("shown"))


@query(r"""WITH p AS (SELECT p_partkey AS doc, p_partkey % 3 AS k, p_size % 2 = 0 AS even, 9 + p_size % 5 AS alc, p_partkey::VARCHAR AS n FROM part)
SELECT doc, ['fr', 'it', 'es'][k + 1] AS lang, 1::BIGINT AS place, CASE k WHEN 0 THEN CASE WHEN even THEN 'vins blancs' ELSE 'vins rouges' END WHEN 1 THEN 'Colle ' || n ELSE 'VINO NUMERO ' || n END AS style,
CASE k WHEN 0 THEN CASE WHEN even THEN 'vins blancs' ELSE 'vins rouges' END WHEN 1 THEN 'colle ' || n ELSE 'vino numero ' || n END AS style_key,
CASE WHEN k = 0 THEN CASE WHEN even THEN 'white' ELSE 'red' END WHEN even THEN 'red' ELSE 'white' END AS colour,
CASE k WHEN 0 THEN 'Les vins ' || CASE WHEN even THEN 'blancs' ELSE 'rouges' END || ' sont secs, au nez de fruits. Lot ' || n || '.' WHEN 1 THEN '- colore: ' || CASE WHEN even THEN 'rosso rubino' ELSE 'giallo dorato' END || ' e intenso;' || chr(10) || '- sapore: da secco a dolce;' || chr(10) || '- titolo alcolometrico volumico totale minimo: ' || alc || ',50% vol.'
ELSE 'Vista: ' || CASE WHEN even THEN 'rojo' ELSE 'amarillo' END || ' vivo.' || chr(10) || 'Boca: semiseco, lote ' || n || '.' END AS clause,
CASE k WHEN 0 THEN alc::DOUBLE WHEN 1 THEN alc + 0.5 END AS min_alcohol, CASE k WHEN 0 THEN 'dry' WHEN 1 THEN 'dry to sweet' ELSE 'off-dry' END AS sweetness FROM p""")
def taste_clauses(s, d):
    """A rule text for each part in one of three languages, made of its row: section, wrapped lines, label, colour, alcohol, sweetness."""
    p, n = t(s, d, "part"), F.col("p_partkey").cast("string")
    even, alc = F.col("p_size") % 2 == 0, (9 + F.col("p_size") % 5).cast("string")
    pick = lambda a, b: F.when(even, a).otherwise(b)
    fr = F.concat(F.lit("Titre\nSpécificité du produit\nLes vins "), pick("blancs", "rouges"), F.lit(" sont secs,\nau nez de fruits.\nVersion n° 2\nLot "), n, F.lit(".\n\nLien causal\nLe titre alcoométrique volumique naturel\nminimum de "), alc, F.lit(" %."))
    it = F.concat(F.lit("Articolo 6\n\nColle "), n, F.lit("\n- colore: "), pick("rosso rubino", "giallo dorato"), F.lit("\n  e intenso;\n\n- sapore: da secco a dolce;\n- titolo alcolometrico volumico totale minimo: "), alc, F.lit(",50% vol.\nArticolo 7"))
    es = F.concat(F.lit("Características organolépticas\nVINO NUMERO "), n, F.lit("\nVista: "), pick("rojo", "amarillo"), F.lit("\nvivo.\n17\nBoca: semiseco, lote "), n, F.lit(".\nDelimitación de la zona\nVista: fuera"))
    k = F.col("p_partkey") % 3
    lang = F.when(k == 0, "fr").when(k == 1, "it").otherwise("es")
    texts = p.select(F.col("p_partkey").alias("doc"), lang.alias("lang"), F.when(k == 0, fr).when(k == 1, it).otherwise(es).alias("text"))
    return TA.clauses(texts).withColumn("place", F.col("place").cast("long"))
