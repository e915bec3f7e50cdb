"""Entity detail, credit graph, scenes, playlists and corpus queries with SQL oracles; stand-ins as in catalog.py.

Persons are parts (credited on lineitem), masters are orders, labels are suppliers, master artists are customers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import graph as GR, entities as E, search as S
from ..operators.lineage import written
from ..operators.relational import dealt, dealt_join, shares, top_n
from ..sources.io import read_table as t
from .catalog import query


def _credits(s, d) -> DataFrame:
    return t(s, d, "lineitem").select(F.col("l_partkey").alias("artist_id"), F.col("l_orderkey").alias("master_id"), F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("label"), "l_linenumber", "l_linestatus")


@query("""WITH g AS (SELECT s_suppkey AS id, list_sort(list(p_name)) AS parts FROM (SELECT s_suppkey, p_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_name) AS rn FROM (SELECT DISTINCT l_suppkey AS s_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE rn <= 50 GROUP BY 1)
SELECT s.s_suppkey AS id, s.s_name AS name, n_name AS parent, coalesce(array_to_string(parts, ','), '') AS parts FROM supplier s LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN g ON g.id = s.s_suppkey""")
def entity_detail(s, d):
    """Every label with its parent's name and up to fifty children by name."""
    sup = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"))
    core = sup.join(t(s, d, "nation").select("n_nationkey", F.col("n_name").alias("parent")), "n_nationkey", "left").drop("n_nationkey")
    named = t(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = named.select("l_suppkey", "p_name").distinct()
    out = E.detail(core, {"parts": (rows, "l_suppkey", ["p_name"], 50)})
    return out.withColumn("parts", F.coalesce(F.array_join(F.transform("parts", lambda x: x["p_name"]), ","), F.lit("")))


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, c_nationkey FROM customer),
x AS (SELECT a.id, b.id AS other FROM a JOIN a b ON b.id = a.id // 2 AND a.id <> b.id UNION SELECT a.id, b.id FROM a JOIN a b ON b.id = a.id // 3 AND a.id <> b.id UNION ALL SELECT id, id FROM a)
SELECT DISTINCT id, other FROM x""")
def alias_expansion(s, d):
    """Each artist with itself and those whose name is among its aliases (here the names of a half and a third of its id)."""
    c = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    padded = lambda n: F.concat(F.lit("CUSTOMER#"), F.lpad(F.floor(F.col("id") / n).cast("string"), 9, "0"))
    return E.expand_aliases(c.withColumn("aliases", F.array(padded(2), padded(3))))


_TYPED = """m AS (SELECT o_orderkey AS id, year(o_orderdate) AS year, o_totalprice AS weight, k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'compilation' WHEN k >= 7 THEN 'album' WHEN k <= 4 THEN 'single_ep' ELSE 'other' END AS release_type
FROM orders JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _typed_masters(s, d) -> DataFrame:
    k = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("tracks"))
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "Greatest Hits").otherwise("Songs")
    o = t(s, d, "orders").join(k, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), title.alias("title"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("weight"), F.array(F.lit("CD 1")).alias("formats"), F.col("tracks").cast("int").alias("tracks"), F.lit("x").alias("artist"))


@query(f"""WITH {_TYPED}, al AS (SELECT DISTINCT l_partkey AS id FROM lineitem), e AS (SELECT id, id AS other FROM al UNION SELECT id, id // 2 FROM al),
c AS (SELECT e.id AS artist_id, l_orderkey AS mid, min(CASE WHEN e.other = e.id THEN 0 ELSE 1 END) AS o, arg_min(e.other, (CASE WHEN e.other = e.id THEN 0 ELSE 1 END)) AS credited_as FROM e JOIN lineitem ON l_partkey = e.other GROUP BY 1, 2),
r AS (SELECT artist_id, credited_as, m.id, year, release_type, row_number() OVER (PARTITION BY artist_id ORDER BY year DESC NULLS LAST, m.id) AS place FROM c JOIN m ON m.id = mid WHERE release_type = 'album')
SELECT * FROM r WHERE place <= 500""")
def artist_catalog(s, d):
    """Albums of every artist and its alias, newest first, each once and under its own name where it has one."""
    ids = t(s, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    aliases = ids.select("id", F.explode(F.array("id", F.floor(F.col("id") / 2))).alias("other")).distinct()
    out = E.artist_masters(_credits(s, d).select("artist_id", "master_id"), _typed_masters(s, d), aliases, "newest", "album")
    return out.select("artist_id", "credited_as", "id", "year", "release_type", F.col("place").cast("long").alias("place"))


@query("""WITH tr AS (SELECT l_partkey AS artist_id, l_orderkey AS master_id, l_returnflag AS role, 'A' || l_linenumber AS position FROM lineitem WHERE l_linestatus = 'F'),
rl AS (SELECT l_partkey AS artist_id, l_orderkey AS master_id, l_returnflag AS role, NULL AS position FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT * FROM tr UNION ALL SELECT * FROM rl)
SELECT artist_id, master_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, coalesce(array_to_string(list_sort(list_distinct(list(position) FILTER (WHERE position IS NOT NULL))), ','), '') AS tracks, bool_or(position IS NULL) AS has_release_level, any_value(year(o_orderdate)) AS year, any_value(o_totalprice) AS weight
FROM b JOIN orders ON o_orderkey = master_id WHERE role IN ('A', 'R') AND o_custkey <> artist_id GROUP BY 1, 2""")
def rule_a_credits(s, d):
    """Credits by artist and master with roles, track positions and a release-level flag; artists' own masters left out."""
    c = _credits(s, d).withColumn("position", F.concat(F.lit("A"), F.col("l_linenumber").cast("string")))
    masters = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("artist_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("weight"))
    return E.rule_a_credits(c.filter("l_linestatus = 'F'"), c.filter("l_linestatus = 'O'"), masters, ["A", "R"], skip_own=True)


_ASKED = "a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey % 20 = 0)"


@query(f"""WITH {_ASKED}, e AS (SELECT id, id AS other FROM a UNION SELECT id, id + 1 FROM a), own AS (SELECT DISTINCT e.id, l_orderkey AS m FROM e JOIN lineitem ON l_partkey = other),
met AS (SELECT own.id, l_partkey AS mate, m, l_returnflag AS role FROM own JOIN lineitem ON l_orderkey = m WHERE (own.id, l_partkey) NOT IN (SELECT id, other FROM e)),
n AS (SELECT id, mate, count(DISTINCT m) AS masters FROM met GROUP BY 1, 2), r AS (SELECT id, mate, role, count(*) AS k FROM met GROUP BY 1, 2, 3),
l AS (SELECT id, mate, string_agg(role, ',' ORDER BY k DESC, role) AS roles FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY masters DESC, mate) AS place FROM n)
SELECT p.id, p.mate, masters, roles, place FROM p JOIN l ON l.id = p.id AND l.mate = p.mate WHERE place <= 30""")
def collaborators(s, d):
    """For every twentieth artist: the thirty others most often on the masters of it and its alias."""
    ids = t(s, d, "lineitem").filter("l_partkey % 20 = 0").select(F.col("l_partkey").alias("id")).distinct()
    aliases = ids.select("id", F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("other"))
    return E.collaborators(_credits(s, d).select("artist_id", "master_id", "role"), aliases).withColumn("place", F.col("place").cast("long"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS label, o_custkey AS artist, l_orderkey AS master FROM lineitem JOIN orders ON l_orderkey = o_orderkey), per AS (SELECT label, artist, count(*) AS k FROM m GROUP BY 1, 2), tot AS (SELECT label, count(DISTINCT master) AS total FROM m GROUP BY 1),
own AS (SELECT label, artist AS id, k AS mine, total FROM per JOIN tot USING (label) WHERE artist % 20 = 0 AND k >= 2),
met AS (SELECT own.id, per.artist AS mate, label, total, least(mine, k) AS less FROM own JOIN per USING (label) WHERE own.id <> per.artist AND per.artist <> own.id + 1),
nm AS (SELECT id, mate, string_agg(label::VARCHAR, ',' ORDER BY rn) AS label_names FROM (SELECT *, row_number() OVER (PARTITION BY id, mate ORDER BY less DESC, label) AS rn FROM met) WHERE rn <= 3 GROUP BY 1, 2)
SELECT met.id, met.mate, count(*) AS labels, sum(less)::BIGINT AS together, round(sum(less / sqrt(total)), 4) AS score, any_value(label_names) AS label_names FROM met JOIN nm ON nm.id = met.id AND nm.mate = met.mate GROUP BY 1, 2""")
def artist_labelmates(s, d):
    """For every twentieth artist: who shares the labels where it has two masters or more, big labels counting less, its alias left out, with three label names."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist_id"))
    li = dealt(t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("label")), "l_orderkey")
    m = li.join(o, "l_orderkey").withColumnRenamed("l_orderkey", "master_id").repartition(shares(li), "label", "artist_id")
    asked = t(s, d, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("id"))
    barred = asked.select("id", (F.col("id") + 1).alias("other"))
    return E.labelmates(m, asked, barred).withColumn("score", F.round("score", 4))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS artist, l_suppkey AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT label, ln((SELECT count(DISTINCT artist) FROM m) / count(*)) AS idf FROM m GROUP BY 1)
SELECT a.artist AS id, b.artist AS artist, count(*) AS labels, round(sum(idf), 4) AS score FROM m a JOIN m b ON a.label = b.label AND a.artist % 20 = 0 AND b.artist <> a.artist JOIN n ON n.label = a.label GROUP BY 1, 2""")
def labelmates_idf(s, d):
    """Artists that share labels with every twentieth artist, rare labels counting more."""
    o = t(s, d, "orders").select(F.col("o_custkey").alias("artist"), F.col("o_orderkey").alias("l_orderkey"))
    li = dealt(t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("label")), "l_orderkey")
    m = li.join(o, "l_orderkey").select("artist", "label").repartition(shares(li), "label", "artist").distinct()
    m = written(m, "labelmates")  # used several times below
    total = m.select("artist").distinct().agg(F.count("*").alias("total"))
    idf = m.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", F.log(F.col("total") / F.col("n")).alias("idf"))  # one row
    asked = written(m.filter("artist % 20 = 0").select("label", F.col("artist").alias("id")).join(idf, "label"), "labelmates-asked")
    return E.labelmates_idf(asked, m).withColumn("score", F.round("score", 4))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS masters FROM orders GROUP BY 1)
SELECT a.c_custkey AS id, b.c_custkey AS mate, b.c_name AS name, masters FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey JOIN n ON n.c_custkey = b.c_custkey WHERE a.c_custkey % 20 = 0""")
def group_bandmates(s, d):
    """For every twentieth artist: the members of its group that have a master."""
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("masters"))
    mates = c.join(n, "c_custkey").select(F.col("c_custkey").alias("mate"), F.col("c_name").alias("name"), "c_nationkey", "masters")
    asked = c.filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("id"), "c_nationkey")
    # a mate's rows lie together, so that its columns take next to no room in a file
    return dealt_join(mates, asked, ["c_nationkey"]).filter("id <> mate").select("id", "mate", "name", "masters")


@query("""SELECT user_id AS entity, event_id AS id, event_type AS role, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 15 THEN 0 ELSE 1 END, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END, event_id) AS place FROM events""")
def entity_images(s, d):
    """Images of each entity: manual ones first, then logo, photo, hero, then the id."""
    role = F.when(F.col("event_type") == "view", "logo").when(F.col("event_type") == "click", "photo").when(F.col("event_type") == "signup", "hero").otherwise("other")
    rows = t(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("id"), "event_type", F.when(F.col("value") > 15, "manual").otherwise("auto").alias("source"), role.alias("role"))
    return E.images(rows).select("entity", "id", F.col("event_type").alias("role"), F.col("place").cast("long").alias("place"))


@query("""WITH v AS (SELECT l_orderkey AS m, min(l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
i AS (SELECT c_custkey AS session, unnest([c_custkey, c_custkey * 2, -1 - c_custkey]) AS id, unnest([0, 1, 2]) AS place FROM customer)
SELECT session, place, id, o_orderpriority AS title, CASE WHEN k IS NOT NULL AND o_orderkey IS NOT NULL THEN lpad(k::VARCHAR, 11, 'v') END AS video, o_orderkey IS NULL AS not_found FROM i LEFT JOIN orders ON o_orderkey = id LEFT JOIN v ON m = id""")
def session_playlist(s, d):
    """Lists of ids in play order with titles and first videos; unknown ids are marked."""
    ids = t(s, d, "customer").select(F.col("c_custkey").alias("session"), F.array(F.col("c_custkey"), F.col("c_custkey") * 2, -1 - F.col("c_custkey")).alias("ids"))
    masters = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    url = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("https://youtu.be/"), F.lpad(F.col("l_linenumber").cast("string"), 11, "v"))).otherwise("https://vimeo.com/1")
    videos = t(s, d, "lineitem").select(F.col("l_orderkey").alias("master_id"), F.col("l_linenumber").alias("position"), url.alias("url"))
    return E.session_playlist(ids, masters, videos)


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS label, l_orderkey AS master, o_totalprice AS weight, CASE WHEN o_orderkey % 10 > 0 THEN year(o_orderdate) END AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT s_nationkey AS scene, m.*, row_number() OVER (PARTITION BY s_nationkey, label ORDER BY weight DESC NULLS LAST, year NULLS LAST, master) AS place FROM m JOIN supplier ON label = s_suppkey WHERE year IS NULL OR year BETWEEN 1995 AND 1997)
SELECT scene, label, master, year, place, min(year) OVER (PARTITION BY scene, label) AS first_year, max(year) OVER (PARTITION BY scene, label) AS last_year FROM p WHERE place <= 4""")
def scene_wall_era(s, d):
    """The four heaviest masters of each member label within the era; unknown years stay."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.col("o_totalprice").alias("weight"), F.when(F.col("o_orderkey") % 10 > 0, F.year("o_orderdate")).alias("year"))
    m = t(s, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_orderkey").alias("master")).distinct().join(o, "master")
    members = t(s, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("label"))
    out = E.scene_wall(members, m, 4, F.lit(1995), F.lit(1997))
    return out.select("scene", "label", "master", "year", F.col("place").cast("long").alias("place"), "first_year", "last_year")


@query("""WITH e AS (SELECT event_id AS id, user_id AS a, (user_id * 7) % 10 AS b, event_type AS kind, value / 40 AS confidence FROM events WHERE value / 40 >= 0.3 AND event_type IN ('click', 'view')),
x AS (SELECT 'artist' AS ek, a AS ei, 'label' AS ok, b AS oi, 'out' AS direction, * FROM e UNION ALL SELECT 'label', b, 'artist', a, 'in', * FROM e)
SELECT ek AS entity_kind, ei AS entity_id, ok AS other_kind, oi AS other_id, direction, id, kind, confidence FROM x QUALIFY row_number() OVER (PARTITION BY ek, ei, ok, oi, kind ORDER BY confidence DESC, id, direction DESC) = 1""")
def relationships(s, d):
    """Edges from both ends, over a confidence and of two sources, the surest of each pair, kind and source."""
    e = t(s, d, "events").select(F.col("event_id").alias("id"), F.lit("artist").alias("from_kind"), F.col("user_id").alias("from_id"), F.lit("label").alias("to_kind"), (F.col("user_id") * 7 % 10).alias("to_id"), F.col("event_type").alias("kind"), (F.col("value") / 40).alias("confidence"), F.col("event_type").alias("source_id"))
    return E.relationships(e, 0.3, ["click", "view"]).drop("source_id")


_CRATE = "s AS (SELECT user_id AS usr, event_type AS list, event_id AS added, event_id % 200 AS master FROM events), shop AS (SELECT DISTINCT l_orderkey AS master FROM lineitem WHERE l_quantity > 40)"


def _crates(s, d):
    saved = t(s, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("list"), F.col("event_id").alias("added"), (F.col("event_id") % 200).alias("master"))
    offers = t(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("master"))
    masters = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("artist"), F.array("o_orderpriority", "o_orderstatus").alias("styles"))
    return E.crates(saved, offers, masters)


@query(f"""WITH {_CRATE} SELECT usr AS "user", list, s.master, shop.master IS NOT NULL AS in_shop, row_number() OVER (PARTITION BY usr ORDER BY (shop.master IS NOT NULL) DESC, added DESC, s.master) AS place FROM s LEFT JOIN shop ON s.master = shop.master""")
def crates_list(s, d):
    return _crates(s, d)[0].select("user", "list", "master", "in_shop", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_CRATE}, w AS (SELECT usr, list, o_orderstatus AS label, o_custkey::VARCHAR AS artist, o_orderpriority AS style FROM s JOIN orders ON master = o_orderkey),
f AS (SELECT usr, 'list' AS kind, list AS value FROM w UNION ALL SELECT usr, 'label', label FROM w UNION ALL SELECT usr, 'artist', artist FROM w UNION ALL SELECT usr, 'style', style FROM w UNION ALL SELECT usr, 'style', label FROM w),
n AS (SELECT usr, kind, value, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT usr AS "user", kind, value, n FROM n QUALIFY kind = 'list' OR row_number() OVER (PARTITION BY usr, kind ORDER BY n DESC, value) <= 8""")
def crates_tastes(s, d):
    """Counts of each list, and the eight styles, labels and artists most saved."""
    return _crates(s, d)[1]


@query("""WITH q AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 40 = 0 THEN p_name ELSE replace(p_name, 'e', 'a') END AS q FROM part WHERE p_partkey % 20 = 0),
n AS (SELECT CASE WHEN min(p_partkey) % 2 = 0 THEN 'wine' ELSE 'producer' END AS type, p_name AS name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY p_name, p_partkey % 3),
m AS (SELECT qid, q, n.*, 1.0 + CASE type WHEN 'producer' THEN least(n, 50) / 100 ELSE 0 END AS score FROM q JOIN n ON list_has_all(string_split(name, ' '), string_split(q, ' ')[:-2]) AND len(list_filter(string_split(name, ' '), lambda w: starts_with(w, string_split(q, ' ')[-1]))) > 0),
h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY qid, type ORDER BY score DESC, n DESC, id) <= 4),
g AS (SELECT qid, q, n.*, list_distinct(flatten(list_transform(string_split(q, ' '), lambda w: list_transform(range(1::bigint, length(w) + 2), lambda i: substr('  ' || w || ' ', i::bigint, 3))))) AS a, list_distinct(flatten(list_transform(string_split(name, ' '), lambda w: list_transform(range(1::bigint, length(w) + 2), lambda i: substr('  ' || w || ' ', i::bigint, 3))))) AS b FROM q, n WHERE (SELECT count(*) FROM h WHERE h.qid = q.qid) < 3),
s AS (SELECT qid, q, type, name, id, n, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM g WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.45),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, type ORDER BY score DESC, n DESC, id) <= 4),
u AS (SELECT * FROM h UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.type = f.type AND h.id = f.id))
SELECT qid, type, id, round(score, 6) AS score, q = name AS exact, row_number() OVER (PARTITION BY qid ORDER BY q = name DESC, score DESC, type, id) AS place FROM u QUALIFY place <= 8""")
def corpus_search(s, d):
    """Full-text hits with a producer's count; where they are under three, similar names too; four of a type, exact names first."""
    n = F.col("p_partkey")
    q = F.when(n % 40 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit("e"), F.lit("a")))
    queries = t(s, d, "part").filter("p_partkey % 20 = 0").select(n.alias("qid"), q.alias("q"))
    names = t(s, d, "part").groupBy(F.col("p_name").alias("name"), (n % 3).alias("k")).agg(F.min(n).alias("id"), F.count("*").alias("count"))
    names = names.select(F.when(F.col("id") % 2 == 0, "wine").otherwise("producer").alias("type"), "id", "name", "count")
    found = E.corpus_search(queries, S.index(names, {"name": "A"}), names, S)
    return found.select("qid", "type", "id", F.round("score", 6).alias("score"), "exact", F.col("place").cast("long").alias("place"))


@query("""WITH l AS (SELECT p_size AS pid, arg_min(url, CASE WHEN web THEN 0 ELSE 1 END * 1000000000 + p_partkey) AS link FROM (SELECT p_partkey, p_size, p_partkey % 2 = 0 AS web, 'http://x/' || p_partkey AS url FROM part WHERE p_partkey % 3 > 0) GROUP BY 1)
SELECT o_orderkey AS id, s_name AS producer, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'https://' || lower(s_name) END, link) AS site, CASE WHEN c_custkey % 2 = 0 THEN 'https://img/' || c_custkey END AS image
FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 50 LEFT JOIN l ON pid = o_orderkey % 50 LEFT JOIN customer ON c_custkey = o_custkey""")
def counter_dressing(s, d):
    """Wines with their producer, its site or best link, and a picture; addresses that are not of the web are dropped."""
    wines = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("producer_id"), F.col("o_custkey").alias("external_id"))
    site = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://"), F.lower("s_name"))).otherwise("ftp://x")
    producers = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), site.alias("site"))
    n = F.col("p_partkey")
    links = t(s, d, "part").select(F.col("p_size").cast("long").alias("producer_id"), n.alias("id"), F.when(n % 2 == 0, "website").otherwise("shop").alias("kind"), F.when(n % 3 > 0, F.concat(F.lit("http://x/"), n.cast("string"))).otherwise("javascript:x").alias("url"))
    k = F.col("c_custkey")
    pictures = t(s, d, "customer").select(k.alias("external_id"), F.when(k % 2 == 0, F.concat(F.lit("https://img/"), k.cast("string"))).otherwise("data:x").alias("url"))
    return E.counter_dressing(wines, producers, links, pictures)


@query("""WITH c AS (SELECT user_id AS place, event_id AS id, CASE WHEN event_type <> 'view' THEN event_type END AS style, repeat('word ', 20 + (event_id % 200)::INT) AS clause FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY style NULLS FIRST, id) AS rn, count(*) OVER (PARTITION BY place) AS total FROM c)
SELECT place, id, style, CASE WHEN length(clause) <= 520 THEN clause ELSE regexp_replace(substr(clause, 1, 520), '\\s+\\S*$', '') || '…' END AS clause, greatest(total - 8, 0) AS left_out FROM n WHERE rn <= 8""".replace("\\\\", "\\"))
def shaped_clauses(s, d):
    """Eight clauses a place, those without a style first, cut at a word; how many are left out."""
    clause = F.repeat(F.lit("word "), (F.lit(20) + F.col("event_id") % 200).cast("int"))
    c = t(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("style_key"), clause.alias("clause"))
    out = E.shaped_clauses(c, "key")
    return out.select(F.col("key").alias("place"), "id", F.col("style_key").alias("style"), "clause", F.col("left_out"))


@query("""SELECT l_suppkey, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (WHERE l_returnflag = 'A'), '') AS named, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (WHERE l_returnflag = 'N'), '') AS not_named, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (WHERE l_returnflag = 'R'), '') AS unknown FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def grapes_by_naming(s, d):
    """Grapes named in the rules, not named, and unknown (a tri-state) for each place."""
    named = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
    li = t(s, d, "lineitem").select("l_suppkey", "l_partkey", named.alias("named_in_rules")).distinct()
    return E.grapes_by_naming(li.join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("grape")), "l_partkey"), "l_suppkey")


@query("""WITH m AS (SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders), x AS (SELECT DISTINCT 'artist_masters' AS scope, l_partkey AS source, l_orderkey AS target, -year AS a, l_orderkey AS b FROM lineitem JOIN m ON id = l_orderkey WHERE l_partkey % 20 = 0
UNION ALL SELECT DISTINCT 'label_releases', l_suppkey, l_orderkey, 0, l_orderkey FROM lineitem WHERE l_suppkey % 20 = 0
UNION ALL SELECT 'master_releases', l_orderkey, l_orderkey * 10 + l_linenumber, min(CASE WHEN l_linenumber = 2 THEN 0 ELSE year(l_shipdate) END), l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT 'master_videos', o_orderkey, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END, event_id FROM orders JOIN events ON user_id = o_custkey AND event_type IN ('view', 'click') WHERE o_orderkey % 20 = 0)
SELECT scope, source, target, place FROM (SELECT *, row_number() OVER (PARTITION BY scope, source ORDER BY a, b) AS place FROM x) WHERE place <= 50""")
def traversal_dispatch(s, d):
    """The four traversals by name, each with its own tables and order: the first fifty of every twentieth source."""
    li, n = t(s, d, "lineitem"), F.col
    years = t(s, d, "orders").select(n("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    wanted = lambda df, key: df.filter(n(key) % 20 == 0)

    def artist_masters():
        return wanted(li, "l_partkey").join(years, "l_orderkey").select(n("l_partkey").alias("source"), n("l_orderkey").alias("target"), (-n("year")).alias("a")).distinct()

    def label_releases():
        return wanted(li, "l_suppkey").select(n("l_suppkey").alias("source"), n("l_orderkey").alias("target"), F.lit(0).alias("a")).distinct()

    def master_releases():
        main_first = F.min(F.when(n("l_linenumber") == 2, 0).otherwise(F.year("l_shipdate")))
        return wanted(li, "l_orderkey").groupBy(n("l_orderkey").alias("source"), (n("l_orderkey") * 10 + n("l_linenumber")).alias("target")).agg(main_first.alias("a"))

    def master_videos():
        videos = t(s, d, "events").filter(n("event_type").isin("view", "click")).select(n("user_id").alias("o_custkey"), n("event_id").alias("target"), F.when(n("event_type") == "view", 0).otherwise(1).alias("a"))
        return wanted(t(s, d, "orders"), "o_orderkey").select(n("o_orderkey").alias("source"), "o_custkey").join(videos, "o_custkey").select("source", "target", "a")

    scopes = {f.__name__: f for f in (artist_masters, label_releases, master_releases, master_videos)}
    found = [top_n(E.dispatch(name, scopes), ["source"], [F.asc("a"), F.asc("target")], 50, "place").select(F.lit(name).alias("scope"), n("source").cast("long").alias("source"), n("target").cast("long").alias("target"), n("place").cast("long").alias("place")) for name in scopes]
    return reduce(DataFrame.union, found)


_TREE = "c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 10 > 0 THEN c_custkey // 3 END AS parent FROM customer)"


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT id, 1 AS depth, parent AS ancestor FROM c WHERE parent IS NOT NULL UNION ALL SELECT up.id, depth + 1, c.parent FROM up JOIN c ON c.id = up.ancestor WHERE c.parent IS NOT NULL),
n AS (SELECT up.id, list(name ORDER BY depth) AS chain FROM up JOIN c ON c.id = ancestor GROUP BY 1), d AS (SELECT ancestor AS id, count(*) AS descendants FROM up GROUP BY 1),
k AS (SELECT parent AS id, list(name ORDER BY name) AS children FROM (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY name, id) AS rn FROM c WHERE parent IS NOT NULL) WHERE rn <= 50 GROUP BY 1)
SELECT c.id, c.name, p.name AS parent_name, coalesce(array_to_string(chain, ' < '), '') AS chain, coalesce(array_to_string(children, ','), '') AS children, coalesce(descendants, 0) AS descendants
FROM c LEFT JOIN c p ON p.id = c.parent LEFT JOIN n ON n.id = c.id LEFT JOIN d ON d.id = c.id LEFT JOIN k ON k.id = c.id""")
def label_hierarchy(s, d):
    """Each label with its parent, the chain above it, its first fifty sublabels by name and the number below it, of any depth."""
    n = F.col("c_custkey")
    nodes = t(s, d, "customer").select(n.alias("id"), F.col("c_name").alias("name"), F.when(n % 10 > 0, F.floor(n / 3)).alias("parent"))
    return GR.hierarchy(nodes).select("id", "name", "parent_name", F.array_join("chain", " < ").alias("chain"), F.array_join("children", ",").alias("children"), "descendants")


_MEMBERS = "m AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS a FROM lineitem WHERE l_partkey % 3 > 0 AND l_suppkey <> l_partkey)"


@query(f"""WITH {_MEMBERS}, e AS (SELECT a AS id, 'group' AS kind, g AS other FROM m WHERE a % 20 = 0 UNION ALL SELECT g, 'member', a FROM m WHERE g % 20 = 0
UNION ALL SELECT DISTINCT x.a, 'bandmate', y.a FROM m x JOIN m y ON x.g = y.g AND x.a <> y.a WHERE x.a % 20 = 0), n AS (SELECT l_partkey AS other, count(DISTINCT l_orderkey) AS masters FROM lineitem GROUP BY 1)
SELECT id, kind, other, masters, row_number() OVER (PARTITION BY id, kind ORDER BY masters DESC, p_name, other) AS place FROM e JOIN n USING (other) JOIN part ON p_partkey = other""")
def artist_groups(s, d):
    """Groups, members and bandmates of every twentieth artist, with their masters in scope."""
    li = t(s, d, "lineitem")
    members = li.filter("l_partkey % 3 > 0 AND l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("member_id"))
    artists = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = members.select(F.explode(F.array("group_id", "member_id")).alias("id")).distinct().filter("id % 20 = 0")
    found = GR.group_places(asked, members, artists, li.select(F.col("l_partkey").alias("artist_id"), F.col("l_orderkey").alias("master_id")))
    return found.select("id", "kind", "other", "masters", F.col("place").cast("long").alias("place"))


@query("""WITH RECURSIVE sm AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 497000), li AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT id FROM sm)),
bad AS (SELECT 'artist' AS type, p_partkey AS id FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'label', s_suppkey FROM supplier WHERE s_suppkey % 7 = 0),
e AS (SELECT 'label' AS type, s_suppkey AS id, 'parent' AS kind, 'label' AS to_type, s_suppkey // 2 AS to_id FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 'artist', p_partkey, 'alias', 'artist', p_partkey // 2 FROM part WHERE p_size > 25 UNION ALL SELECT 'artist', p_partkey, 'group', 'artist', p_partkey // 3 FROM part WHERE p_size <= 10),
s AS (SELECT DISTINCT 'artist' AS type, l_partkey AS id FROM li UNION SELECT DISTINCT 'label', l_suppkey FROM li),
c AS (SELECT type, id, 0 AS level FROM s WHERE (type, id) NOT IN (SELECT type, id FROM bad) UNION SELECT to_type, to_id, level + 1 FROM c JOIN e USING (type, id) WHERE (to_type, to_id) NOT IN (SELECT type, id FROM bad) AND level < 40),
f AS (SELECT type, id, min(level) AS level FROM c GROUP BY 1, 2),
k AS (SELECT f.type, f.id, f.level, min(e.kind) AS kind FROM f LEFT JOIN (SELECT e.*, g.level AS l FROM e JOIN f g ON g.type = e.type AND g.id = e.id) e ON e.to_type = f.type AND e.to_id = f.id AND e.l = f.level - 1 GROUP BY 1, 2, 3),
n AS (SELECT type, level, kind, count(*) AS n FROM k GROUP BY 1, 2, 3)
SELECT type, level::INTEGER AS level, kind, n, (SELECT sum(m.n)::BIGINT FROM n m WHERE m.type = n.type AND m.level <= n.level) AS total FROM n""")
def scope_closure_sizes(s, d):
    """Artists and labels of a scope, closed over aliases, groups and label parents with the quality gate in each round, by level and edge."""
    scope = t(s, d, "orders").filter("o_totalprice > 497000").select(F.col("o_orderkey").alias("id"))
    li, part, n = t(s, d, "lineitem"), t(s, d, "part"), F.col("p_partkey")
    credits = li.select(F.col("l_orderkey").alias("master_id"), F.col("l_partkey").alias("artist_id"))
    places = li.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("label_id"))
    labels = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    edge = lambda rows, kind, k: rows.select(F.lit("artist").alias("type"), n.alias("id"), F.lit(kind).alias("kind"), F.lit("artist").alias("to_type"), F.floor(n / k).alias("to_id"))
    graph = edge(part.filter("p_size > 25"), "alias", 2).unionAll(edge(part.filter("p_size <= 10"), "group", 3))
    bad = part.filter(n % 11 == 0).select(F.lit("artist").alias("type"), n.alias("id")).unionAll(labels.filter("id % 7 = 0").select(F.lit("label"), "id"))
    found = GR.scope_closure(scope, scope, credits, credits.limit(0).withColumnRenamed("master_id", "release_id"), places, labels, bad, graph)
    return GR.closure_sizes(found)


@query("""WITH s AS (SELECT n_nationkey AS slug, n_name AS name, ['geography', 'cluster', 'sound', 'era', 'bridge', 'other'][n_nationkey % 6 + 1] AS axis, CASE WHEN n_nationkey % 4 > 0 THEN 1980 + n_nationkey % 7 END AS era_start, n_nationkey % 10 AS hero, CASE WHEN n_nationkey % 3 = 0 THEN 'own' END AS palette FROM nation),
m AS (SELECT s_nationkey AS slug, s_suppkey AS label, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
b AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target, b.n_nationkey + 1 AS strength FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_nationkey + b.n_nationkey) % 3 = 1 AND a.n_nationkey < b.n_nationkey)
SELECT slug, s.name, axis, era_start::INTEGER AS era_start, coalesce(palette, 'hero ' || h.s_suppkey) AS palette, (SELECT count(*) FROM m WHERE m.slug = s.slug) AS label_count,
coalesce((SELECT string_agg(s_name, ',' ORDER BY rank) FROM m WHERE m.slug = s.slug AND label % 9 > 0), '') AS labels,
coalesce((SELECT string_agg(x.name, ',' ORDER BY strength DESC, x.name) FROM b JOIN s x ON x.slug = target WHERE source = s.slug), '') AS bridges_out,
coalesce((SELECT string_agg(x.name, ',' ORDER BY strength DESC, x.name) FROM b JOIN s x ON x.slug = source WHERE target = s.slug), '') AS bridges_in,
row_number() OVER (ORDER BY slug % 6, era_start NULLS LAST, s.name) AS place FROM s LEFT JOIN supplier h ON h.s_suppkey = hero AND h.s_suppkey % 9 > 0""")
def scene_details(s, d):
    """Scenes in list order with palette, members and bridges in both directions; nations stand for scenes, suppliers for labels."""
    n, k = t(s, d, "nation"), F.col("n_nationkey")
    axis = F.get(F.array(*map(F.lit, (*E.AXES, "other"))), (k % 6).cast("int"))
    scenes = n.select(k.alias("slug"), F.col("n_name").alias("name"), axis.alias("axis"), F.when(k % 4 > 0, 1980 + k % 7).cast("int").alias("era_start"), (k % 10).alias("hero"), F.when(k % 3 == 0, "own").alias("palette"))
    sup = t(s, d, "supplier")
    members = top_n(sup, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 2**31 - 1, "rank").select(F.col("s_nationkey").alias("slug"), F.col("s_suppkey").alias("label"), "rank")
    labels = sup.filter("s_suppkey % 9 > 0").select(F.col("s_suppkey").alias("label"), F.col("s_name").alias("name"), F.concat(F.lit("hero "), F.col("s_suppkey").cast("string")).alias("palette"))
    far = n.select("n_regionkey", k.alias("target"))
    bridges = n.select("n_regionkey", k.alias("source")).join(far, "n_regionkey").filter("(source + target) % 3 = 1 AND source < target").select("source", "target", (F.col("target") + 1).alias("strength"))
    out = E.scene_details(scenes, members, labels, bridges)
    return out.select("slug", "name", "axis", "era_start", "palette", "label_count", *[F.array_join(c, ",").alias(c) for c in ("labels", "bridges_out", "bridges_in")], F.col("place").cast("long").alias("place"))


@query("""WITH li AS (SELECT DISTINCT l_suppkey AS label, l_orderkey AS master FROM lineitem), c AS (SELECT label, master, row_number() OVER (PARTITION BY label ORDER BY master DESC) AS rank FROM li WHERE master % 50 = 0),
a AS (SELECT label, master, row_number() OVER (PARTITION BY label ORDER BY o_totalprice DESC, master) AS rank FROM li JOIN orders ON o_orderkey = master),
u AS (SELECT label, master, rank, 'curated' AS source FROM c UNION ALL SELECT label, master, rank, 'auto' FROM a WHERE (label, master) NOT IN (SELECT label, master FROM c))
SELECT label, master, source, o_orderpriority AS title, row_number() OVER (PARTITION BY label ORDER BY source DESC, rank, master) AS place FROM u JOIN orders ON o_orderkey = master AND o_orderstatus <> 'P' QUALIFY place <= 10""")
def core_run_curated(s, d):
    """The core run of each label: what is curated first, then the heaviest of the rest; masters that are gone are skipped."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.col("o_orderpriority").alias("title"), "o_orderstatus", "o_totalprice")
    li = t(s, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_orderkey").alias("master")).distinct()
    curated = top_n(li.filter("master % 50 = 0"), ["label"], [F.desc("master")], 2**31 - 1, "rank")
    auto = top_n(li.join(o, "master"), ["label"], [F.desc("o_totalprice"), F.asc("master")], 2**31 - 1, "rank")
    return E.core_run(curated, auto, o.filter("o_orderstatus <> 'P'")).withColumn("place", F.col("place").cast("long"))


@query("""SELECT s_suppkey AS label, CASE WHEN p_size % 2 = 0 THEN 'influenced' ELSE 'sibling' END AS direction, p_partkey AS other, c_name AS name,
row_number() OVER (PARTITION BY s_suppkey, p_size % 2 ORDER BY p_size, c_name, p_partkey) AS place FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem) JOIN part USING (p_partkey) JOIN customer ON c_custkey = p_partkey WHERE p_size % 5 > 0""")
def labels_related(s, d):
    """Related labels by direction and rank; edges of an unknown direction or to an unknown label go."""
    p = t(s, d, "part").select(F.col("p_partkey").alias("other"), F.col("p_size").alias("rank"))
    direction = F.when(F.col("rank") % 5 == 0, "unheard").when(F.col("rank") % 2 == 0, "influenced").otherwise("sibling")
    edges = t(s, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("other")).distinct().join(p, "other").withColumn("direction", direction)
    labels = t(s, d, "customer").select(F.col("c_custkey").alias("label"), F.col("c_name").alias("name"))
    return E.related_labels(edges, labels, ["influenced", "sibling"]).withColumn("place", F.col("place").cast("long"))
