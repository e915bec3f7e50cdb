"""Resolution queries with SQL oracles: cascades, places, grapes, merges, variants, rules, packs; stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import relational as R, resolve as V
from ..sources.io import read_table as t
from .catalog import query


def _values(s, ddl: str, rows: list[tuple]) -> DataFrame:
    """A small inline relation."""
    return s.createDataFrame(rows, ddl)


_KNOWN = "k AS (SELECT min(p_partkey) AS id, p_name AS name, 'Chateau ' || p_name AS display, p_type AS country, count(*) AS weight FROM part GROUP BY p_name, p_type)"


def _known(s, d) -> DataFrame:
    g = t(s, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("country")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("weight"))
    return g.withColumn("display_name", F.concat(F.lit("Chateau "), "name"))


@query(f"""WITH {_KNOWN}, a AS (SELECT p_partkey AS key, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS country, p_partkey % 4 AS m FROM part),
s AS (SELECT key, a.country, m, p_name, k.id, k.weight FROM a JOIN k ON k.name = p_name AND (a.country IS NULL OR a.country = k.country)),
b AS (SELECT key, m, count(*) AS n, arg_min(id, -weight * 1000000000 + id) AS id FROM s GROUP BY 1, 2)
SELECT key, id, CASE m WHEN 0 THEN 'exact' WHEN 1 THEN 'norm' ELSE 'norm_stripped' END || CASE WHEN n > 1 THEN '_ambiguous' ELSE '' END AS method, 1.0::DOUBLE AS score, n AS candidates FROM b""")
def producer_match_cascade(s, d):
    """Names as written, by key, and without title words, to known ones of the country; the heaviest of several."""
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.concat(F.lit("Domaine "), "p_name"))
    rows = t(s, d, "part").select(F.col("p_partkey").alias("key"), name.alias("name"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_type")).alias("country"))
    return V.match_cascade(rows, _known(s, d))


_G = "list_distinct(flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1::bigint, length(w) + 2), lambda i: substr('  ' || w || ' ', i::bigint, 3)))))"


@query(f"""WITH {_KNOWN}, a AS (SELECT p_partkey AS key, 'x' || p_name AS name, p_type AS country FROM part WHERE p_partkey % 10 = 0),
g AS (SELECT key, id, weight, {_G.format('a.name')} AS x, {_G.format('k.name')} AS y FROM a JOIN k ON a.country = k.country),
m AS (SELECT key, id, weight, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim FROM g), h AS (SELECT * FROM m WHERE sim >= 0.6),
t AS (SELECT key, max(sim) AS best, least(count(*), 5) AS candidates FROM h GROUP BY 1), u AS (SELECT h.key, count(*) AS k FROM h JOIN t ON h.key = t.key AND sim = best GROUP BY 1)
SELECT h.key, id, CASE WHEN u.k > 1 THEN 'trgm_ambiguous' ELSE 'trgm' END AS method, round(sim, 4) AS score, candidates FROM h JOIN t ON h.key = t.key JOIN u ON u.key = h.key QUALIFY row_number() OVER (PARTITION BY h.key ORDER BY sim DESC, weight DESC, id) = 1""")
def producer_match_trigram(s, d):
    """Names that no exact stage knows, by shared trigrams within the country."""
    rows = t(s, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("x"), "p_name").alias("name"), F.col("p_type").alias("country"))
    return V.match_cascade(rows, _known(s, d)).withColumn("score", F.round("score", 4)).withColumn("candidates", F.col("candidates").cast("long"))


@query("""WITH k AS (SELECT p_partkey AS id, p_brand AS producer, p_name AS b, p_partkey % 3 > 0 AS live FROM part), a AS (SELECT p_partkey AS key, p_brand AS producer, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' rouge' END AS a FROM part),
h AS (SELECT key, id, live, CASE WHEN a = b THEN 0 WHEN contains(' ' || a || ' ', ' ' || b || ' ') THEN 1 END AS stage, CASE WHEN a = b THEN 0 ELSE length(a) - length(b) END AS gap FROM a JOIN k ON a.producer = k.producer)
SELECT key, id, CASE stage WHEN 0 THEN 'exact' ELSE 'contained' END AS method FROM h WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, NOT live, gap, id) = 1""")
def wine_match(s, d):
    """Listings to wines of one producer: the same name, then containment (live ones and the tightest first)."""
    p = t(s, d, "part")
    known = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("producer"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 > 0).alias("live"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" Rouge")))
    return V.match_within(p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("producer"), name.alias("name")), known)


#: country, region, sub_region, site, classification, designation -> place, method, by the rules.
_PLACES = [
    ("FR", "Burgundy", "Chablis", "Les Clos", "Grand Cru", None, "11", "sub_region"),
    ("FR", "Burgundy", "Chablis", None, None, None, "10", "sub_region"),
    ("FR", "Alsace", "Eichberg", None, "Grand Cru", None, "13", "sub_region"),
    ("IT", "Sicily", "Etna Rosso", None, None, None, "21", "sub_region"),
    ("IT", "Sicily", "Nowhere", None, None, None, "20", "region"),
    ("IT", "Toscana", "Rosso di Montalcino", None, None, None, "23", "sub_region"),
    ("AR", "Mendoza", "Tupungato", "Gualtallary", None, None, "31", "site"),
    ("US", "California", "Paso Robles", None, None, "AVA", "US|AVA|paso robles", "sub_region"),
    ("US", "California", "Paso Robles", None, None, "DO", "US|AVA|paso robles", "sub_region"),
    ("US", "California", "Paso Robles", None, None, "AVA", "US|AVA|paso robles", "sub_region"),
    ("US", "Oregon", None, None, None, "AVA", "US|AVA|oregon", "region"),
    ("US", "Oregon", None, None, None, None, None, None),
    ("DE", "Unknown", None, None, None, "QbA", None, None),
]
_NAMES = [
    (10, "FR", "chablis", "PDO", 1), (12, "FR", "chablis", "PGI", 9), (11, "FR", "chablis grand cru", "PDO", 1), (13, "FR", "alsace grand cru eichberg", "PDO", 3), (14, "FR", "alsace", "PDO", 9),
    (20, "IT", "sicily", "PGI", 5), (21, "IT", "etna", "PDO", 2), (22, "IT", "montalcino", "PGI", 1), (23, "IT", "rosso di montalcino", "PDO", 1), (30, "AR", "tupungato", "other", 0), (31, "AR", "gualtallary", "other", 0), (32, "AR", "mendoza", "other", 0),
]
_SAID = ", ".join(f"({i}, {'NULL' if r[6] is None else repr(r[6])}, {'NULL' if r[7] is None else repr(r[7])})" for i, r in enumerate(_PLACES))


@query(f"SELECT c_custkey AS id, place, method FROM customer JOIN (VALUES {_SAID}) v(i, place, method) ON c_custkey % {len(_PLACES)} = i WHERE place IS NOT NULL")
def place_resolution(s, d):
    """Staged names, aliases learned from stripped type words, finer places first outside the register, places made of designations.

    Every customer carries one of the rules' cases; the oracle holds what the rules must say.
    """
    cases = _values(s, "i long, country string, region string, sub_region string, site string, classification string, designation string", [(i, *r[:6]) for i, r in enumerate(_PLACES)])
    items = t(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(_PLACES)).alias("i")).join(F.broadcast(cases), "i").drop("i")  # as many rows as cases
    return V.place_resolution(items, _values(s, "place long, country string, key string, gi_type string, grapes int", _NAMES), ["FR", "IT", "DE"])


#: name, wanted colour -> id, stage, by the rules.
_GRAPES = [
    ("merlot", None, 1, "exact"), ("weisser riesling", "white", 2, "colour_stripped"), ("pinot", "red", 4, "exact"), ("pinot", "white", 5, "exact"), ("steen", None, 6, "manual"),
    ("cabernet franc sec", None, 7, "first_two"), ("shared", None, None, None), ("shared", "white", 9, "exact"), ("nobody", None, None, None), ("douce", "white", None, None), ("same number", None, 11, "exact"),
]
_GNAMES = [(1, "merlot", 0), (2, "riesling", 0), (3, "pinot", 1), (4, "pinot", 0), (5, "pinot", 0), (7, "cabernet franc", 1), (8, "shared", 2), (9, "shared", 2), (10, "douce", 0), (11, "same number", 2), (12, "same number", 2)]
_GFACTS = [
    (1, "merlot", "red", 5.0, "a"), (2, "riesling", "white", 5.0, "b"), (3, "pinot x", "red", 9.0, "c"), (4, "pinot noir", "red", 5.0, "d"), (5, "pinot blanc", "white", 4.0, "e"), (6, "chenin", "white", 4.0, "f"),
    (7, "cabernet franc", "red", 4.0, "g"), (8, "eight", "red", 4.0, "h"), (9, "nine", "white", 3.0, "i"), (10, "douce noir", "red", 1.0, "j"), (11, "eleven", "red", 2.0, "k"), (12, "twelve", "red", 1.0, "k"),
]
_GSAID = ", ".join(f"({i}, {'NULL' if r[2] is None else r[2]}, {'NULL' if r[3] is None else repr(r[3])})" for i, r in enumerate(_GRAPES))


@query(f"SELECT p_partkey AS key, CAST(id AS BIGINT) AS id, stage FROM part JOIN (VALUES {_GSAID}) v(i, id, stage) ON p_partkey % {len(_GRAPES)} = i WHERE id IS NOT NULL")
def grape_resolution(s, d):
    """By hand, whole name, without colour words, first two words; tiers, colour vetoes, shared synonyms refused."""
    cases = _values(s, "i long, name string, want string", [(i, *r[:2]) for i, r in enumerate(_GRAPES)])
    asked = t(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % len(_GRAPES)).alias("i")).join(F.broadcast(cases), "i").drop("i")  # as many rows as cases
    names, facts = _values(s, "id long, name string, tier int", _GNAMES), _values(s, "id long, primary_name string, colour string, weight double, number string", _GFACTS)
    return V.grape_resolution(asked, names, facts, _values(s, "name string, id long", [("steen", 6)]))


@query("""WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'domaine ' || p_name ELSE p_name END AS key, p_name AS core, string_split(p_name, ' ')[2] AS last, CASE p_partkey % 3 WHEN 0 THEN 'Domaine' WHEN 1 THEN 'Maison' END AS title, p_type AS country, p_size AS weight, p_brand AS region, [p_container] AS subs
FROM (SELECT *, 'c' || (p_partkey % 4) AS p_container FROM part)),
bl AS (SELECT country, last FROM k GROUP BY 1, 2 HAVING count(*) <= 40),
p AS (SELECT a.id AS id, b.id AS id2, CASE WHEN a.key = b.key THEN 'same_norm' WHEN a.core = b.core THEN 'title_stripped' ELSE 'given_name_diff' END AS rule, a.title AS t1, b.title AS t2, a.weight AS w1, b.weight AS w2, CASE WHEN a.region <> b.region THEN 'none' WHEN a.subs = b.subs THEN 'strong' ELSE 'weak' END AS proof
FROM k a JOIN k b ON a.country = b.country AND a.id < b.id AND (a.core = b.core OR (a.last = b.last AND (a.country, a.last) IN (SELECT country, last FROM bl))))
SELECT CASE WHEN w2 > w1 THEN id2 ELSE id END AS keep_id, CASE WHEN w2 > w1 THEN id ELSE id2 END AS merge_id, rule, CASE WHEN rule = 'given_name_diff' THEN CASE proof WHEN 'strong' THEN 'review' ELSE 'reject' END WHEN proof = 'strong' THEN CASE WHEN t1 <> t2 THEN 'review' ELSE 'auto' END WHEN proof = 'weak' THEN 'review' ELSE 'reject' END AS class, greatest(w1, w2) AS weight FROM p""")
def merge_candidates(s, d):
    """Pairs of one country by blocks on key, core name and surname; rule, evidence and class."""
    p = t(s, d, "part")
    n = F.col("p_partkey")
    key = F.when(n % 2 == 0, F.concat(F.lit("domaine "), "p_name")).otherwise(F.col("p_name"))
    title = F.when(n % 3 == 0, "Domaine").when(n % 3 == 1, "Maison")
    known = p.select(n.alias("id"), key.alias("key"), title.alias("title"), F.col("p_type").alias("country"), F.col("p_size").alias("weight"))
    evidence = p.select(n.alias("id"), F.col("p_brand").alias("region"), F.array(F.concat(F.lit("c"), (n % 4).cast("string"))).alias("subs"))
    return V.merge_candidates(known, evidence)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN c_custkey WHEN c_custkey % 10 >= 6 THEN c_custkey ELSE c_custkey - c_custkey % 10 + 3 * ((c_custkey % 10) // 3) + 1 END AS head FROM customer""")
def merge_variants(s, d):
    """Items that share a number and name one another: chains of three, whose middle one has the prime name; others stay alone."""
    n = F.col("c_custkey")
    last = n % 10
    names = F.when((last < 6) & (last % 3 < 2), F.array((n + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    items = t(s, d, "customer").select(n.alias("id"), F.floor(n / 10).cast("string").alias("number"), F.lit(1.0).alias("weight"), n.cast("string").alias("key"), names.alias("names"), (last != 9).alias("known"), (last % 3 == 1).alias("prime"))
    # the names that the chain's first and last item list run within a chain only
    whole = items.groupBy("number").agg(F.max("id").alias("top"))
    items = items.join(whole, "number").withColumn("names", F.when(F.col("id") < F.col("top"), F.col("names")).otherwise(F.array().cast("array<string>")))
    return V.merge_variants(items.drop("top"))


@query("""WITH g AS (SELECT p_partkey, p_name, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_name]) AS phrase FROM part), q AS (SELECT DISTINCT phrase FROM (SELECT string_split(p_name, ' ')[1] AS phrase FROM part UNION ALL SELECT p_name FROM part WHERE p_size > 30))
SELECT phrase, count(DISTINCT p_partkey) AS uses, count(DISTINCT p_partkey) FILTER (WHERE p_name = phrase) AS alone FROM g JOIN q USING (phrase) GROUP BY 1""")
def phrase_uses(s, d):
    """How many names use each phrase of one to three words whole, and how many are just the phrase."""
    p = t(s, d, "part").select("p_partkey", "p_name", "p_size")
    phrases = p.select(F.split("p_name", " ")[0].alias("phrase")).unionAll(p.filter("p_size > 30").select("p_name")).distinct()
    return V.phrase_uses(p.select(F.col("p_partkey").alias("id"), T.name_key(F.col("p_name")).alias("key")), phrases)


@query("""WITH w AS (SELECT DISTINCT o_orderkey AS doc, p_partkey AS grape, p_name AS name, o_orderkey % 3 > 0 AND p_size > 20 AS named FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT doc, grape, bool_or(string_split(name, ' ')[2] IN (SELECT string_split(name, ' ')[2] FROM w x WHERE x.doc = w.doc AND x.named AND x.name = w.name)) AS hit FROM w GROUP BY 1, 2)
SELECT doc, grape, CASE WHEN bool_or(hit) OVER (PARTITION BY doc) THEN hit END AS named FROM n""")
def varieties_named(s, d):
    """Varieties that a rule text names whole; unknown where it names none."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("doc"))
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("grape"))
    n = R.shares(li, 1 << 17)
    v = li.repartition(n, "doc").distinct().join(o, "doc").join(t(s, d, "part").select(F.col("p_partkey").alias("grape"), F.col("p_name").alias("name"), "p_size"), "grape")
    said = F.when((F.col("doc") % 3 > 0) & (F.col("p_size") > 20), F.concat(F.lit("From "), F.initcap("name"), F.lit(", and ")))
    # in a fixed order, since a shuffle brings the rows in any order; texts and names come out of one row, so they are shuffled once
    parts = F.sort_array(F.collect_list(F.struct("grape", "name", F.coalesce(said, F.lit("nothing, ")).alias("said"))))
    docs = v.repartition(n, "doc").groupBy("doc").agg(parts.alias("x"))
    texts = docs.select("doc", F.array_join("x.said", "").alias("text"))
    return V.named_in_rules(texts, docs.select("doc", F.explode("x").alias("x")).select("doc", "x.grape", "x.name"))


@query("""SELECT s_suppkey, '[' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Vins rouges:' || (40 + s_suppkey % 30) || ':' || (50 + s_suppkey % 30) || CASE WHEN s_suppkey % 4 = 1 THEN ',Vins blancs:45:55' ELSE '' END END || ']' AS rules, s_suppkey % 4 > 0 AND (s_suppkey % 5 = 0 OR abs(50 + s_suppkey % 30 - 60) / 60.0 <= 0.25 OR (s_suppkey % 4 = 1 AND 5 / 60.0 <= 0.25)) AS trusted FROM supplier""")
def yield_rules(s, d):
    """Pairs of yields in a table with its head, implausible rows and repeats left out, and whether the register agrees."""
    n = F.col("s_suppkey")
    num = lambda k: (F.lit(k) + n % 30).cast("string")
    head = F.when(n % 4 == 0, "no table here").otherwise("Rendement     rendement butoir")
    red = F.concat(F.lit("  Vins  rouges     "), num(40), F.lit("     "), num(50))
    white = F.when(n % 4 == 1, "  Vins blancs     45     55").otherwise("  Vins blancs     95     55")
    text = F.concat_ws("\n", head, red, red, white, F.lit("  Vins gris     400     500"))
    rows = t(s, d, "supplier").select("s_suppkey", V.yield_pairs(text).alias("y"), F.when(n % 5 > 0, 60.0).alias("register"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("y", lambda r: F.concat_ws(":", r["label"], r["base_hl"].cast("string"), r["limit_hl"].cast("string"))), ","), F.lit("]"))
    return rows.select("s_suppkey", listed.alias("rules"), V.trusted_yields(F.col("y"), F.col("register")).alias("trusted"))


@query("""WITH n AS (SELECT p_type AS country, p_name AS key, min(p_partkey) AS id, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2),
t AS (SELECT p_partkey AS doc, p_type AS country, unnest(['Annexe', 'Le ' || p_name, p_name, string_split(p_name, ' ')[1] || ' bolt']) AS title, unnest([0, 1, 2, 3]) AS place FROM part)
SELECT doc, id, place::INT AS place FROM t JOIN n ON n.country = t.country AND n.key = lower(title) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n > 1, place, id) = 1""")
def document_titles(s, d):
    """Documents to places by title variants within the country: unique names before shared ones, then the earlier variant."""
    p = t(s, d, "part")
    titles = F.array(F.lit("Annexe"), F.concat(F.lit("Le "), "p_name"), F.col("p_name"), F.concat(F.split("p_name", " ")[0], F.lit(" bolt")))
    docs = R.dealt(p.select(F.col("p_partkey").alias("doc"), "p_type", "p_name"), "doc", most=1 << 17)
    docs = docs.select("doc", F.col("p_type").alias("country"), titles.alias("titles"))
    return V.document_titles(docs, p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("country"), F.col("p_name").alias("key")))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'V1' WHEN 1 THEN 'V2' WHEN 2 THEN 'V4' END AS number, CASE c_custkey % 5 WHEN 0 THEN 'prime' WHEN 1 THEN 'synonym' WHEN 2 THEN 'synonym_colour' WHEN 3 THEN 'ambiguous' ELSE 'no_hit' END AS stage FROM customer""")
def assign_numbers(s, d):
    """Numbers for items that lack one: unique prime name, unique synonym, unique synonym of the colour, else refused."""
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, "Grüner").when(k == 1, "Anderl").when(k == 2, "Zwilling").when(k == 3, "Zwilling").otherwise("Niemand")
    items = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 2, "white").otherwise("rose").alias("colour"), F.array(label, F.lit("x")).alias("labels"))
    primes = _values(s, "key string, number string", [("gruener", "V1")])
    return V.assign_numbers(items, primes, _values(s, "key string, number string, colour string", [("anderl", "V2", "red"), ("zwilling", "V3", "red"), ("zwilling", "V4", "white")]))


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey <> n_nationkey THEN CAST(n_regionkey AS INT) END AS parent_id, CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END AS aliases FROM nation""")
def alias_parents(s, d):
    """Parents of a list's rows by name or alias: nations below five carry a region's name as alias."""
    region = t(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = t(s, d, "nation").join(region, "n_regionkey")
    own = t(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("alias"))
    rows = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("r_name").alias("parent")).join(own, "id", "left")
    return V.alias_parents(rows.select("id", "name", "parent", F.when(F.col("alias").isNotNull(), F.array("alias")).alias("aliases")))


@query("""SELECT DISTINCT fault, detail FROM (SELECT 'unknown_member' AS fault, c_custkey::VARCHAR AS detail FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'self_edge', n_name FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'bad_direction', 'sideways' FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'unknown_edge', 'X' || n_name FROM nation WHERE n_nationkey % 5 = 2 UNION ALL SELECT 'duplicate_slug', 'NATION_3' UNION ALL SELECT 'duplicate_member', 'NATION_' || c_nationkey || '/' || c_custkey FROM customer WHERE c_custkey % 10 = 0)""")
def pack_problems(s, d):
    """All faults of a pack; one that has any is not loaded."""
    n, k = t(s, d, "nation"), F.col("n_nationkey") % 5
    packs = n.select(F.col("n_name").alias("slug")).unionAll(n.filter("n_nationkey = 3").select("n_name"))
    c = t(s, d, "customer").select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("slug"), F.col("c_custkey").alias("id"))
    known = t(s, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    members = c.unionAll(c.filter("id % 10 = 0")).withColumn("id", F.col("id"))
    edges = n.select(F.col("n_name").alias("slug"), F.when(k == 0, F.col("n_name")).when(k == 2, F.concat(F.lit("X"), "n_name")).otherwise("NATION_1").alias("other"), F.when(k == 1, "sideways").otherwise("up").alias("direction"))
    edges = edges.withColumn("other", F.when(F.col("slug") == "NATION_1", "NATION_2").otherwise(F.col("other")))
    return V.pack_problems(packs, members, edges, known, ["up", "down"]).distinct()


@query("""WITH k AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name, p_type), x AS (SELECT k.id, k.name, count(*) AS masters FROM k JOIN part ON p_name = name GROUP BY 1, 2)
SELECT s AS seed, arg_min(id, id) AS id, 'exact' AS method FROM (SELECT DISTINCT ' ' || upper(p_name) AS s, p_name FROM part) JOIN x ON x.name = p_name GROUP BY 1""")
def seed_names(s, d):
    """Seed names to ids: the exact name in any case, most masters, then the least id."""
    p = t(s, d, "part")
    known = p.groupBy(F.col("p_name").alias("name"), "p_type").agg(F.min("p_partkey").alias("id")).join(p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("masters")), "name").drop("p_type")
    return V.seed_names(p.select(F.concat(F.lit(" "), F.upper("p_name")).alias("seed")).distinct(), known)


@query("""WITH r AS (SELECT l_suppkey AS gid, l_partkey AS ext FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 3 > 0), f AS (SELECT gid, min(ext) AS external FROM r GROUP BY 1) SELECT 'g' || min(gid) AS gid, external FROM f GROUP BY external""")
def crosswalk_links(s, d):
    """External ids through three joins: link types, entities, addresses; the first on both sides stays."""
    li = t(s, d, "lineitem")
    links = li.select(F.col("l_returnflag").alias("link_type"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("url"))
    types = li.select(F.col("l_returnflag").alias("link_type")).distinct().withColumn("gid", F.concat(F.lit("t"), "link_type"))
    entities = t(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("g"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("gid"))
    n = F.col("p_partkey")
    urls = t(s, d, "part").select(n.alias("url"), F.when(n % 3 > 0, F.concat(F.lit("https://x.org/artist/"), n.cast("string"))).otherwise("https://x.org/label/1").alias("address"))
    out = V.crosswalk(links, types, entities, urls, "artist/([0-9]+)", ["tA"])
    return out.withColumn("gid", F.concat(F.lit("g"), F.regexp_extract("gid", "^g0*([0-9]+)$", 1)))


@query("""WITH p AS (SELECT p_partkey AS doc, p_partkey % 5 AS k, 30 + p_size % 20 AS b, 45 + p_size % 20 AS l FROM part)
SELECT doc, 'vins rouges' AS label, b::INTEGER AS base_hl, (CASE WHEN k = 2 THEN l + 10 ELSE l END)::INTEGER AS limit_hl FROM p WHERE k IN (0, 1, 2) UNION ALL SELECT doc, 'vins blancs', b + 5, l + 10 FROM p WHERE k IN (0, 2) UNION ALL SELECT doc, NULL, b, l FROM p WHERE k = 3""")
def yield_prose(s, d):
    """A rule text for each part: yields of two colours in prose, in tables of one column, one limit for all, none named, and drafts."""
    p = t(s, d, "part")
    k, b = F.col("p_partkey") % 5, 30 + F.col("p_size") % 20
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    two = text("1° - Rendement\nLe rendement visé à l'article D. 645-7 est fixé à ", b, " hectolitres par hectare pour les\nvins rouges et ", b + 5, " hectolitres par hectare pour les vins blancs.\n2°- Rendement butoir\nLe rendement butoir visé à l'article est fixé à ", b + 15, " hectolitres par hectare pour les vins rouges, ", b + 25, " hectolitres par hectare pour les vins blancs.\n")
    table = text("Le rendement visé est fixé à :\n  Vins rouges      ", b, "\n\nLe rendement butoir visé est fixé à :\n  Vins  rouges      ", b + 15, "\n  Article 3     99\nIV. - Autre\n  Vins rouges      99\n")
    single = text("Le rendement visé est fixé à ", b, " hectolitres par hectare pour les vins rouges et ", b + 5, " hectolitres par hectare pour les vins blancs.\nLe rendement butoir visé est fixé à ", b + 25, " hectolitres par hectare pour les vins rouges et blancs.")
    plain = text("Le rendement visé est fixé à ", b, " hectolitres par hectare.\nLe rendement butoir visé est fixé à ", b + 15, " hectolitres par hectare.")
    draft = text("Le rendement visé est fixé à ", b, " ", b + 2, " hectolitres par hectare.\nLe rendement butoir visé est fixé à ", b + 15, " hectolitres par hectare.")
    body = F.when(k == 0, two).when(k == 1, table).when(k == 2, single).when(k == 3, plain).otherwise(draft)
    return V.prose_yields(p.select(F.col("p_partkey").alias("doc"), body.alias("text")))
