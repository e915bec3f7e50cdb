"""Scope-build queries with SQL oracles. A release is a line: id = order * 10 + line number; its master is the order, its style the part's type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import build as B, relational as R
from ..operators.lineage import written
from ..sources.io import read_table as t
from .catalog import query

_RELEASES = """r AS (SELECT l_orderkey * 10 + l_linenumber AS release, CASE WHEN l_orderkey % 11 > 0 THEN l_orderkey END AS master, year(l_shipdate) AS year, l_returnflag AS country, l_linenumber = 2 AS is_main, l_suppkey, l_partkey, l_quantity, l_linenumber, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag) = 1),
st AS (SELECT release, p_type AS style, r.* EXCLUDE (release) FROM r JOIN part ON l_partkey = p_partkey)"""


def _releases(s, d) -> DataFrame:
    used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"]
    li = R.keep_least(R.dealt(t(s, d, "lineitem").select(*used), "l_orderkey"), used[:2], used[2:])
    master = F.when(F.col("l_orderkey") % 11 > 0, F.col("l_orderkey"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("release"), master.alias("master"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("country"), (F.col("l_linenumber") == 2).alias("is_main"), "l_suppkey", "l_partkey", "l_quantity", "l_linenumber")


def _styles(s, d, releases: DataFrame | None = None) -> DataFrame:
    part = t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("style"))
    return (_releases(s, d) if releases is None else releases).select("release", "l_partkey").join(part, "l_partkey").select("release", "style")


_SCOPE = f"""{_RELEASES}, seed AS (SELECT DISTINCT release FROM st WHERE style IN ('PROMO', 'SMALL') AND year BETWEEN 1995 AND 2000),
ym AS (SELECT o_orderkey AS master, year(o_orderdate) AS year FROM orders),
gated AS (SELECT st.master FROM st JOIN ym ON st.master = ym.master WHERE style IN ('PROMO', 'SMALL') AND ym.year > 1996 GROUP BY 1 HAVING bool_and(style = 'PROMO')),
sm AS (SELECT DISTINCT r.master FROM r JOIN seed USING (release) WHERE r.master IS NOT NULL AND r.master NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND r.master NOT IN (SELECT master FROM gated)),
sr AS (SELECT release FROM r WHERE year BETWEEN 1995 AND 2000 AND master IN (SELECT master FROM sm) UNION SELECT release FROM seed)"""


def _scope(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Seeds, masters and releases in scope, and all releases, written once."""
    releases = written(_releases(s, d), "releases")  # used six times below
    styles = _styles(s, d, releases)
    wanted = styles.filter(F.col("style").isin("PROMO", "SMALL"))
    seeds = releases.filter(F.col("year").between(1995, 2000)).join(wanted, "release", "left_semi").select("release").distinct()
    masters = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.year("o_orderdate").alias("year"))
    quality = t(s, d, "orders").select(F.col("o_orderkey").alias("master"), F.when(F.col("o_orderstatus") == "P", "low_value").otherwise("active").alias("status"))
    scope = B.scope_masters(seeds, releases, styles, masters, quality, ["PROMO", "SMALL"], ["PROMO"], 1996)
    return seeds, scope, B.scope_releases(scope, releases, seeds, 1995, 2000), releases


@query(f"WITH {_SCOPE} SELECT master FROM sm")
def scope_masters(s, d):
    """Masters of the seeds past the quality gate (no verdict passes) and the style gate."""
    return _scope(s, d)[1]


@query(f"WITH {_SCOPE} SELECT release FROM sr")
def scope_releases(s, d):
    return _scope(s, d)[2]


@query(f"""WITH {_SCOPE}, w AS (SELECT master, count(*) AS scene_weight FROM r JOIN sm USING (master) GROUP BY 1), k AS (SELECT master FROM w WHERE scene_weight >= 4)
SELECT 'masters' AS part, count(*) AS n FROM k UNION ALL SELECT 'releases', count(*) FROM sr JOIN r USING (release) WHERE master IS NULL OR master IN (SELECT master FROM k)""")
def scope_prune(s, d):
    """What a threshold on the weight leaves: masters, and releases that still have one."""
    _, scope, rel, releases = _scope(s, d)
    weights = releases.join(scope, "master", "left_semi").groupBy("master").agg(F.count("*").alias("scene_weight"))
    kept, left = B.prune(weights, rel, releases, 4)
    return B.sizes({"masters": kept, "releases": left})


_CANON = f"""{_SCOPE}, cr AS (SELECT master, release FROM r WHERE master IN (SELECT master FROM sm) QUALIFY row_number() OVER (PARTITION BY master ORDER BY is_main DESC, year NULLS LAST, release) = 1)"""


@query(f"WITH {_CANON} SELECT master, release FROM cr")
def canonical_main(s, d):
    """The main release, else the earliest, by one partial aggregate."""
    _, scope, _, releases = _scope(s, d)
    return B.canonical_release(scope, releases)


@query(f"""WITH {_CANON}, tr AS (SELECT release, 'A' || k AS position, CASE WHEN (l_partkey + k) % 5 > 0 THEN p_name END AS title, k * 60 AS duration, l_partkey FROM r JOIN part ON l_partkey = p_partkey, (VALUES (1), (2), (3)) v(k)),
c AS (SELECT release, position, n FROM tr, (VALUES ('Bo'), ('Ann'), ('Ann')) v(n) WHERE position <> 'A3')
SELECT cr.master, tr.position, title, duration, (SELECT string_agg(DISTINCT n, ', ' ORDER BY n) FROM c WHERE c.release = tr.release AND c.position = tr.position) AS artists_text, tr.release AS source_release FROM tr JOIN cr ON cr.release = tr.release WHERE title IS NOT NULL""")
def master_tracks(s, d):
    """Titled tracks of the canonical releases with the names credited on each."""
    name = t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    _, scope, _, releases = _scope(s, d)
    canonical = written(B.canonical_release(scope, releases), "canonical")  # used twice below
    # other releases have no track in the result, so their tracks are not made
    r = releases.select("release", "l_partkey").join(canonical, "release", "left_semi").join(name, "l_partkey").select("*", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k"))
    position = F.concat(F.lit("A"), F.col("k").cast("string"))
    tracks = r.select("release", position.alias("position"), F.when((F.col("l_partkey") + F.col("k")) % 5 > 0, F.col("p_name")).alias("title"), (F.col("k") * 60).alias("duration"))
    credits = r.filter("k < 3").select("release", position.alias("position"), F.explode(F.array(F.lit("Bo"), F.lit("Ann"), F.lit("Ann"))).alias("name"))
    return B.master_tracks(canonical, tracks, credits)


@query(f"""WITH {_SCOPE} SELECT o_orderkey AS master, 'master' AS source_type, NULL::BIGINT AS source_release, 'http://v/' || o_orderkey AS url, NULL::VARCHAR AS release_url FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT master FROM sm)
UNION ALL SELECT r.master, 'release', r.release, 'http://v/' || r.master, 'https://catalog.example.org/release/' || r.release FROM r WHERE r.release % 2 = 0 AND release IN (SELECT release FROM sr) AND master IN (SELECT master FROM sm)""")
def videos_unified(s, d):
    """Videos of masters and releases in scope in one table; equal links stay."""
    _, scope, rel, releases = _scope(s, d)
    o = F.col("o_orderkey")
    own = t(s, d, "orders").filter("o_orderkey % 3 = 0").select(o.alias("master"), F.concat(F.lit("http://v/"), o.cast("string")).alias("url"), F.lit("t").alias("title"), F.lit(1).alias("duration"))
    theirs = releases.filter("release % 2 = 0").select("release", F.concat(F.lit("http://v/"), F.col("master").cast("string")).alias("url"), F.lit("t").alias("title"), F.lit(1).alias("duration"))
    return B.unified_videos(scope, own, theirs, releases, rel, "https://catalog.example.org/release/").drop("title", "duration")


@query(f"""WITH {_SCOPE}, lab AS (SELECT release, s_name AS label FROM r JOIN supplier ON l_suppkey = s_suppkey)
SELECT release, master, year, country, label, CASE WHEN l_quantity > 25 THEN 'CD' ELSE 'Vinyl' END AS format, is_main, style = 'PROMO' AS has_remix_signal, 'https://x/' || release AS url FROM st LEFT JOIN lab USING (release) WHERE release IN (SELECT release FROM sr)""")
def release_shadow(s, d):
    """Slim rows of the releases in scope: first label and format, remix signal."""
    _, _, scope_rel, releases = _scope(s, d)
    named = t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    labels = releases.join(named, "l_suppkey").select("release", "label", F.lit(1).alias("place")).unionAll(releases.select("release", F.lit("later"), F.lit(2)))
    formats = releases.select("release", F.when(F.col("l_quantity") > 25, "CD").otherwise("Vinyl").alias("format"), F.lit(0).alias("position"))
    styles = _styles(s, d, releases).withColumn("style", F.when(F.col("style") == "PROMO", "A Remix").otherwise(F.col("style")))
    return B.release_shadow(releases, scope_rel, labels, formats, styles, "https://x/")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 150 AS m FROM orders WHERE o_orderkey % 7 > 0), sc AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT g AS group_id, m AS member_id FROM e WHERE g <> m AND g IN (SELECT c_custkey FROM sc) AND m IN (SELECT c_custkey FROM sc)""")
def group_members(s, d):
    """Group and member edges with both ends in scope, no loops."""
    o = t(s, d, "orders").select(F.col("o_custkey").alias("group_id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 150).alias("member_id"))
    return B.group_members(o, t(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query(f"""WITH {_SCOPE} SELECT 'seeds' AS part, count(*) AS n FROM seed UNION ALL SELECT 'masters', count(*) FROM sm UNION ALL SELECT 'releases', count(*) FROM sr UNION ALL SELECT 'labels', count(DISTINCT l_suppkey) FROM r WHERE release IN (SELECT release FROM sr)""")
def scope_sizes(s, d):
    """Report-only sizes of a scope."""
    seeds, scope, rel, releases = _scope(s, d)
    labels = releases.join(rel, "release", "left_semi").select("l_suppkey").distinct()
    return B.sizes({"seeds": seeds, "masters": scope, "releases": rel, "labels": labels})


@query("""SELECT p_partkey, sw + mv + rv AS extra FROM (SELECT p_partkey, p_size AS sw, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS mv, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS rv FROM part) WHERE sw >= 25""")
def weight_prune_points(s, d):
    """Video points on top of a weight, and the prune on the weight alone."""
    p = t(s, d, "part").filter("p_size >= 25")
    video = F.when(F.col("p_partkey") % 2 == 0, 3).otherwise(0) + F.when(F.col("p_partkey") % 3 == 0, 3).otherwise(0)
    return p.select("p_partkey", (F.col("p_size") + video).alias("extra"))
