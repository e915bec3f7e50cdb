"""Work grows with the distinct names, not with the square of the rows that carry them: rows that the joins give out."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import relational as R, resolve as V


def joined(df):
    """The rows of df, and the rows that each of its joins gives out."""
    rows = df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            yield p.metrics().apply("numOutputRows").value()
        if kind == "AdaptiveSparkPlanExec":
            below = [p.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            below = [p.plan()]
        else:
            below = [p.children().apply(i) for i in range(p.children().size())]
        for x in below:
            yield from walk(x)

    return rows, list(walk(df._jdf.queryExecution().executedPlan()))


def test_match_within_equal_names(spark):
    """Six hundred listings of a producer against six hundred wines of two names; the best of equal names is a live one, then the least id."""
    rows = spark.createDataFrame([(i, "p", "red bolt" if i % 2 else "red bolt rouge") for i in range(600)], "key long, producer string, name string")
    known = spark.createDataFrame([(i, "p", "red bolt" if i % 3 else "cold ring", i > 10) for i in range(600)], "id long, producer string, name string, live boolean")
    got, most = joined(V.match_within(rows, known))
    assert sorted(map(tuple, got)) == [(i, 11, "exact" if i % 2 else "contained") for i in range(600)]
    assert max(most) <= 600


def test_label_match_equal_labels(spark):
    """Three hundred labels and items of one name: 300 hits a label, of which too many hold it and the least id of the producer wins."""
    labels = [(f"{p}{i}", "red bolt" if p == "a" else "bolt number", p, "FR") for p in "abc" for i in range(300)]
    known = [(i, "red bolt" if i < 300 else f"bolt number {i}", "same", "a" if i < 300 else "z", "FR", True) for i in range(600)]
    got, most = joined(V.label_match(spark.createDataFrame(labels, "key string, label string, producer string, country string"), spark.createDataFrame(known, "id long, name string, display_name string, producer string, country string, live boolean")))
    assert sorted(map(tuple, got)) == sorted((k, 0 if k[0] == "a" else None, "producer_exact" if k[0] == "a" else "too_many") for k, *_ in labels)
    assert max(most) <= 5000


def test_match_cascade_equal_names(spark):
    rows = spark.createDataFrame([(i, "Red Bolt", "FR" if i % 2 else None) for i in range(300)], "key long, name string, country string")
    known = spark.createDataFrame([(i, "red bolt", "Red Bolt", "FR", i % 7) for i in range(300)], "id long, name string, display_name string, country string, weight long")
    got, most = joined(V.match_cascade(rows, known))
    assert sorted((r["key"], r["id"], r["method"], r["candidates"]) for r in got) == [(i, 6, "exact_ambiguous", 300) for i in range(300)]
    assert max(most) <= 3000


def test_merge_candidates_makes_pairs_once(spark):
    """The pairs come out of one join, in the first block that both share, and go through no other."""
    known = spark.createDataFrame([(i, "domaine red bolt" if i % 2 else "red bolt", None, "FR", i % 5) for i in range(120)], "id long, key string, title string, country string, weight int")
    evidence = spark.createDataFrame([(i, "north", ["x"]) for i in range(0, 120, 3)] + [(i, None, None) for i in range(1, 120, 3)], "id long, region string, subs array<string>")
    got, most = joined(V.merge_candidates(known, evidence))
    assert len(got) == len({(r["keep_id"], r["merge_id"]) for r in got}) == 120 * 119 // 2
    assert sum(r["rule"] == "same_norm" for r in got) == 60 * 59 and sum(r["class"] == "auto" for r in got) == 40 * 39 // 2
    assert sum(n >= len(got) for n in most) == 1


def test_dealt_join_spreads_one_key(spark):
    """Rows of a single key are joined by many tasks; the result is the plain join's."""
    left = spark.createDataFrame([(i, "k" if i else None) for i in range(40)], "a long, w string")
    right = spark.createDataFrame([(i, "k") for i in range(1000)] + [(7, "k"), (1, None)], "b long, w string")
    df = R.dealt_join(left, right, ["w"], 50)
    assert sorted(map(tuple, df.select("a", "b").collect())) == sorted((a, b) for a in range(1, 40) for b in [*range(1000), 7])
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 39 * 1001 / 2


def test_split_sections_shuffles_no_text(spark):
    """Repeated heads and short books, each document in its own row, without a shuffle; garbled counts as before."""
    head, body = "\nCahier des charges de l'appellation d'origine contrôlée « {} »\n", "Texte du cahier. " * 200
    texts = [head.format("Côtes") + "x" + head.format("Côtes") + body + head.format("Bourg  A") + body, head.format("B") + body + head.format("C") + "x" + head.format("B") + body, head.format("B") + "x", "none", None]
    df = V.split_sections(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), "doc")
    got = sorted((r["doc"], r["start"], r["slug"], r["names"], r["section"]) for r in df.collect())
    b, c, a = (head.format(x)[1:] for x in ("B", "Côtes", "Bourg  A"))
    assert [g[:4] for g in got] == [(0, 0, "cotes", ["Côtes"]), (0, 2, "bourg-a", ["Bourg A"]), (1, 0, "b", ["B"]), (1, 2, "b", ["B"])]
    assert [g[4].strip() for g in got] == [(c + "x\n" + c + body).strip(), (a + body).strip(), (b + body).strip(), (b + body).strip()]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    odd = ["é" * 199, "é" * 200, "#% 12 " * 500, "a \t\n\x0b\f\r1" * 120 + "a" * 70, "ab1\u00a0" * 99, None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in odd], "t string").select(V.garbled(F.col("t"))).collect()] == [True, False, True, False, True, None]


def test_strip_legal_makes_its_words_once(spark):
    """The split into words stands once in the expression; odd names stay as they were."""
    from quarry.functions import text as T

    cases = [("AOC Cahors DOC", "Cahors"), ("DOC DOCG", "DOC"), ("", None), ("  ", None), (None, None), ("Cahors, - DOC", "Cahors"), ("IGP xy", None), ("Chianti D.O.C.G. AOC", "Chianti D.O.C.G.")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "n string").select("n", T.strip_legal(F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == [w for _, w in cases]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 5


def test_dealt_bounds_the_rows_of_a_task(spark):
    """Rows are dealt over as many partitions as they need, a join on the key keeps them, and adaptive execution does not join them again."""
    rows = spark.range(20000).select((F.col("id") % 5000).alias("k"), "id")
    other = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("one")).hint("merge")
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    dealt = R.dealt(rows, "k", most=500).join(other, "k")
    assert dealt.count() == 20000 and most(dealt) < 1000 < most(rows.join(other, "k"))
    assert R.dealt(rows, "k", most=20000) is rows


def test_scope_queries_derive_releases_once(spark):
    """The rest of a scope's plan reads the releases that were written, and no line again."""
    from quarry.plans import build

    for q in (build.master_tracks, build.scope_prune, build.scope_sizes, build.videos_unified):
        assert "l_shipdate" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString(), q.__name__


def test_listed_pairs_shuffle_lists_only(spark):
    """The pairs of an asked id lie in one partition: they are those of the plain join, and grouping them shuffles none."""
    left = spark.createDataFrame([(g, i) for g in range(4) for i in range(g, 30, 5)] + [(9, 1)], "g long, id long")
    right = spark.createDataFrame([(g, a) for g in range(4) for a in range(g * 60, 400)], "g long, a long")
    got = R.listed_pairs(left, right, "g", "id", "a", most=50, pairs=500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "g").select("id", "a").collect()))
    n = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert n(got.groupBy("id", "a").count()) == n(got.select("id"))  # neither has run, so each plan is printed once
    none = R.listed_pairs(left.filter("g > 8"), right, "g", "id", "a")
    assert none.count() == 0


def test_group_bandmates_lie_by_mate(spark):
    """Rows of a mate follow each other, so that their columns are runs in a file."""
    from quarry.plans import entities

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        rows = entities.group_bandmates(spark, "/root/testdata/sf0.01").select("mate").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs = 1 + sum(a["mate"] != b["mate"] for a, b in zip(rows, rows[1:]))
    assert runs == len({r["mate"] for r in rows})


def test_artist_groups_deals_its_pairs(spark):
    """However well the bandmates compress, their pairs are placed by many tasks, not by the one that adaptive execution would leave."""
    from quarry.plans import entities

    rows = entities.artist_groups(spark, "/root/testdata/sf0.01").filter("kind = 'bandmate'")
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 6 and max(parts) < sum(parts) / 3


def test_collaborators_meet_once(spark):
    """The meetings are written before they are counted, so the rest of the plan joins no credits again; aliases and repeated roles as before."""
    from quarry.operators import entities as E
    from quarry.plans import entities

    assert "l_orderkey" not in entities.collaborators(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    credits = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 1, "B"), (3, 1, "B"), (3, 1, "A"), (2, 2, "A"), (4, 2, "C"), (3, 2, "B"), (5, 3, "A"), (None, 1, "A")], "artist_id long, master_id long, role string")
    aliases = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (7, 7)], "id long, other long")
    assert sorted(map(tuple, E.collaborators(credits, aliases).collect())) == [(1, 3, 2, "B,A", 1), (1, 4, 1, "C", 2)]


def test_labelmates_of_big_labels(spark):
    """A label of nine hundred masters, of which the asked artist has two: all its artists are mates but the barred one; smaller blocks say the same."""
    from quarry.operators import entities as E

    masters = [("big", 100 + i // 3, i) for i in range(900)] + [("big", 1, 900), ("big", 1, 901), ("low", 1, 902), ("low", 1, 903), ("low", 100, 904), ("low", 100, 905), ("low", 100, 905), ("one", 1, 906), ("one", 7, 907), (None, 1, 908), ("low", None, 909)]
    frames = [spark.createDataFrame(x, y) for x, y in ((masters, "label string, artist_id long, master_id long"), ([(1,), (2,)], "id long"), ([(1, 101), (2, 102), (1, 5)], "id long, other long"))]
    got = {(r["id"], r["mate"]): tuple(r)[2:] for r in E.labelmates(*frames).collect()}
    assert sorted(got) == [(1, 100 + i) for i in range(300) if i != 1]
    assert got[1, 100][:2] == (2, 4) and got[1, 100][3] == "big,low" and abs(got[1, 100][2] - (2 / 902**0.5 + 2 / 5**0.5)) < 1e-9
    assert got[1, 102][:2] == (1, 2) and got[1, 102][3] == "big"


def test_meetings_are_the_plain_join(spark):
    """Any number of blocks and units at once, keys and units on many rows, nulls, rows that meet nothing: each unit and key together, once."""
    from quarry.operators.meetings import meetings

    asked = spark.createDataFrame([(f"g{i % 7}" if i % 11 else None, i % 23, i) for i in range(300)], "g string, id long, x long")
    rows = spark.createDataFrame([(f"g{i % 9}" if i % 13 else None, i % 31, i) for i in range(500)], "g string, u long, y long")

    def fold(met):
        first = met.grouped()
        many = [len(x) for x in np.split(met.r, first[1:])]
        return [met.row["u"].to_numpy()[met.r[first]], met.keys[met.key[met.a[first]]], many, np.add.reduceat(met.asked["x"][met.a] * met.row["y"].to_numpy()[met.r], first)]

    want = asked.join(rows, "g").groupBy("u", "id").agg(F.count("*"), F.sum(F.col("x") * F.col("y"))).collect()
    for block, most in ((1 << 20, 1 << 20), (40, 1), (100, 500)):
        got = meetings(asked, rows, "g", "id", "u", fold, "u long, id long, n long, s long", block=block, pairs=1000, most=most).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert meetings(asked.filter("id < 0"), rows, "g", "id", "u", fold, "u long, id long, n long, s long").collect() == []


def test_labelmates_idf_shuffles_no_lists(spark):
    """Pairs are made where an artist's labels lie: no list of artists is made, sent or unfolded."""
    from quarry.operators import entities as E
    from quarry.plans import entities

    plan = entities.labelmates_idf(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan
    asked = spark.createDataFrame([("a", 20, 0.5), ("b", 20, 2.0), ("b", 40, 2.0), (None, 20, 1.0)], "label string, id long, idf double")
    members = spark.createDataFrame([("a", 20), ("a", 3), ("b", 3), ("b", 20), ("b", 40), ("c", 5), (None, 3), ("b", None)], "label string, artist long")
    assert sorted(map(tuple, E.labelmates_idf(asked, members).collect())) == [(20, 3, 2, 2.5), (20, 40, 1, 2.0), (40, 3, 1, 2.0), (40, 20, 1, 2.0)]
