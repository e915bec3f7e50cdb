"""The anchor join against containment over all pairs, and the operators on top of it."""

import random

from pyspark.sql import functions as F

from quarry.operators import resolve as V
from quarry.operators.phrases import phrase_hits


def holds(text, phrase):
    return bool(phrase) and f" {' '.join(phrase)} " in f" {' '.join(text)} "


def test_hits_against_all_pairs(spark):
    """Texts and phrases of any length, hot words, repeated words, blocks, nulls and empty lists."""
    rnd = random.Random(1)
    words = lambda most: rnd.choices("the of a bb cc dd ee ff gg hh".split(), weights=[30, 20, 10, 3, 2, 2, 1, 1, 1, 1], k=rnd.randrange(most))
    texts = [(i, i % 3, words(60)) for i in range(80)]
    phrases = [(f"p{i}", rnd.randrange(3), words(5)) for i in range(80)]
    phrases += [(f"long{i}", i % 3, texts[i][2][2 : 2 + 12 + i]) for i in range(12)] + [("missing", 0, ["the", "zz"]), ("none", 1, []), ("null", 1, None)]
    x = spark.createDataFrame([*texts, (900, 1, None), (901, 1, [])], "text long, b int, words array<string>")
    y = spark.createDataFrame(phrases, "phrase string, b int, words array<string>")
    got = {tuple(r) for r in phrase_hits(x, y, ("b",)).collect()}
    assert got == {(b, t, p) for t, b, w in texts for p, c, q in phrases if b == c and q and holds(w, q)} and len(got) > 60
    got = {tuple(r) for r in phrase_hits(x.drop("b"), y.drop("b")).collect()}
    assert got == {(t, p) for t, _, w in texts for p, _, q in phrases if q and holds(w, q)}
    assert phrase_hits(x.limit(0), y).collect() == [] and phrase_hits(x, y.limit(0)).collect() == []


def test_long_names(spark):
    """A name of ten words that stands whole in the rule text; null where a text names nothing."""
    name = "Malvasia di Castelnuovo Don Bosco nera lunga del colle alto"
    texts = spark.createDataFrame([(1, f"Si usano {name.upper()}, e altro."), (2, "Malvasia di Castelnuovo Don Bosco nera lunga"), (3, "Dolcetto e " + name)], "doc long, text string")
    varieties = spark.createDataFrame([(d, g, n) for d in (1, 2, 3) for g, n in ((1, name), (2, "Dolcetto"), (3, "Nero"))], "doc long, grape long, name string")
    got = {(r["doc"], r["grape"]): r["named"] for r in V.named_in_rules(texts, varieties).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): False, (2, 1): None, (2, 2): None, (2, 3): None, (3, 1): True, (3, 2): True, (3, 3): False}
    labels = spark.createDataFrame([(7, f"La {name} riserva")], "key long, label string")
    known = spark.createDataFrame([(4, name), (5, "riserva speciale")], "id long, name string")
    assert [tuple(r) for r in V.contained(labels, known, 8).collect()] == [(7, 4)]


def test_label_match(spark):
    """Order of the stages, ties, countries, codes of indications, and more than fifty candidates."""
    known = [(1, "cru des pierres", "domaine cru des pierres", "p1", "FR", True), (2, "les pierres", "les pierres", "p2", "FR", False), (3, "les pierres", "les pierres", "p3", "IT", True), (4, "grand champ des oiseaux", "x grand champ des oiseaux", None, None, True)]
    known += [(100 + i, f"hautes terres lot {i}", f"hautes terres lot {i}", "p9", "FR", True) for i in range(51)]
    labels = [
        ("own", "Cru des Pierres", "p1", "FR"), ("inside", "Domaine Cru des Pierres Vieilles Vignes", "p1", None), ("equal", "Les Pierres", "p1", "FR"), ("live", "Les Pierres", None, None),
        ("wide", "champ des oiseaux", "nobody", "DE"), ("many", "Hautes Terres", None, "FR"), ("few", "hautes terres lot 7", None, "FR"), ("code", "Les Pierres AOC", "p2", "FR"), ("short", "champ des", None, None), ("blank", "...", None, None), ("away", "Les Pierres", None, "DE"),
    ]
    k = spark.createDataFrame(known, "id long, name string, display_name string, producer string, country string, live boolean")
    rows = V.label_match(spark.createDataFrame(labels, "key string, label string, producer string, country string"), k).collect()
    assert {r["key"]: (r["id"], r["method"]) for r in rows} == {
        "own": (1, "producer_exact"), "inside": (1, "producer_contains"), "equal": (2, "exact"), "live": (3, "exact"), "wide": (4, "contains"), "many": (None, "too_many"),
        "few": (107, "exact"), "short": (None, "none"), "away": (None, "none"),
    }
    assert len(rows) == 9


def test_anchor_is_rare(spark):
    """A hot word alone is joined only for phrases that have no rarer one."""
    texts = spark.range(200).select(F.col("id").alias("text"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id").cast("string")), F.lit("the")).alias("words"))
    phrases = spark.range(200).select(F.col("id").alias("phrase"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("words"))
    assert sorted(map(tuple, phrase_hits(texts, phrases).collect())) == [(i, i) for i in range(200)]


def test_rule_texts_do_not_depend_on_row_order(spark, monkeypatch, tmp_path):
    """varieties_named reads its texts twice; rows in another order must give the same texts."""
    from quarry.plans import resolve as P

    texts = []
    monkeypatch.setattr(P.V, "named_in_rules", lambda t, v: texts.append(sorted(map(tuple, t.collect()))) or v)
    for way in ("asc", "desc"):
        for name, key in (("orders", "o_orderkey"), ("lineitem", "l_partkey"), ("part", "p_partkey")):
            df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
            df.coalesce(1).sortWithinPartitions(getattr(F, way)(key)).write.parquet(str(tmp_path / way / f"{name}.parquet"))
        P.varieties_named(spark, str(tmp_path / way))
    assert texts[0] == texts[1] and len(texts[0]) > 100


def test_named_in_rules_shuffles_no_words(spark):
    """Forms are looked up in their own text where both lie; parts of words, repeated grapes, missing texts and null names as before."""
    texts = spark.createDataFrame([(1, "Pinot noir, Pinots blancs."), (2, None), (4, "Merlot")], "doc long, text string")
    varieties = spark.createDataFrame([(1, 1, "Pinot noir N"), (1, 1, "zzzzzz"), (1, 2, "Pinots blanc"), (1, 3, None), (1, 4, "Pino"), (2, 1, "Merlot"), (3, 1, "Merlot"), (4, 1, "merlot")], "doc long, grape long, name string")
    df = V.named_in_rules(texts, varieties)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (2, 1, None), (3, 1, None), (4, 1, True)]
