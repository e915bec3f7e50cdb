"""Search over the index against a plain ranker, early stop against ranking all, and a written index."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import covers as V, search as S


def covers(n, doc):
    """doc: [(position, weight, tokens)] -> the rank, by looking for each smallest cover in turn."""
    total, first = 0.0, 0
    while first < len(doc):
        seen, end = set(), None
        for k in range(first, len(doc)):
            seen |= doc[k][2]
            if len(seen) == n:
                end = k
                break
        if end is None:
            return total
        seen, begin = set(), end + 1
        while len(seen) < n:
            begin -= 1
            seen |= doc[begin][2]
        inside = doc[begin : end + 1]
        total += len(inside) / sum(1 / w for _, w, _ in inside) / (1 + doc[end][0] - doc[begin][0] - (end - begin))
        first = begin + 1
    return total


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(texts, entities):
    """All matches of each text: (q, type, id) -> raw rank; entities: (type, id, title, body), weights 1.0 and 0.2."""
    out = {}
    for q in texts:
        asked = tokens(q)[:12]
        for kind, id_, title, body in entities:
            words = [(w, 1.0) for w in tokens(title)] + [(w, 0.2) for w in tokens(body)]
            hits = [(p + 1, g, {i for i, a in enumerate(asked) if w == a or (i == len(asked) - 1 and w.startswith(a))}) for p, (w, g) in enumerate(words)]
            hits = [h for h in hits if h[2]]
            if asked and (r := covers(len(asked), hits)) > S.LEAST_RANK:
                out[q, kind, id_] = r
    return out


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    words = lambda k: " ".join(rnd.choices("a an ant anthem bee beet cat the The of".split(), weights=[6, 4, 2, 1, 3, 1, 2, 20, 5, 20], k=k))
    entities = [(rnd.choice("xy"), i, rnd.choice([None, words(rnd.randrange(4))]), words(rnd.randrange(40))) for i in range(150)] + [("x", 1000, None, None), ("y", 1001, "", "the " * 3000 + "bee")]
    texts = [words(rnd.randrange(1, 4)) for _ in range(40)] + ["the the", "an an", "the be", "zebra", "!!", "The, an", "a an ant anthem bee beet cat the of an a the of the the"]
    return spark.createDataFrame(entities, "type string, id long, title string, body string"), sorted(set(texts)), plain(set(texts), entities)


def test_match_against_plain(spark, data):
    entities, texts, want = data
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (901, None)], "qid long, q string")
    got = {(r["qid"], r["type"], r["id"]): r["raw_rank"] for r in S.match(queries, S.index(entities, {"title": "A", "body": "C"})).collect()}
    assert got == pytest.approx({(i, k, d): r for i, t in [*enumerate(texts), (900, texts[0])] for (q, k, d), r in want.items() if q == t})
    assert len({round(r, 6) for r in got.values()}) > 50
    assert S.match(queries.limit(0), S.index(entities, {"title": "A"})).collect() == []
    assert S.match(queries, S.index(entities.limit(0), {"title": "A"})).collect() == []


@pytest.mark.parametrize("block", [1, 3, 128])
def test_early_stop(spark, data, monkeypatch, tmp_path, block):
    """The best rows are those of ranking all, from an index on disk, with lists of many blocks and of several runs."""
    entities, texts, want = data
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "PART", 40)
    S.write_index(entities, {"title": "A", "body": "C"}, str(tmp_path / "i"))
    made = S.read_index(spark, str(tmp_path / "i"))
    assert made.lists.filter(F.size("docs") > block).isEmpty()
    got = S.top_texts(spark.createDataFrame([(t,) for t in texts], "q string"), made, 5).collect()
    best = {}
    for (q, k, d), r in want.items():
        best.setdefault(q, []).append((-r, -d, k))
    want_rows = sorted((q, i + 1, -d) for q, rows in best.items() for i, (_, d, _) in enumerate(sorted(rows)[:5]))
    assert sorted((r["q"], r["place"], r["id"]) for r in got) == want_rows


@pytest.mark.parametrize("words", [20, 1 << 21])
def test_top_covers(spark, data, monkeypatch, words):
    """Shares of the texts give the best rows of ranking all, whatever number of words is inverted at once; blocks of queries add up."""
    entities, texts, want = data
    monkeypatch.setattr(V, "QUERIES", 20)
    odd = entities.union(spark.createDataFrame([("x", None, "zz", "zzz"), (None, -1, None, "zz")], entities.schema))
    got = V.top_covers(spark.createDataFrame([("zz",)], "q string"), odd, {"title": "A", "body": "C"}, 5).collect()
    best = {}
    for (q, k, d), r in want.items():
        best.setdefault(q, []).append((-r, -d, k))
    want_rows = {(q, i + 1, -d): -r for q, rows in best.items() for i, (r, d, _) in enumerate(sorted(rows)[:5])}
    assert [(r["id"], round(r["raw_rank"], 9), r["place"]) for r in got] == [(None, 1.2, 1), (-1, 0.2, 2)]
    plain = V.top_covers(spark.createDataFrame([(t,) for t in texts], "q string"), entities, {"title": "A", "body": "C"}, 5, words).collect()
    assert {(r["q"], r["place"], r["id"]): r["raw_rank"] for r in plain} == pytest.approx(want_rows)
    assert V.top_covers(spark.createDataFrame([], "q string"), entities, {"title": "A"}, 5).collect() == []
    assert V.top_covers(spark.createDataFrame([("an",)], "q string"), entities.limit(0), {"title": "A"}, 5).collect() == []


def test_covers_stop_early():
    """Texts that can't reach the last of the best are not ranked."""
    import pyarrow as pa

    held = V.Postings([(pa.array([["a", "b"] * 50] * 10 + [["a", "x", "b"]] * 500, pa.list_(pa.string())), 1.0)], 510)
    ranked = []
    plain = held.ranks
    held.ranks = lambda tokens, docs: ranked.append(len(docs)) or plain(tokens, docs)
    docs, rank = V.best_of(held, ["a", "b"], 10, 0.0, 1.0)
    assert docs.tolist() == list(range(10)) and rank.tolist() == [99.0] * 10
    assert sum(ranked) == 40


def test_search_covers_builds_no_index(spark):
    """The texts are cut into words in one place of the plan; no list of blocks is written before it."""
    from quarry.plans import search

    plan = search.search_covers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "block" not in plan


def test_bounds_hold(spark, data):
    """No entity ranks above n * forms * bound of a block that holds it."""
    entities, texts, want = data
    made = S.index(entities, {"title": "A", "body": "C"})
    rows = S._anchors(spark.createDataFrame([(t,) for t in texts], "q string"), made.lists).join(made.lists, "token")
    top = {}
    for r in rows.select("q", (F.size("t") * F.col("forms") * F.col("bound")).alias("b"), F.explode("docs").alias("x")).collect():
        key = (r["q"], r["x"]["type"], r["x"]["id"])
        top[key] = max(top.get(key, 0), r["b"])
    assert all(r <= top[key] + 1e-9 for key, r in want.items()) and set(want) <= set(top)


def fragments(text, asked, least=25, width=60, most=3):
    w = text.split()
    hits = [(p, {i for i, a in enumerate(asked) if re.sub(r"[\W_]+", "", x.lower()).startswith(a)}) for p, x in enumerate(w)]
    hits = [h for h in hits if h[1]]
    every = set().union(*[i for _, i in hits]) == set(range(len(asked)))
    covers, first = [], 0
    for k, (e, _) in enumerate(hits):
        begins = [max((p for p, i in hits[: k + 1] if a in i), default=-1) for a in range(len(asked))] if every else [e]
        if min(begins) >= first:
            covers.append((min(begins), e))
            first = min(begins) + 1
    best = {}
    for b, e in covers:
        if b // width not in best or e - b < best[b // width][0]:
            best[b // width] = (e - b, b)
    chosen = []
    for size, b in sorted(best.values()):
        n = min(width, max(least, size + 1))
        s = max(0, min(b - (n - size - 1) // 2, len(w) - n))
        if len(chosen) < most and all(not (x < s + n and s < x + m) for x, m in chosen):
            chosen.append((s, n))
    return " ... ".join(" ".join(w[s : s + n]) for s, n in sorted(chosen)) if chosen else " ".join(w[:width])


def test_headline(spark):
    """Fragments around the smallest covers, of texts with many, few and no covers, against a plain search."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["alpha", "Beta,", "betas", "x", "(alphabet)"], weights=[1, 1, 1, 60, 1], k=rnd.randrange(500))) for _ in range(60)]
    texts += ["", " \n ", "alpha beta", "alpha " + "x " * 90 + "beta", "beta " * 200, "x " * 300]
    d = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, text string")
    for q in ("alpha beta", "alpha", "zeta", "beta alpha zeta"):
        got = {r["id"]: r["headline"] for r in S.headline(d, F.lit(q)).collect()}
        assert got.pop(999) is None
        assert got == {i: fragments(t, q.split()) for i, t in enumerate(texts)}


def test_fan_out_takes_all_hits(spark):
    """Every hit of a type takes part unless a number a type is asked for; bad rows go."""
    found = spark.createDataFrame([("hot", "master", i, "hot ring", 1.0) for i in range(30)] + [("hot", "artist", 7, "a hot", 1.0)], "q string, type string, id long, name string, raw_rank double")
    got = [(r["type"], r["id"]) for r in S.fan_out(found, 20).orderBy("place").collect()]
    assert got == [("master", i) for i in range(29, 9, -1)]
    bad = spark.createDataFrame([("master", 29)], "type string, id long")
    got = [(r["type"], r["id"]) for r in S.fan_out(found, 20, bad, 3).orderBy("place").collect()]
    assert got == [("master", 28), ("master", 27), ("artist", 7)]


def test_ranked_indexes_what_can_be_shown(spark, monkeypatch):
    """Of equal entities only as many as a page and its has_more need are indexed; the pages are those of all."""
    made = []
    plain = S.index
    monkeypatch.setattr(S, "index", lambda e, f: made.append(e.count()) or plain(e, f))
    names = ["hot ring", "hot rink", "cold ring"]
    entities = spark.createDataFrame([("x" if i % 2 else "y", i, names[i % 3], "a" if i < 300 else "b") for i in range(600)], "type string, id long, name string, note string")
    got = S.ranked(spark.createDataFrame([(1, "hot rin"), (2, "hot rin"), (3, "ring"), (4, "cold rink")], "qid long, q string"), entities, {"name": "A"}, "name", 5)
    rows = sorted((r["qid"], r["type"], r["place"], r["id"], r["has_more"]) for r in got.collect())
    want = []
    for qid, ok in ((1, lambda i: i % 3 < 2), (2, lambda i: i % 3 < 2), (3, lambda i: i % 3 != 1)):
        for kind, odd in (("x", 1), ("y", 0)):
            # a name that begins with the query gets a boost; "ring" begins none
            ids = sorted((i for i in range(600) if i % 2 == odd and ok(i)), reverse=True)[:5]
            want += [(qid, kind, k + 1, i, True) for k, i in enumerate(ids)]
    assert rows == sorted(want) and made == [2 * 3 * 6]


def test_match_deals_its_pairs(spark, monkeypatch):
    """Pairs above the number of a task are dealt by entity over many; the matches stay."""
    entities = spark.createDataFrame([("x", i, f"hot r{i}") for i in range(400)], "type string, id long, name string")
    asked, made = spark.createDataFrame([("hot r",), ("r1 hot",)], "q string"), S.index(entities, {"name": "A"})
    plain = sorted(map(tuple, S.match_texts(asked, made).collect()))
    monkeypatch.setattr(S, "PAIRS", 50)
    got = S.match_texts(asked, made)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(tuple, got.collect())) == plain and len(plain) == 401 and len(sizes) >= 8 and max(sizes) < 150


def test_first_texts_set_the_least_rank(spark, monkeypatch):
    """Two tokens by the neighbours of the rarer one, and a first pass over some texts whose ranks let the others be passed over: the same rows, ties too."""
    rnd = random.Random(5)
    words = "an and ant bee beet cat dog elk".split()
    texts = [("d", i, " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))) for i in range(400)] + [("d", i, "cat bee cat bee") for i in range(400, 430)]
    entities = spark.createDataFrame(texts, "type string, id long, body string")
    asked = spark.createDataFrame([(f"{a} {b}",) for a in words[1:] for b in ("a", "be", "bee", "zz", "do")], "q string")
    rows = lambda df: sorted((r["q"], r["id"], r["raw_rank"], r["place"]) for r in df.collect())
    want = rows(V.top_covers(asked, entities, {"body": "B"}, 3))
    monkeypatch.setattr(V, "SHARE", 100)
    got = rows(V.top_covers(asked, entities, {"body": "B"}, 3, first=4))
    assert got == want and len(want) > 60
    held = V.Postings([(pa.array([t.split() for *_, t in texts]), 0.4)], len(texts))
    for q in ("cat bee", "bee cat", "and d", "dog an", "elk elk"):
        a, b = q.split()
        if not a.startswith(b):
            sides = held.whole(a), held.prefix(b)
            docs = np.flatnonzero(np.minimum(sides[0][1], sides[1][1]))
            for some in (docs, docs[::3]):
                thrice = held.ranks([*sides, sides[0]], some)  # a token named twice goes the general way
                assert held.two_ranks(sides[0][0], sides[1][0], some).tolist() == thrice.tolist()
        every, kept = V.best_of(held, [a, b], 10, 0.0, 0.4), V.best_of(held, [a, b], 10, 1.0, 0.4)
        assert [x for x in zip(*every, strict=True) if x[1] >= 1.0] == list(zip(*kept, strict=True))
