"""Ranked search, periodic runs and I-Match fingerprints against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import imatch, lexical, queries, runs
from quarry.llm.common import terms

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = "item_id long, term string, n int, terms string, tfs string, score double, rank int, block int, part int, guest int, fingerprint string, runs string, start long, length long, period long, collapsed string, h long, w string, g long, a int, p int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, texts, ids=None):
    d = spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string")
    return d.select("*", *[F.lit("7").try_cast(f.split()[1]).alias(f.split()[0]) for f in CLASH.split(", ")])


def ranked(texts, items, top=10):
    """texts: (doc_id, text); items: (item_id, text) -> the contract's rows, term by term."""
    own = [(d, Counter(TERM.findall(lower(t)))) for d, t in texts]
    own = [(d, c) for d, c in own if c]
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


WORDS = ["a", "B", "b", "cé", "d9", "Ω", "x", "y.z", "Q_q", "the"]


def test_search_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(WORDS, weights=range(10, 0, -1), k=rnd.randrange(40))) for _ in range(300)]
    texts += [None, "", " .,! ", texts[0], texts[0], "the " * 200_000, "a-b_c\x00d\x7fé"]
    ids = [rnd.randrange(10**12) for _ in texts[:-2]] + [-5, 7]
    ids[3] = ids[4]  # a repeated id
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(6)))) for i in range(30)] + [(3, "x y"), (99, None), (100, "nowhere")]
    q = spark.createDataFrame([*items, (None, "a")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = lexical.search(docs(spark, texts, ids).repartition(5), q)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == ranked(list(zip(ids, texts, strict=True)), items)


def test_search_in_blocks_and_chunks(spark, monkeypatch):
    """Small blocks and chunks give the same rows as one of each."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randrange(30))) for _ in range(80)]
    items = [(i, " ".join(rnd.choices(WORDS, k=4))) for i in range(25)]
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 12)
    monkeypatch.setattr(lexical, "CHUNK", 3)
    got = lexical.search(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert sorted(map(tuple, got.collect())) == ranked(list(enumerate(texts)), items, 3)


def test_search_edges(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert lexical.search(docs(spark, ["a"]), none).collect() == []
    assert lexical.search(docs(spark, ["a"]).limit(0), one).collect() == []
    assert lexical.search(docs(spark, [None, " "]), one).collect() == []
    got = lexical.search(docs(spark, ["a a", "a b", "a b"], [4, None, 4]), one).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, None), (2, 4), (3, 4)]


@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 300), st.integers(0, 10**12)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_accumulate(rows):
    want = Counter()
    for i, d, s in rows:
        want[i, d] += s
    cols = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    got = lexical.accumulate(*cols) if rows else ([], [], [])
    assert list(zip(*(list(map(int, x)) for x in got), strict=True)) == [(*k, v) for k, v in sorted(want.items())]


def plain_runs(words, exponent=4, least=6):
    """All maximal repetitions by the definition: for each period, the stretches where words a period apart agree."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=6), max_size=4), st.sampled_from([(4, 6), (2, 1), (3, 4)]))
@settings(max_examples=400, deadline=None)
def test_runs_against_definition(texts, kind):
    """Texts of repeated stretches, several in one batch; runs of other exponents as well."""
    words = [[b"%d" % w for stretch, times in t for w in stretch * times] for t in texts]
    got = runs.find_runs(words, *kind)
    assert [sorted(r) for r in got] == [plain_runs(w, *kind) for w in words]


def test_suffix_arrays_and_factors():
    """Suffix array, LCP and longest previous factors against their definitions."""
    rnd = random.Random(5)
    for _ in range(200):
        x = [rnd.randrange(3) for _ in range(rnd.randint(1, 40))]
        dense = np.unique(x, return_inverse=True)[1]
        levels = runs.name_levels(dense, np.zeros(len(x), np.int64))
        sa = np.empty(len(x), np.int64)
        sa[levels[-1][:-1]] = np.arange(len(x))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = lambda i, j: next((k for k in range(len(x) - max(i, j)) if x[i + k] != x[j + k]), len(x) - max(i, j))
        lcp = np.array([0] + [common(a, b) for a, b in zip(sa, sa[1:], strict=False)])
        length, source = runs.longest_previous(sa, lcp)
        assert length == [max([common(j, i) for j in range(i)], default=0) for i in range(len(x))]
        assert all(n == 0 or (source[i] < i and common(source[i], i) == n) for i, n in enumerate(length))


def edited_words(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_op12_against_definition(spark, tmp_path):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["é", "b", "c"], k=rnd.randrange(60))) for _ in range(150)] + [None, "", " \t\n", "a a a a a a", "w " * 3000 + "x", "\x0bone\x0ctwo\rthree  four "]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        w = edited_words(d, t)
        found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best), d
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest() and r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()


def test_run_edges(spark):
    assert runs.periodic_runs(docs(spark, ["a"]).limit(0)).collect() == []
    got = runs.periodic_runs(docs(spark, [None, "", "a a a a a a a", "a a a a a a a"], [1, None, 3, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in got) == [(0, 0, "", []), (1, 0, "", []), (3, 7, "a", [(0, 7, 1)]), (3, 7, "a", [(0, 7, 1)])]
    long = runs.periodic_runs(docs(spark, ["lorem ipsum dolor " * 100_000 + "end"])).collect()[0]
    assert (long["n_words"], [tuple(x) for x in long["runs"]], long["collapsed"]) == (300_001, [(0, 300_000, 3)], "lorem ipsum dolor end")


def test_imatch_against_plain_counts(spark, tmp_path):
    """Band, order, edited texts, fingerprints and likeness, with the band's terms counted plainly."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows] + [None, "", "?!", "only", rows[0]["text"], "word " * 100_000]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_imatch(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    df = Counter(w for t in texts for w in set(terms(t)))
    band = np.sort(imatch._hashed([w for w, n in df.items() if n * 2**imatch.HIGH >= len(texts) and n * 2**imatch.LOW <= len(texts)]))
    assert (imatch.lexicon(docs(spark, texts)) == band).all()
    for d, t in enumerate(texts):
        t, after = t or "", texts[(d + 1) % len(texts)] or ""
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other, following = (imatch.fingerprint(x, band) for x in (t, changed, after))
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
        assert (r["near_edited"], r["near_next"]) == (imatch.likeness(own, other), imatch.likeness(own, following))
    plain = [r for d, r in got.items() if d < len(rows) - 1]
    assert got[0]["fingerprint"] == got[len(texts) - 2]["fingerprint"]
    assert sum(r["near_edited"] for r in plain) / len(plain) > 0.15 > 0.02 > sum(r["near_next"] for r in plain) / len(plain)


def test_likeness():
    """Near the Jaccard similarity of the terms; the prints of one subset are equal when its terms are."""
    rnd = random.Random(7)
    none = np.zeros(0, np.uint64)
    for shared in (0, 40, 80, 120):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(240)]
        a, b = " ".join(base[: 120]), " ".join(base[120 - shared : 240 - shared])
        jaccard = shared / (240 - shared)
        assert abs(imatch.likeness(imatch.fingerprint(a, none), imatch.fingerprint(b, none)) - jaccard) < 0.25
    f = imatch.fingerprint
    assert imatch.likeness("", "") == 1 and imatch.likeness("", f("a", none)) == 0 and f("a b", none) == f("b, A a", none) != f("?", none) != f("!", none)


@pytest.mark.parametrize("partitions", [1, 7])
def test_imatch_edges(spark, partitions):
    one = imatch.with_next(docs(spark, ["ab cd"], [5])).collect()
    assert [(r["doc_id"], r["near_edited"] <= 1, r["near_next"]) for r in one] == [(5, True, 1.0)]
    assert imatch.with_next(docs(spark, ["a"]).limit(0)).collect() == []
    texts, ids = ["first", "other text", "b b", "b a", None, "zz"], [None, 9, 4, 4, 2**62, -3]
    got = imatch.with_next(docs(spark, texts, ids).repartition(partitions)).collect()
    order = sorted(zip([-(2**63) if i is None else i for i in ids], [t or "" for t in texts], strict=True))
    want = sorted((str(None if i == -(2**63) else i), imatch.edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted((d, hashlib.sha256(e.encode()).hexdigest()) for d, e in want)
    prints = imatch.fingerprints(docs(spark, texts, ids)).collect()
    assert sorted(r["fingerprint"] for r in prints) == sorted(r["fingerprint"] for r in got)
