"""Edge cases of the corpus operators: empty tables, nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import gzip
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, exact_dedup, html_text, langid, licenses, ngram_join, packing, pii, toxicity, warc

CLASH = "token string, cls long, n int, pos int, home long, member long, digest string, old boolean, seed long, spans string, base string, added string, lang_pred string, score double, crcs string, shard long, hit boolean"
COLUMNS = [f.split()[0] for f in CLASH.split(", ")]


def docs(spark, texts, ids=None):
    """doc_id, text, lang, source, n_chars and a column for every name that an operator uses inside."""
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit("7").try_cast(f.split()[1]).alias(f.split()[0]) for f in CLASH.split(", ")])


LONG = "word " * 200_000


def test_html_in_spark(spark):
    """Empty table, columns text and n_chars of its own, repeated rows, a page of megabytes, null and empty pages."""
    big = "<article>" + "<p>" + "long body text of the page, with many words in it. " * 40_000 + "</p></article>"
    rows = [(1, "u", None, "x", 1), (2, "u", "", "x", 1), (3, "u", "<p>body text here, long enough</p>", "x", 1), (3, "u", "<p>body text here, long enough</p>", "x", 1), (4, None, big, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["n_chars"], r["text"][:9]) for r in html_text.extract(pages).collect())
    assert got[:4] == [(1, 0, ""), (2, 0, ""), (3, 27, "body text"), (3, 27, "body text")] and got[4][1] > 2_000_000
    assert html_text.extract(pages.limit(0)).collect() == []


def test_html_against_line_ratios():
    """The ratio of each line, the smoothing and the threshold, against a plain computation on a page without marks."""
    paras = ["A long sentence of the body, number %d, with enough words to count. " % i * (1 + i % 3) for i in range(9)]
    links = "".join(f"<div><a href=/{i}><b>l{i}</b></a></div>" for i in range(9))
    page = f"<body>{links}<div>{''.join(f'<p>{x}</p>' for x in paras)}</div>{links}</body>"
    lines = re.findall(r"<div><a[^>]*><b>([^<]*)</b></a></div>|<p>([^<]*)</p>", page)
    texts = [" ".join((a or b).split()) for a, b in lines]
    parser = html_text.Lines()
    parser.feed(page)
    parser.cut()
    assert [x.text for x in parser.lines] == texts
    ratio = np.array([len(x.text) / max(1, x.tags) for x in parser.lines])
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    smooth = np.array([sum(k[j + 3] * ratio[min(len(ratio) - 1, max(0, i + j))] for j in range(-3, 4)) / k.sum() for i in range(len(ratio))])
    want = [t for t, r in zip(texts, smooth, strict=True) if r >= 0.25 * min(smooth.std(), smooth.mean())]
    assert html_text.main_text(page) == " ".join(want) and set(" ".join(paras).split()) <= set(html_text.main_text(page).split())


BODY = "Words of the body text, many of them in this one. " * 8
SHORT = [f"Short paragraph number {i} of the article." for i in range(30)]


@pytest.mark.parametrize("name", ["comments", "comment-list", "disqus", "disqus_thread", "user-comments"])
@pytest.mark.parametrize("region", ["article", "main"])
def test_html_comments(region, name):
    """Named comment blocks go whatever their ratio: long comments inside a region of short paragraphs."""
    comments = "".join(f"<p>{BODY * 5}{i}</p>" for i in range(6))
    page = f"<body><{region}>{''.join(f'<p>{x}</p>' for x in SHORT)}<div class={name}>{comments}</div></{region}></body>"
    assert html_text.main_text(page) == " ".join(SHORT)
    nested = f"<body><article>{''.join(f'<p>{x}</p>' for x in SHORT)}<section id={name}>{''.join(f'<article class=comment><p>{BODY * 5}</p></article>' for _ in range(6))}</section></article></body>"
    assert html_text.main_text(nested) == " ".join(SHORT)


def test_html_drops_nothing_else():
    """List items, headings and formulas of an article beside a very long paragraph; a page inside a form; small forms go."""
    items = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(8))
    article = f"<article><h1>Head</h1><ul>{items}</ul><p>{BODY * 200}</p><p>Let <math><mi>x</mi></math> be<form><label>Mail</label><input name=m><button>Send</button> us</form></p></article>"
    want = " ".join(["Head", *(f"item {i}" for i in range(8)), *(BODY * 200).split(), "Let x be"])
    assert html_text.main_text(f"<body>{article}</body>") == want
    assert html_text.main_text(f"<body><form id=aspnet><input type=hidden>{article}<select><option>a</select></form></body>") == want
    plain = f"<body><form action=/><div><p>{BODY}</p><p>{BODY}</p></div><button>Go</button></form></body>"
    assert html_text.main_text(plain) == " ".join((BODY * 2).split())


def test_html_wrappers():
    """Clutter's names on what encloses the main element or the whole page count for nothing; teasers are not the article."""
    page = f"<body><div class='sidebar page-search'><main><h1>Head</h1><article><p>{BODY}</p></article><div class=related>{BODY * 3}</div></main></div></body>"
    assert html_text.main_text(page) == "Head " + " ".join(BODY.split())
    assert html_text.main_text(f"<div class=modal><p>{BODY}</p></div>") == " ".join(BODY.split())
    teasers = "".join(f"<article><p>Teaser {i} of another page</p></article>" for i in range(5))
    assert html_text.main_text(f"<body><article><p>{BODY}</p><p>end</p></article><div>{teasers}</div></body>") == " ".join(BODY.split()) + " end"


def test_html_names():
    """Names of clutter are whole names: parts of an article keep theirs; a head without an end ends at the body."""
    body = "Words of the body text, many of them in this one. " * 8
    page = f"<article><header><h1 class=post-header>Head</h1></header><div class=side-by-side><p>{body}</p></div><div class=cookie-notice>We use cookies</div><ul class='comments-list'><li>nice</li></ul></article>"
    assert html_text.main_text(page) == "Head " + " ".join(body.split())
    assert html_text.main_text(f"<html><head><title>T</title><body><p>{body}</p>") == " ".join(body.split())


def test_toxicity_edges(spark):
    texts = [None, "", "plain words only", "plain words only", LONG, *(f"you idiot number {i} moron" for i in range(20)), *(f"kind words number {i} here" for i in range(20))]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int("idiot" in (t or "")), "x") for i, t in enumerate(texts)] + [(7, 1, "again")], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, labels, F.lit(True)).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] and got[2] == got[3]
    assert min(got[i] for i in range(5, 25)) > max(got[i] for i in range(25, 45))
    assert toxicity.score(d.limit(0), labels, F.lit(True)).collect() == []


def test_pii_edges(spark):
    """Empty table, clashing columns, a text of a megabyte of addresses, and what the classifier adds."""
    many = " ".join(f"u{i}@mail.example.com" for i in range(20_000))
    texts = [many, *("call me: (415) 555-26%02d or mail joe%d [at] site [dot] com, host 10[.]0[.]0[.]%d" % (i, i, i) for i in range(30)), "12 34", None]
    got = {r["doc_id"]: r for r in pii.detect(docs(spark, texts)).collect()}
    assert [(x["kind"], x["s"], x["e"]) for x in got[0]["base"]] == [("email", m.start(), m.end()) for m in re.finditer(r"\S+", many)]
    for i in range(1, 31):
        found = {texts[i][x["s"] : x["e"]] for x in got[i]["added"]}
        assert "(415) 555-26%02d" % (i - 1) in found and "joe%d [at] site [dot] com" % (i - 1) in found
    assert not got[31]["base"] and not got[31]["added"] and not got[32]["base"]
    assert pii.detect(docs(spark, ["x"]).limit(0)).collect() == []


def test_pii_em_by_hand():
    """One round of the estimate on two patterns, by hand: agreeing votes raise the posterior, opposing ones lower it."""
    rows = [{"kind": "phone", "v1": 1, "v2": 1, "v3": 1, "size": 1, "n": 50}, {"kind": "phone", "v1": -1, "v2": -1, "v3": 0, "size": 2, "n": 50}]
    p = pii.estimate(rows)
    assert p["phone", 1, 1, 1, 1] > 0.99 and p["phone", -1, -1, 0, 2] < 0.01


def test_decontamination_edges(spark):
    """Ties go to the smallest item; repeated rows, long texts, empty tables and short items."""
    item = [f"w{i}" for i in range(14)]
    benchmark = spark.createDataFrame([(9, " ".join(item), 1), (4, " ".join(item), 1), (5, "one two three four five six", 1), (6, "a b", 1), (7, None, 1)], "item_id long, text string, hits int")
    d = docs(spark, [" ".join(item), LONG + " ".join(item), "say one two three four five six now", "one two three four five", None, "", " ".join(item)], [1, 2, 3, 4, 5, 6, 1])
    got = {r["doc_id"]: (r["item_id"], r["n_items"], r["equal_words"]) for r in decontaminate.contaminated(d, benchmark).collect()}
    assert got == {1: (4, 2, 14), 2: (4, 2, 14), 3: (5, 1, 6)}
    assert decontaminate.contaminated(d, benchmark.limit(0)).collect() == [] and decontaminate.contaminated(d.limit(0), benchmark).collect() == []


def test_licenses_edges(spark):
    """Long text, repeated rows, ties, an empty table, letters whose lower case is longer."""
    note = "Released under the MIT License."
    texts = [LONG + note, "İ" * 5 + " " + note, note, None, licenses.TEMPLATES["mit-license"]]
    rows = licenses.find(docs(spark, texts, [1, 2, 3, 4, 5]).union(docs(spark, [note], [3]))).collect()
    assert sorted((r["doc_id"], r["license"], texts[r["doc_id"] - 1][r["start"] : r["end"]][:30]) for r in rows) == [(1, "mit", note[:-1]), (2, "mit", note[:-1]), (3, "mit", note[:-1]), (3, "mit", note[:-1]), (5, "mit-license", "Permission is hereby granted, ")]
    two = {"b": "some words of a notice here", "a": "some words of a notice here"}
    assert [r["license"] for r in licenses.find(docs(spark, ["some words of a notice here"]), two).collect()] == ["a"]
    assert licenses.find(docs(spark, ["x"]).limit(0)).collect() == []


def _aligned(a, b):
    """(score, matches) of the best alignment of two whole word lists: 1 a match, -1 a mismatch or gap."""
    row = [(-j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(-i - 1, 0)]
        for j, y in enumerate(b):
            s, m = row[j]
            new.append(max((s + 1, m + 1) if x == y else (s - 1, m), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1])))
        row = new
    return row[-1]


def test_alignment_is_the_best():
    """Score and place of the banded alignment against the best over all pairs of stretches."""
    rng = np.random.default_rng(3)
    cuts = list(itertools.combinations(range(8), 2))
    for n in range(60):
        a, b = rng.integers(1, 3 + n % 4, 7).tolist(), rng.integers(1, 3 + n % 4, 7).tolist()
        m, first, last = licenses.align(np.array(a), np.array(b), 0, 0, 7)
        best = max(_aligned(a[i:j], b[k:l]) for i, j in cuts for k, l in cuts)
        if best[1] == 0:
            assert m == 0
        else:
            # an alignment that falls to a score of zero begins anew, so of equal scores one with fewer matches may come back
            assert max(_aligned(a[i:j], b[first : last + 1]) for i, j in cuts)[0] == best[0] and best[0] <= m <= best[1]


def test_whole_licenses(spark):
    """Each whole license is found under its own name, also with a few words changed; the longer of two that share words wins."""
    names = ["bsd-2-clause", "isc", "mit-license", "zlib"]
    texts = [f"Own words before. {licenses.TEMPLATES[n]} And after." for n in names]
    texts += [t.replace("the", "teh", 3) for t in texts]
    got = {}
    for r in licenses.find(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], texts[r["doc_id"]][r["start"] : r["end"]]))
    assert {i: [n for n, _ in x] for i, x in got.items()} == {i: [n] for i, n in enumerate(names + names)}
    assert all(got[i][0][1] == licenses.TEMPLATES[n].rstrip(".)/") for i, n in enumerate(names))


def test_dedup_digest_clash(spark, monkeypatch):
    """Texts that share a digest but differ stay two groups, one a side; every row comes out once."""
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("ab" * 32))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs(spark, ["a", "b", "a", "b"]), F.col("doc_id") % 2 == 0).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 1: (1, 2), 3: (1, 2)}


def test_dedup_repeated_ids(spark):
    """An id that repeats with another text: each text has its own group."""
    rows = [(2, "a"), (2, "b"), (1, "a"), (3, "a"), (4, "b"), (2, "a")]
    got = exact_dedup.exact_dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows]), F.col("doc_id") % 2 == 0).collect()
    want = [(i, {"a": 1, "b": 2}[t], {"a": 4, "b": 2}[t]) for i, t in rows]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted(want)


def test_dedup_filters_are_kept(spark, tmp_path):
    digests = spark.createDataFrame([(bytes([i]) * 32,) for i in range(50)], "digest binary")
    exact_dedup.save_filters(digests, 4, str(tmp_path / "f"))
    kept, shards = exact_dedup.load_filters(spark, str(tmp_path / "f"))
    batch = spark.createDataFrame([(bytes([i]) * 32,) for i in range(100)], "digest binary")
    hits = exact_dedup.screen(batch, kept, shards).filter("hit").count()
    assert shards == 4 and 50 <= hits < 60


def test_language_kernels():
    """Kernels against sets, the fitted weights against the ridge system."""
    texts = [("en", "the house"), ("en", "the garden"), ("fr", "la maison"), ("fr", "le jardin")]
    model = langid.fit(texts)
    sets = [set(langid.grams(t).tolist()) for _, t in texts]
    got = langid.kernels(model, [langid.grams(t) for _, t in texts])
    marks = {i: j for j in range(4) for i in range(4) if np.isclose(got[i, j], 1)}
    assert len(marks) == 4
    for i in range(4):
        for k in range(4):
            assert got[i, marks[k]] == pytest.approx(len(sets[i] & sets[k]) / np.sqrt(len(sets[i]) * len(sets[k])), abs=1e-5)


def test_language_edges(spark):
    d = docs(spark, ["the house and garden", None, "", LONG, "the house and garden", "12"])
    got = [(r["lang_pred"], r["score"]) for r in langid.identify(d, F.lit(True)).orderBy("doc_id").collect()]
    assert [x for x, _ in got] == ["en", "und", "und", "en", "en", "und"] and got[0] == got[4] and got[1][1] == 0
    assert langid.identify(d.limit(0), F.lit(True)).collect() == []


def test_warc_damaged(spark):
    """Clashing columns, and an archive that loses a member: later records come back, the gap is logged."""
    pages = spark.createDataFrame([(i, "u", f"body {i} " * 40, "x", 1) for i in range(6)], "page_id long, url string, html string, digest string, first long")
    rows = warc.archives(pages.coalesce(1)).collect()
    content = bytearray(rows[0]["content"])
    first = len(gzip.compress(b"")) + 30
    content[first] ^= 255
    read = warc.records(spark.createDataFrame([("a", bytes(content))], "archive string, content binary"))
    assert read.filter("kind = 'record'").count() == 5 and warc.quarantine(read).count() == 1
    assert warc.records(warc.archives(pages.limit(0))).collect() == []


def test_warc_query_salvages(spark, tmp_path, monkeypatch):
    """A damaged archive costs its page alone, and is reported."""
    from quarry.llm import queries

    spark.createDataFrame([(i, "u", f"body {i} " * 40) for i in range(6)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")

    def damaged(pages, made=warc.archives):
        rows = [(r["archive"], bytearray(r["content"])) for r in made(pages).select("archive", "content").collect()]
        rows[0][1][len(gzip.compress(b"")) + 30] ^= 255
        return spark.createDataFrame([(a, bytes(c)) for a, c in rows], "archive string, content binary")

    monkeypatch.setattr(warc, "archives", damaged)
    got = {r["page_id"] for r in queries.op9_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got < set(range(6))


def test_fill_is_closest():
    """Subset sums against all combinations, and the pieces used against the counts."""
    rng = np.random.default_rng(1)
    for _ in range(80):
        lengths = rng.integers(1, 33, rng.integers(1, 9))
        counts = np.bincount(lengths, minlength=33)
        used = packing.fill(counts, 32)
        assert all(0 < k <= counts[n] for n, k in used.items()) and lengths.max() in used
        rest = sorted(lengths)[:-1]
        sums = {lengths.max() + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k)}
        total = sum(n * k for n, k in used.items())
        full = {x for x in sums if x == 32}
        powers = {x for x in sums if x <= 32 and x & (x - 1) == 0}
        assert total == 32 if full else total in powers if powers else total == max(x for x in sums if x <= 32)


def test_packing_edges(spark):
    vocab, ranks = packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken")
    rows = packing.pack(docs(spark, ["a b c"] * 300 + [None, "", "x " * 3000], [*range(300), 300, 301, 0]), vocab, ranks).collect()
    total, used = sum(r["length"] for r in rows), {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert total == sum({(r["doc_id"], r["start"], i): r["length"] for i, r in enumerate(rows)}.values()) and padding < 1024
    assert packing.pack(docs(spark, ["x"]).limit(0), vocab, ranks).collect() == []


def test_ngram_edges(spark):
    """Repeated rows, ties, a long text and the names used inside."""
    d = docs(spark, ["a b c d", "a b c d", LONG, None, "", "q"], [5, 2, 3, 4, 6, 2])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(d, 3, 90).collect())
    assert got == [(2, 1, 2), (2, 2, 2), (3, 1, 3), (4, 0, 4), (5, 2, 2), (6, 0, 6)]


def test_ngram_groups(spark, monkeypatch):
    """Hot tokens dealt over groups give the links of one group: texts that share a passage, near copies among them."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(f"d{i}w{j}" for j in range(3 + i % 4)) for i in range(40)] + [passage + " x", passage + " y z"]
    d = docs(spark, texts)
    links = lambda: sorted(map(tuple, ngram_join.ngram_links(d, 3, 80).collect()))
    whole = links()
    comps = sorted(map(tuple, ngram_join.ngram_components(d, 3, 80).collect()))
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    assert links() == whole and len(whole) > 20
    assert sorted(map(tuple, ngram_join.ngram_components(d, 3, 80).collect())) == comps
