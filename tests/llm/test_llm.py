"""The corpus operators against brute force, on small fixtures with nulls, empties, ties, copies and clashing columns."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, exact_dedup, html_text, langid, licenses, ngram_join, packing, pii, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, token string, n int, component_id long, key string, digest string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "k", "d") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows] + [None, "", "  \n", "a", "a b", "A  b", rows[0]["text"], rows[0]["text"].replace(" ", "\t", 5), "é x", "word " * 30_000]
    near = rows[3]["text"].split()
    return texts + [" ".join(near[: len(near) - k]) for k in (1, 2, 3, 30)] + [" ".join(near[k:]) for k in (2, 4, 6, 8)]


def test_ngram_components(spark, sample):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [shingles(t) for t in sample]
    comp = list(range(len(sets)))
    for _ in range(len(sets)):
        before = comp[:]
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)):
                    same = len(a & b)
                    if 100 * same >= 90 * (len(a) + len(b) - same):
                        comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, sample), 3, 90).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert ngram_join.ngram_components(docs(spark, ["x"]).limit(0), 3, 90).count() == 0


def test_ngram_links(spark, sample):
    """All links inside groups of near copies, by class, against all pairs of documents."""
    base = [f"w{i}" for i in range(120)]
    texts = [*sample, *(" ".join(base[: 120 - i]) for i in range(6)), " ".join(base), " ".join(base[2:])]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    first, copies, want = {}, {}, {}
    for i, x in enumerate(sets):
        first.setdefault(x, i)
        copies[first[x]] = copies.get(first[x], 0) + 1
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                key = tuple(sorted((first[a], first[b])))
                want[key] = want.get(key, 0) + 1
    rows = ngram_join.ngram_links(docs(spark, texts), 3, 90).collect()
    assert {(r["a_id"], r["b_id"]): r["n_links"] for r in rows} == want and len(rows) == len(want)
    assert all((r["a_copies"], r["b_copies"]) == (copies[r["a_id"]], copies[r["b_id"]]) for r in rows)


def test_exact_dedup(spark, sample):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in sample]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, sample), F.col("doc_id") % 2 == 0).collect()}
    assert len(got) == len(sample)
    for i, t in enumerate(norm):
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (norm.index(t), norm.count(t), norm.index(t) == i)
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, ["x"]).limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 50, 20_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 62, n).astype(np.uint64)
    f = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(keys, *f).all()
    assert exact_dedup.may_hold(rng.integers(0, 1 << 62, 20_000).astype(np.uint64), *f).mean() < 0.01


def test_pii(spark, sample):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    fine = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15}
    texts = [*sample, "a@b.com_x@c.d, a@b a.b@c-d.e.f; \U0001f600 1.2.3.4.5 256.1.1.1 4111 1111-1111 1111 +1 (555) 010-9999 12", "1" * 20_000, "a" * 50_000 + "@x", "mail joe [at] site [dot] com or call (415) 555-2671"]
    got = {r["doc_id"]: r for r in pii.detect(docs(spark, texts)).select("doc_id", pii.listed(F.col("base")).alias("base"), "added").collect()}
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() if not (k == "email" and len(t or "") == 50_002) for m in re.finditer(p, t or "") if fine[k](m[0])]
        assert got[i]["base"] == ",".join(want), i


def test_decontamination(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    item = rows[0]["text"].split()
    bad = item[:10] + ["zzz"] + item[11:]
    texts = ["clean words " * 40, "x y z " * 9 + " ".join(item) + " q", " ".join(bad).upper(), None, "", "short"]
    found = {r["doc_id"]: r for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(rows)).collect()}
    assert set(found) == {1, 2} and found[1]["coverage"] == 1.0 and found[2]["item_id"] == rows[0]["item_id"]


def test_decontamination_offsets(spark):
    """Items of 12 to 17 words, verbatim or with one other word in any place, at any offset in a document."""
    items = {n: [f"w{n}x{j}" for j in range(n)] for n in range(12, 18)}
    texts = []
    for n, item in items.items():
        for at in range(4):
            for bad in [None, *range(n)]:
                texts.append(["pre"] * at + [f"other{j}" if j == bad else w for j, w in enumerate(item)] + ["post"] * 3)
    texts += [["pre"] * at + items[17][2:15] for at in range(3)] + [items[17][:11] + ["post"] * 9]
    want = set()
    for i, w in enumerate(texts):
        for n, item in items.items():
            for d in range(-n + 1, len(w)):
                equal = sum(w[j + d] == item[j] for j in range(max(0, -d), min(n, len(w) - d)))
                if equal >= 12:
                    want.add((i, n, d, equal))
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    found = decontaminate.matches(docs(spark, [" ".join(w) for w in texts]), benchmark).collect()
    assert {(r["doc_id"], r["item_id"], r["diagonal"], r["equal_words"]) for r in found} == want and len(found) == len(want)


def test_language(spark, sample):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    r = langid.identify(d, ~held).filter(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97
    odd = docs(spark, [None, "", "123 !", "The and of the words"]).select("doc_id", "text", "lang")
    assert [x["lang_pred"] for x in langid.identify(odd, F.lit(True)).orderBy("doc_id").collect()] == ["und"] * 3 + ["en"]


def test_language_bounds(spark):
    """Nothing learned, languages with long texts only, more languages than the bound."""
    rows = docs(spark, ["plain words", "12 -- 3", None]).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert [x["lang_pred"] for x in langid.identify(rows, F.lit(True)).orderBy("doc_id").collect()] == [None, "und", "und"]
    long = spark.createDataFrame([(1, "the house and the garden " * 400, "en"), (2, "la maison et le jardin " * 400, "fr"), (3, "le jardin", None)], "doc_id long, text string, lang string")
    assert [x["lang_pred"] for x in langid.identify(long, F.lit(True)).orderBy("doc_id").collect()] == ["en", "fr", "fr"]
    many = spark.createDataFrame([(i, "some text", "zz" if i < 2 else f"l{i:03}") for i in range(204)], "doc_id long, text string, lang string")
    assert "zz" in {lang for lang, _ in langid.training_sample(many, F.lit(True), 200, 6000)}


def test_packing(spark, sample):
    from tokenizers import Tokenizer

    vocab, ranks = packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(vocab)
    texts = [*sample, "a <|endoftext|> b"]
    rows = packing.pack(docs(spark, texts), vocab, ranks).collect()
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    covered, used = [0] * len(texts), {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == [len(x) for x in ids]
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_html():
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n  two<p>three<br>four</article><div id=comments>hi</div><footer>F</footer>"
    assert html_text.main_text(page) == "A & B One two three four"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p><b>") == ""
    assert "long plain text" in html_text.main_text("<body><div>" + "long plain text " * 20 + "</div></body>")


def test_html_regions():
    """Pages without a region, with teasers as small regions, and with one that holds most of the text."""
    body = ["Long sentence of the body text with many words in it, number %d. " % i * 4 for i in range(6)]
    paras = "".join(f"<p>{x}</p>" for x in body)
    want = " ".join(" ".join(x.split()) for x in body)
    links = "<div>" + "".join(f"<p><b><i><a><u>{i}</u></a></i></b></p>" for i in range(12)) + "</div>"
    teasers = "".join("<article><b><i><a><u>t</u></a></i></b></article>" for _ in range(12))
    assert html_text.main_text(f"<body>{links}<div>{paras}</div></body>").endswith(want)
    assert "5 6 7" not in html_text.main_text(f"<body>{links}<div>{paras}</div></body>")
    teased = html_text.main_text(f"<body><div>{paras}</div>{teasers}</body>")
    assert teased.startswith(want) and "t t" not in teased
    assert html_text.main_text(f"<body>{links}<article><h2>Short</h2>{paras}</article>{links}</body>") == "Short " + want
    outside = "<p>" + "And a long closing paragraph that stands after the end of the article. " * 9 + "</p>"
    assert html_text.main_text(f"<body><article>{paras}</article>{outside}{links}</body>").startswith(want + " And a long closing")


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (3, "u\n", "s"), (4, "u", "s"), (5, "u", None), (6, "u", "é" * 300)], "page_id long, url string, html string")
    back = {r["record_id"]: r for r in warc.records(warc.archives(pages)).collect()}
    assert back["<urn:page:2>"]["record_type"] == "revisit" and back["<urn:page:2>"]["refers_to"] == "<urn:page:1>" and back["<urn:page:2>"]["payload_bytes"] == 200
    assert back["<urn:page:4>"]["record_type"] == "response" and back["<urn:page:6>"]["payload_digest"] == hashlib.sha256(("é" * 300).encode()).hexdigest()
    assert warc.archives(pages.limit(0)).count() == 0


def test_warc_long_header(spark):
    """A url longer than any fixed bound on the header, zipped and plain."""
    url = "data:text/html," + "a" * 3_000_000
    pages = spark.createDataFrame([(1, "u", "x"), (2, url[:70_000], "y"), (3, url, "z"), (4, "u", "w")], "page_id long, url string, html string")
    back = {r["record_id"]: r for r in warc.records(warc.archives(pages)).collect()}
    assert set(back) == {f"<urn:page:{i}>" for i in range(1, 5)} and back["<urn:page:3>"]["target_uri"] == url
    plain = b"".join(warc.record(i, u, b"body", "d", None) for i, u in enumerate(("u", url, "v")))
    assert [x[0] for x in warc.salvage(plain)] == ["record"] * 3


def test_salvage():
    recs = [warc.record(i, "u", b"body%d" % i * 50, "d", None) for i in range(4)]
    zipped = [gzip.compress(r) for r in recs]
    broken = bytearray(b"".join(zipped))
    broken[len(zipped[0]) + 30] ^= 255
    got = list(warc.salvage(bytes(broken)))
    assert [x[0] for x in got] == ["record", "gap", "record", "record"] and got[1][1:3] == (len(zipped[0]), len(zipped[1]))
    plain = b"junk" + recs[0] + recs[1][:40] + recs[2]
    got = list(warc.salvage(plain))
    assert [x[0] for x in got] == ["gap", "record", "gap", "record"] and sum(x[2] for x in got) == len(plain)


def test_licenses(spark):
    texts = ["Foo. Released under the MIT License. bar", "This work is licensed under the GNU General Public License, version 2.", None, "", "nothing", licenses.TEMPLATES["mit-grant"].replace("merge", "join")]
    got = [(r["doc_id"], r["license"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in licenses.find(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(0, "mit"), (1, "gpl-2"), (5, "mit-grant")] and got[0][2] == "Released under the MIT License"


@pytest.mark.parametrize("gap", [*range(14), 40])
def test_licenses_repeated(gap):
    """Copies of a notice with `gap` other words between them are all reported, each at its place."""
    for name, notice in licenses.TEMPLATES.items():
        text, want = "Foo. ", []
        for _ in range(7):
            body = notice.rstrip(".")
            want.append((name, 1.0, len(text), len(text) + len(body)))
            text += body + ". " + "foo " * gap
        assert licenses.scan(text, tuple(sorted(licenses.TEMPLATES.items())), 0.8) == want
    mixed = [n for _ in range(3) for n in ("mit", "cc-by-4.0", "cc-by-4.0", "gpl-2", "mit", "mit")]
    text = " ".join(licenses.TEMPLATES[n] + " foo" * gap for n in mixed)
    assert [x[0] for x in licenses.scan(text, tuple(sorted(licenses.TEMPLATES.items())), 0.8)] == mixed


def test_licenses_damaged_copies():
    text = "Licensed under CC BY 4. " * 2 + "Licensed under CC BY 4.0. " * 2 + "under CC BY 4.0. " * 2
    got = licenses.scan(text, tuple(sorted(licenses.TEMPLATES.items())), 0.8)
    assert [round(c * 6) for _, c, _, _ in got] == [5, 5, 6, 6, 5, 5]


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rows = toxicity.score(d, labels, ~held).join(labels.filter(held), "doc_id").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.85
    assert toxicity.score(d.limit(3), labels.limit(0), F.lit(True)).agg(F.max("score")).first()[0] == 0
