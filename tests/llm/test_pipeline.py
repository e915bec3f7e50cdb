"""The corpus pipeline against brute force, stage by stage, on one small table."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import decontaminate, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = items.orderBy("item_id").first()["text"].split()
    words = next(t.split() for _, t, *_ in rows if t and 100 < len(t.split()) < 400)
    extra = [None, "", " 12 -- 34 ", " ".join(words), "\t".join(words), " ".join(words[:-2]), " ".join(words[1:-1] + ["end"]), "before " + " ".join(item) + " after", " ".join(item[:9] + ["other"] + item[10:]).upper()]
    rows += [(1_000_000 + i, t, None, "x", None) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    items.write.parquet(f"{at}/benchmark.parquet")
    return at, {r[0]: r[1] for r in rows}, {r["item_id"]: r["text"] for r in items.collect()}


def groups(sets):
    """doc_id -> smallest id that links reach, for 5-word sets with a similarity of 0.8 or more."""
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and comp[i] != comp[j] and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return comp


def overlaps(text, item, least=12):
    """A diagonal with `least` equal words, and on it a document window that one of the masks finds equal."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    w, iw = np.array(split(text), object), np.array(split(item), object)
    for d in range(-len(iw) + 1, len(w)):
        lo, hi = max(0, d), min(len(w), d + len(iw))
        if hi - lo < least:
            continue
        same = w[lo:hi] == iw[lo - d : hi - d]
        if same.sum() >= least and any(all(same[p - lo + o] for o in m) for p in range(-(-lo // decontaminate.STRIDE) * decontaminate.STRIDE, hi - decontaminate.SPAN + 1, decontaminate.STRIDE) for m in decontaminate.MASKS):
            return True
    return False


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    at, texts, items = sf
    want = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    stages = [set(want)]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in want.items()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    want = {i: want[i] for i in first.values()}
    stages.append(set(want))
    sets = {}
    for i, t in want.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    comp = groups(sets)
    want = {i: t for i, t in want.items() if comp[i] == i}
    stages.append(set(want))
    want = {i: t for i, t in want.items() if not any(overlaps(t, x) for x in items.values())}
    stages.append(set(want))
    assert len({len(s) for s in stages}) == 4  # every stage takes something away

    docs = spark.read.parquet(f"{at}/documents.parquet")
    for (name, stage), ids in zip(corpus_pipeline.STAGES, stages, strict=False):
        docs = stage(spark, docs, at)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.table(docs, f"test-{name}")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ids, name

    tok = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in want.items()}
    covered, used = dict.fromkeys(ids, 0), {}
    for r in corpus_pipeline.run(spark, at).collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert covered == {i: len(x) for i, x in ids.items()} and max(used.values()) <= 1024


def test_language_without_model(spark, tmp_path):
    """Documents with letters stay when no row has a language."""
    docs = spark.createDataFrame([(1, "some words", None, "x", 1), (2, "1 2", None, "x", 1), (3, None, None, "x", 1)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()] == [1]


def test_empty_tables(spark, tmp_path):
    """No documents and no benchmark; a column with the name of a stage's own."""
    docs = spark.createDataFrame([], SCHEMA + ", lang_pred string, keep_id long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
