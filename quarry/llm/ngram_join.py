"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with the same shingle set form one class. Shingles are ordered by how often their hash bucket occurs in the
whole corpus, rarest first; each class posts the first n - ceil(t n) + 1 of them. Candidates share a posted shingle and
pass the length and positional filters. Within a posted shingle every class is first compared with two heads only, the
class for which the shingle comes earliest and the smallest class, which settles groups of near copies in linear work;
then all remaining candidates whose classes are still in different components are compared, so no component is lost.
Components alone skip links inside a group; ngram_links compares all candidates and returns every link.

Postings of shingles whose bucket is hot are dealt over salts, and their heads are merged. Before any text is shipped,
the suffix filter drops pairs whose histograms over ranges of the shingle order differ too much. Then one text of each
pair travels to the other's block, where each side's set is built once and the pair is verified once.

Defined results: null or empty text, or text without words: n_shingles 0, its own component. Repeated rows, ties: the
smallest id of a group names it. Columns besides the id and the text are ignored. Shingles and sets are held as 64-bit
hashes: two different sets meet with a chance of about 1 in 10^19 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, components, table

#: Buckets of the frequency order: a fixed size, whatever the corpus.
BUCKETS, SEGMENTS = 1 << 18, 64
#: Ranges of the suffix filter's histogram; partners of one class that a block holds.
RANGES, BLOCK = 64, 128
#: Classes of a group of a token's postings, when all pairs are compared.
GROUP = 1000
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; one hash for a text of fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _ONE
            out ^= out >> np.uint64(29)
        out = (out * _TWO) ^ ((out * _THREE) >> np.uint64(31))
    return np.unique(out)


def _class_of(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def _least_overlap(a, b, pct: int):
    return (pct * (a + b) + 99 + pct) // (100 + pct)


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each range of the hash order, up to 127."""
    counts = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES)
    return np.minimum(counts, 127).astype(np.int8)


def may_link(na: np.ndarray, nb: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], pct: int) -> np.ndarray:
    """Suffix filter: the sets' parts differ at least by the differences of their sizes, which must leave the overlap."""
    x, y = (np.stack(z).astype(np.int16) for z in (a, b))
    return np.abs(x - y).sum(1) <= na + nb - 2 * _least_overlap(na, nb, pct)


def _may_link_columns(a: str, b: str, pct: int) -> Column:
    """may_link for two prefixes of columns n and sketch, for use inside a join."""
    gap = F.aggregate(F.zip_with(f"{a}sketch", f"{b}sketch", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, d: t + d)
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return gap <= na + nb - 2 * F.floor((pct * (na + nb) + 99 + pct) / (100 + pct))


def linked(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    need = _least_overlap(len(a), len(b), pct)
    if min(len(a), len(b)) < need:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= pct * (len(a) + len(b) - same)


def ngram_components(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles and component_id, for links with Jaccard >= pct / 100 on k-word shingles."""
    return _join(docs, k, pct, id_col, text_col, False)


def ngram_links(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link once, as pairs of classes of equal sets: a_id, b_id (the smallest ids), a_copies, b_copies, n_links.

    A class of two documents or more is linked with itself (a_id = b_id), by copies * (copies - 1) / 2 links of documents;
    two linked classes by a_copies * b_copies. The sum of n_links is the number of linked pairs of documents.
    """
    return _join(docs, k, pct, id_col, text_col, True)


def _frequencies(facts: DataFrame) -> np.ndarray:
    """The corpus count of each bucket, from the tasks' vectors: added up over groups of tasks, then groups of groups."""

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS // SEGMENTS, np.int64)
        for x in b["counts"]:
            total += np.frombuffer(x, np.int64)
        return b[["segment", "part"]].iloc[:1].assign(counts=[total.tobytes()])

    sums = facts.filter("segment >= 0").select("segment", F.spark_partition_id().alias("part"), "counts")
    for _ in range(3):
        sums = sums.withColumn("part", F.shiftright("part", 6))
        sums = sums.groupBy("segment", "part").applyInPandas(add, "segment int, part int, counts binary")
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.int64)
    for r in sums.collect():  # SEGMENTS rows of a fixed size for each 2^18 tasks
        out[r["segment"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _near(na, nb, i, j, pct: int, least=np.minimum):
    """Length and positional filters, and the pair's own prefix, for a shared shingle at positions i and j of sets of na and nb."""
    need = _least_overlap(na, nb, pct)
    return (least(na, nb) >= need) & (i <= na - need) & (j <= nb - need) & (least(i, j) + least(na - i, nb - j) >= need)


def _near_columns(a: str, b: str, pct: int) -> Column:
    """_near for two structs or prefixes of columns n and pos."""
    na, nb, i, j = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    need = F.floor((pct * (na + nb) + 99 + pct) / (100 + pct))
    over = F.least(i, j) + F.least(na - i, nb - j) >= need
    return (F.least(na, nb) >= need) & (i <= na - need) & (j <= nb - need) & over


def _postings(docs: DataFrame, freq: np.ndarray, k: int, pct: int) -> DataFrame:
    """token, cls, n, pos, salt, salts: the prefix of every class, rarest shingles first."""
    sc = docs.sparkSession.sparkContext
    rank = sc.broadcast(np.argsort(np.argsort(freq, kind="stable"), kind="stable").astype(np.uint32))
    #: a bucket far above the mean may hold a shingle of a large group
    spread = sc.broadcast(np.maximum(1, -(-freq // max(2000, int(64 * freq.mean())))).astype(np.int32))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a class is posted once a task, as far as memory is sure to last
        order, salts = rank.value, spread.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b["text"]:
                s = shingle_set(t, k)
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                p = len(s) - (pct * len(s) + 99) // 100 + 1
                key = (order[(s >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(46)) | (s & np.uint64((1 << 46) - 1))
                first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                first = first[np.argsort(key[first])]
                many = salts[(s[first] >> np.uint64(46)).astype(np.int64)]
                made = (s[first].view(np.int64), np.full(p, c, np.int64), np.full(p, len(s)), np.arange(p), np.int64(c) % many, many)
                for col, x in zip(cols, made, strict=True):
                    col.append(x)
            if cols[0]:
                names = ("token", "cls", "n", "pos", "salt", "salts")
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, cols), strict=True)))

    return docs.mapInPandas(post, "token long, cls long, n long, pos long, salt int, salts int")


def _shared(postings: DataFrame, pct: int) -> DataFrame:
    """token, cls, n, pos, hot, h1, h2: postings whose token another class has (or may have, where hot).

    h1 and h2 are the heads that pass the filters with the row; those of hot tokens are found later, over all salts.
    """

    def mark(b: pd.DataFrame) -> pd.DataFrame:
        token, cls = b["token"].to_numpy(), b["cls"].to_numpy()
        once = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]  # several tasks may have posted a class
        token, salt, cls, n, pos, salts = (b[c].to_numpy()[once] for c in ("token", "salt", "cls", "n", "pos", "salts"))
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        size = np.diff(np.r_[start, len(token)])
        lowest = np.flatnonzero(cls == np.repeat(np.minimum.reduceat(cls, start), size))
        hot = salts > 1
        out = {"token": token, "cls": cls, "n": n, "pos": pos, "hot": hot}
        for name, at in (("h1", start), ("h2", lowest)):
            at = np.repeat(at, size)
            fits = ~hot & (cls != cls[at]) & _near(n, n[at], pos, pos[at], pct)
            out[name] = pd.arrays.IntegerArray(cls[at], ~fits)
        return pd.DataFrame(out)[hot | (np.repeat(size, size) > 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last token so far
        for b in batches:
            if b.empty:
                continue
            keys = b[["token", "salt"]].to_numpy()
            other = np.flatnonzero((keys != keys[-1]).any(1))
            cut = other[-1] + 1 if len(other) else 0
            if cut or (held and (held[-1][["token", "salt"]].to_numpy()[-1] != keys[-1]).any()):
                yield mark(pd.concat([*held, b.iloc[:cut]]))
                held = []
            held.append(b.iloc[cut:])
        if held:
            yield mark(pd.concat(held))

    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "cls")
    return dealt.mapInPandas(run, "token long, cls long, n long, pos long, hot boolean, h1 long, h2 long")


def _star(shared: DataFrame, pct: int) -> DataFrame:
    """home, member: each class with the heads of its tokens, once."""
    pairs = [shared.filter(F.col(h).isNotNull()).select(F.col(h).alias("home"), "cls") for h in ("h1", "h2")]
    hot = shared.filter("hot").select("token", "cls", "n", "pos")
    ends = [F.min("cls").alias("lo"), F.max("cls").alias("hi")]
    heads = [F.min(F.struct("pos", "cls", "n")).alias("h1"), F.min(F.struct("cls", "n", "pos")).alias("h2")]
    tops = table(hot.groupBy("token").agg(*ends, *heads).filter("lo <> hi").select("token", "h1", "h2"), "ngram-tops")
    both = hot.join(bounded(tops, tops.count()), "token").select("h1", "h2", F.struct("cls", "n", "pos").alias("x"))
    for h in ("h1", "h2"):
        fits = (F.col(f"{h}.cls") != F.col("x.cls")) & _near_columns("x.", f"{h}.", pct)
        pairs.append(both.filter(fits).select(F.col(f"{h}.cls").alias("home"), F.col("x.cls").alias("cls")))
    return _once(reduce(DataFrame.union, pairs))


def _once(pairs: DataFrame) -> DataFrame:
    """pairs(home, cls), in either order and many times -> home, member."""
    both = pairs.select(F.least("home", "cls").alias("a"), F.greatest("home", "cls").alias("b"), (F.col("home") < F.col("cls")).alias("first"))
    one = both.groupBy("a", "b").agg(F.max("first").alias("first"))
    home, member = F.when(F.col("first"), F.col("a")), F.when(F.col("first"), F.col("b"))
    return one.select(home.otherwise(F.col("b")).alias("home"), member.otherwise(F.col("a")).alias("member"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs (home, member) of classes that link, each verified once."""

    def suffix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[may_link(b["n"].to_numpy(), b["n2"].to_numpy(), list(b["sketch"]), list(b["sketch2"]), pct)][["home", "member", "home_id", "member_id"]]

    own = reps.select(F.col("cls").alias("home"), F.col("rep").alias("home_id"), "n", "sketch")
    other = reps.select(F.col("cls").alias("member"), F.col("rep").alias("member_id"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    wanted = pairs.join(own, "home").join(other, "member").mapInPandas(suffix, "home long, member long, home_id long, member_id long")
    wanted = table(wanted, "ngram-wanted")
    many = table(wanted.groupBy("home").agg(F.count("*").alias("many")).filter(F.col("many") > BLOCK), "ngram-many")
    blocks = F.coalesce(F.ceil(F.col("many") / BLOCK), F.lit(1))
    placed = wanted.join(bounded(many, many.count()), "home", "left").withColumn("block", F.pmod(F.xxhash64("member"), blocks))
    guests = placed.select(F.col("member_id").alias("doc_id"), "home", "block", F.lit(1).alias("guest"), F.col("member").alias("cls"))
    hosts = placed.select(F.col("home_id").alias("doc_id"), "home", "block", F.lit(0).alias("guest"), F.col("home").alias("cls")).distinct()
    sent = table(guests.union(hosts), "ngram-sent")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home, own = None, None
        for b in batches:
            found = []
            for h, guest, c, t in zip(b["home"], b["guest"], b["cls"], b["text"], strict=True):
                s = shingle_set(t, k)
                if not len(s) or _class_of(s) != c:
                    continue  # another text under the same id
                if not guest:
                    home, own = h, s
                elif h == home and linked(own, s, pct):
                    found.append((h, c))
            yield pd.DataFrame(found, columns=["home", "member"], dtype="int64")

    texts = docs.join(bounded(sent, sent.count()), "doc_id").repartition("home", "block").sortWithinPartitions("home", "block", "guest")
    return table(texts.select("home", "guest", "cls", "text").mapInPandas(verify, "home long, member long"), "ngram-links")


def _join(docs: DataFrame, k: int, pct: int, id_col: str, text_col: str, all_links: bool) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            n, cls, form = [], [], []
            for t in b["text"]:
                s = shingle_set(t, k)
                counts += np.bincount((s >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else 0)
                form.append(sketch(s))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "cls": cls, "sketch": form, "segment": -1, "counts": b""})
        if counts.any():
            vectors = [x.tobytes() for x in np.split(counts, SEGMENTS)]
            yield pd.DataFrame({"doc_id": 0, "n": 0, "cls": 0, "sketch": [np.zeros(0, np.int8)] * SEGMENTS, "segment": range(SEGMENTS), "counts": vectors})

    facts = table(docs.mapInPandas(summarise, "doc_id long, n long, cls long, sketch array<tinyint>, segment int, counts binary"), "ngram-facts")
    freq = _frequencies(facts)
    facts = facts.filter("segment < 0")
    reps = facts.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = table(reps, "ngram-reps")
    shared = table(_shared(_postings(docs, freq, k, pct), pct), "ngram-shared")
    if all_links:
        return _all_links(_verified(_all_pairs(shared, pct), docs, reps, k, pct), reps)
    star = table(_star(shared, pct), "ngram-star")
    found = _verified(star, docs, reps, k, pct)
    labels = components(found.toDF("a", "b"))
    rest = _left_over(shared, labels, reps, pct)
    if not rest.isEmpty():
        rest = table(rest.join(star, ["home", "member"], "left_anti").join(star.toDF("member", "home"), ["home", "member"], "left_anti"), "ngram-rest")
        found = found.union(_verified(rest, docs, reps, k, pct))
        labels = components(found.toDF("a", "b"))
    named = reps.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = table(named.select("cls", "component", "rep"), "ngram-named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = facts.join(named.join(lowest, "component").select("cls", "component_id"), "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _all_pairs(shared: DataFrame, pct: int, apart: Column | None = None) -> DataFrame:
    """home, member: all pairs of classes with a common token that pass the filters, once.

    The postings of a token are dealt over groups of some GROUP classes, and each two groups meet under a key of their own:
    no task has all of a hot token.
    """
    rows = shared.groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > GROUP)
    big = table(rows.select("token", F.ceil(F.col("rows") / GROUP).alias("groups")), "ngram-big")
    dealt = shared.join(bounded(big, big.count()), "token", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("groups")))
    side = lambda e, others: dealt.select("token", "own", others.alias("other"), *[F.col(c).alias(f"{e}_{c}") for c in shared.columns if c != "token"])
    x = side("x", F.explode(F.sequence("own", F.col("groups") - 1))).withColumnsRenamed({"own": "low", "other": "high"})
    y = side("y", F.explode(F.sequence(F.lit(0), "own"))).withColumnsRenamed({"own": "high", "other": "low"})
    fits = ((F.col("low") < F.col("high")) | (F.col("x_cls") < F.col("y_cls"))) & _near_columns("x_", "y_", pct)
    pairs = x.join(y, ["token", "low", "high"]).filter(fits if apart is None else fits & apart)
    return table(pairs.select(F.least("x_cls", "y_cls").alias("home"), F.greatest("x_cls", "y_cls").alias("member")).filter("home < member").distinct(), "ngram-pairs")


def _left_over(shared: DataFrame, labels: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """Candidates whose classes the links found so far leave in different components; a class without links is its own.

    Documents that share a passage but not more meet here; the suffix filter inside the join keeps their pairs from being made.
    """
    labels = labels.withColumnRenamed("node", "cls")
    left = shared.select("token", "cls", "n", "pos").join(bounded(labels, labels.count()), "cls", "left")
    left = left.withColumn("component", F.coalesce("component", "cls"))
    ends = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = table(ends.filter("lo <> hi").select("token"), "ngram-open")
    left = left.join(bounded(open_, open_.count()), "token", "left_semi")
    left = table(left.join(reps.select("cls", "sketch"), "cls"), "ngram-left")
    return _all_pairs(left, pct, (F.col("x_component") != F.col("y_component")) & _may_link_columns("x_", "y_", pct))


def _all_links(found: DataFrame, reps: DataFrame) -> DataFrame:
    x, y = (reps.select(F.col("cls").alias(c), F.struct(F.col("rep").alias("id"), "copies").alias(e)) for c, e in (("home", "x"), ("member", "y")))
    two = found.join(x, "home").join(y, "member").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    two = two.selectExpr("a.id AS a_id", "b.id AS b_id", "a.copies AS a_copies", "b.copies AS b_copies", "a.copies * b.copies AS n_links")
    one = reps.filter("copies > 1").selectExpr("rep AS a_id", "rep AS b_id", "copies AS a_copies", "copies AS b_copies", "copies * (copies - 1) div 2 AS n_links")
    return two.union(one)
