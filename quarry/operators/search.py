"""Full-text search over an inverted index, for many queries at once: match, cover density, early stop, boosts, fall-back, pages."""

from __future__ import annotations

import base64
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from .lineage import cut, written
from .relational import top_n

#: Weights of the field classes (fixed values), the least rank of a match, and the lengths a query may have.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LEAST_RANK, SHORTEST, LONGEST = 0.0001, 2, 200
#: Similarity and number of fuzzy hits by type; weights of the types and bonuses in a mixed list (fixed values).
FUZZY = {"artist": (0.3, 10), "label": (0.5, 5), "master": (0.5, 5)}
TYPE_WEIGHT = {"master": 200, "artist": 150, "label": 60}
#: Entities of a block of an index list, and of a run of blocks.
BLOCK, PART = 128, 1 << 16
#: Pairs of a query and an entity that a task compares.
PAIRS = 1 << 19
#: Sums of doubles may lie this much above a product that bounds them.
ROUNDING = 1 + 1e-9
FILTERS = ("genre", "style", "year", "yearMin", "country")


def validate(q: str | None = None, **filters) -> str | None:
    """What is wrong with a search, or None: a query of 2 to 200 characters or a filter; an upper year alone is none."""
    if not q and all(filters.get(f) is None for f in FILTERS):
        return "Query or at least one filter is required"
    if q and len(q) < SHORTEST:
        return f"Query must be at least {SHORTEST} characters"
    return "Query too long" if q and len(q) > LONGEST else None


def encode_cursor(id_: int, rank: float) -> str:
    return base64.urlsafe_b64encode(json.dumps({"id": id_, "rank": rank}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, float] | None:
    """(id, rank); None for anything that encode_cursor didn't make."""
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return (x["id"], x["rank"]) if all(type(x[k]) in (int, float) for k in ("id", "rank")) else None
    except (ValueError, KeyError, TypeError):
        return None


class Index(NamedTuple):
    """words: type, id, words array<struct<token, pos, weight>> of each entity, in the order of positions.

    lists: the entities of each token in blocks of BLOCK, those with the highest bound first: token, df, block, bound, docs
    array<struct<type, id>>. A bound is the greatest number of a token's occurrences in an entity times the fields' greatest weight.
    """

    words: DataFrame
    lists: DataFrame


def index(entities: DataFrame, fields: dict[str, str]) -> Index:
    """Index of entities(type, id, ...), written to the shared folder; fields: column -> weight class, in the order of positions."""
    return Index(*(written(df, f"index-{name}") for name, df in zip(Index._fields, _built(entities, fields), strict=True)))


def write_index(entities: DataFrame, fields: dict[str, str], path: str) -> Index:
    """Write an index below path for later sessions, the lists sorted by token so that a reader skips row groups, and read it again."""
    made = _built(entities, fields)
    made.words.write.parquet(f"{path}/words")
    made.lists.repartitionByRange("token").sortWithinPartitions("token", "block").write.parquet(f"{path}/lists")
    return read_index(entities.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/lists"))


def _built(entities: DataFrame, fields: dict[str, str]) -> Index:
    parts, at = [], F.lit(0)
    for column, grade in fields.items():
        tokens = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        entities = entities.withColumn(f"_t_{column}", tokens)
        held = F.col(f"_t_{column}")
        parts.append(_placed(held, at, WEIGHTS[grade]))
        at = at + F.size(held)
    words = entities.select("type", "id", F.concat(*parts).alias("words")).filter(F.size("words") > 0)
    most = max(WEIGHTS[grade] for grade in fields.values())
    each = words.select("type", "id", F.explode("words").alias("x")).groupBy(F.col("x.token").alias("token"), "type", "id").agg((F.count("*") * most).alias("bound"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    # a token of very many entities is dealt over several runs of blocks
    part = F.pmod(F.xxhash64("type", "id"), F.ceil(F.col("df") / PART))
    placed = each.join(df, "token").withColumn("part", part)
    place = F.row_number().over(Window.partitionBy("token", "part").orderBy(F.desc("bound"), "type", "id"))
    placed = placed.withColumn("block", F.floor((place - 1) / BLOCK))
    lists = placed.groupBy("token", "part", "block").agg(F.first("df").alias("df"), F.max("bound").alias("bound"), F.collect_list(F.struct("type", "id")).alias("docs"))
    return Index(words, lists.select("token", "df", "block", "bound", "docs"))


def _placed(tokens: Column, at: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (at + i + 1).alias("pos"), F.lit(weight).alias("weight")))


def cover_density(hits: Column, n: Column) -> Column:
    """Rank of a text for n query tokens; hits: array<struct<pos, weight, i array<int>>> of its words that match, by position.

    Smallest covers of all tokens, denser ones count more: a cover of k hits counts k over the sum of their inverse weights,
    divided by one plus the words between that are no hit. One pass: after each hit, the cover that ends there begins at the
    least of the tokens' last hits, and is new if that lies behind the beginning of the cover before.
    """
    none = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("pos"), F.lit(0.0).alias("inv"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("k"), F.lit(0.0).alias("inv"), F.lit(0.0).alias("total"), F.array_repeat(none, n).alias("last"))

    def step(a: Column, h: Column) -> Column:
        here = F.struct(a["k"].alias("k"), h["pos"].alias("pos"), a["inv"].alias("inv"))
        last = F.transform(a["last"], lambda x, i: F.when(F.array_contains(h["i"], i), here).otherwise(x))
        return F.struct(a["first"].alias("first"), (a["k"] + 1).alias("k"), (a["inv"] + 1 / h["weight"]).alias("inv"), a["total"].alias("total"), last.alias("last"), h["pos"].alias("pos"), F.array_min(last).alias("b"))

    def count(a: Column) -> Column:
        b, ends = a["b"], a["k"] - 1
        noise = F.greatest(F.lit(0), (a["pos"] - b["pos"]) - (ends - b["k"]))
        value = (a["k"] - b["k"]) / (a["inv"] - b["inv"]) / (1 + noise)
        new = b["k"] >= a["first"]
        return F.struct(F.when(new, b["k"] + 1).otherwise(a["first"]).alias("first"), a["k"].alias("k"), a["inv"].alias("inv"), (a["total"] + F.when(new, value).otherwise(0.0)).alias("total"), a["last"].alias("last"))

    # an array of one row's state binds it once for count()
    return F.aggregate(hits, start, lambda a, h: F.get(F.transform(F.array(step(a, h)), count), F.lit(0)), lambda a: a["total"])


def _hits(words: Column, t: Column) -> Column:
    """The words that match a token of the array t, the last one of which is a prefix."""
    last = F.element_at(t, -1)
    near = F.filter(words, lambda w: F.array_contains(t, w["token"]) | F.startswith(w["token"], last))
    which = lambda w: F.filter(F.transform(t, lambda x, i: F.when((x == w["token"]) | ((i == F.size(t) - 1) & F.startswith(w["token"], x)), i)), lambda i: i.isNotNull())
    return F.transform(near, lambda w: F.struct(w["pos"].alias("pos"), w["weight"].alias("weight"), which(w).alias("i")))


def _anchors(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts(q) -> q, t, token, forms: the indexed forms of each query's rarest token; none if a token has no form."""
    asked = texts.select("q", T.query_tokens(F.col("q")).alias("t")).filter("t IS NOT NULL")
    each = asked.select("q", F.size("t").alias("n"), F.posexplode("t").alias("i", "word"))
    known = lists.groupBy("token").agg(F.first("df").alias("df"))
    whole = each.filter("i < n - 1").join(known, F.col("word") == F.col("token")).select("q", "n", "i", "token", "df")
    # a prefix meets the beginnings of its own length: one equi-join for each length that occurs, at most LONGEST
    last = each.filter("i = n - 1").withColumn("size", F.length("word"))
    begins = known.join(F.broadcast(last.select("size").distinct()), F.length("token") >= F.col("size"))
    begins = begins.withColumn("word", F.substring("token", F.lit(1), F.col("size"))).select("word", "token", "df")
    forms = whole.unionAll(last.join(begins, "word").select("q", "n", "i", "token", "df"))
    per = forms.groupBy("q", "i").agg(F.sum("df").alias("df"), F.first("n").alias("n"), F.count("*").alias("forms"))
    rarest = per.groupBy("q").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min(F.struct("df", "i", "forms")).alias("x")).filter("k = n")
    rarest = rarest.select("q", F.col("x.i").alias("i"), F.col("x.forms").alias("forms"))
    return forms.join(rarest, ["q", "i"]).join(asked, "q").select("q", "t", "token", "forms")


def _ranked(found: DataFrame, words: DataFrame) -> DataFrame:
    """found(q, t, type, id) -> q, type, id, raw_rank of those that have all tokens."""
    once = found.dropDuplicates(["q", "type", "id"]).join(words, ["type", "id"])
    rank = cover_density(_hits(F.col("words"), F.col("t")), F.size("t"))
    # filtered inside an array, since a filter above would evaluate the rank twice
    return once.select("q", "type", "id", F.explode(F.filter(F.array(rank), lambda r: r > LEAST_RANK)).alias("raw_rank"))


def match_texts(texts: DataFrame, index: Index) -> DataFrame:
    """texts(q) of distinct queries -> q, type, id, raw_rank: all tokens occur, the last one as a prefix.

    The entities of each query's rarest token are looked up in the lists; only these are compared with the other tokens. They
    are dealt by entity over tasks of some PAIRS, since their compressed bytes say little about their number.
    """
    anchors = written(_anchors(texts, index.lists), "anchors")
    total = anchors.join(index.lists.select("token", F.size("docs").alias("n")), "token").agg(F.sum("n")).first()[0] or 0
    found = anchors.join(index.lists.select("token", "docs"), "token").select("q", "t", F.explode("docs").alias("x")).select("q", "t", "x.type", "x.id")
    if total > PAIRS:
        found = found.repartition(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS)), "type", "id")
    return _ranked(found, index.words)


def match(queries: DataFrame, index: Index) -> DataFrame:
    """queries(qid, q) -> qid, type, id, raw_rank; each distinct text is matched once."""
    return match_texts(queries.select("q").distinct(), index).join(queries, "q").select("qid", "type", "id", "raw_rank")


def top_texts(texts: DataFrame, index: Index, limit: int) -> DataFrame:
    """The best `limit` of match_texts for each query by raw_rank, then id, both descending, with early stop.

    The first blocks of the rarest token's lists are ranked first. Their result bounds the rest: a block whose entities
    can't reach the last of the best `limit` is never read on. A token's occurrence lies in at most one cover for each token
    that begins it, and no cover counts more than the greatest weight, so n * forms * bound is an upper bound.
    """
    blocks = cut(_anchors(texts, index.lists)).join(index.lists, "token")
    blocks = blocks.select("q", "t", "block", (F.size("t") * F.col("forms") * F.col("bound") * ROUNDING).alias("bound"), "docs")
    opened = lambda b: _ranked(b.select("q", "t", F.explode("docs").alias("x")).select("q", "t", "x.type", "x.id"), index.words)
    order = [F.desc("raw_rank"), F.desc("id"), F.asc("type")]
    first = cut(top_n(opened(blocks.filter("block = 0")), ["q"], order, limit, "place"))
    least = first.filter(F.col("place") == limit).select("q", F.col("raw_rank").alias("least"))
    rest = blocks.filter("block > 0").join(least, "q", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    both = first.drop("place").union(opened(rest)).dropDuplicates(["q", "type", "id"])
    return top_n(both, ["q"], order, limit, "place")


def boosted(found: DataFrame) -> DataFrame:
    """found(q, name, raw_rank) with rank: 10 more for the whole name, 2 for its beginning."""
    q, own = F.lower(F.trim("q")), F.lower("name")
    return found.withColumn("rank", F.col("raw_rank") + F.when(own == q, 10.0).when(F.startswith(own, q), 2.0).otherwise(0.0))


def _relevant(top: DataFrame) -> DataFrame:
    return top.withColumn("relevance", F.least(F.greatest("rank", F.lit(0.0)), F.lit(1.0)))


def ranked(queries: DataFrame, entities: DataFrame, fields: dict[str, str], name: str, limit: int) -> DataFrame:
    """The best `limit` of each query and type by rank, then id, both descending, with has_more; relevance is at most 1.

    Distinct texts are matched and ranked once. Of entities that agree in all fields, which rank alike whatever is asked, only
    the `limit` + 1 highest ids can be among the best or tell that there are more. Keyset pages go by the ordered pair
    (rank, id), so no boosted row is skipped or repeated.
    """
    alike = list(dict.fromkeys(["type", *fields, name]))
    entities = written(top_n(entities.select("id", *alike), alike, [F.desc("id")], limit + 1, "_rn").drop("_rn"), "entities")
    names = entities.select("type", "id", F.col(name).alias("name"))
    found = boosted(match_texts(queries.select("q").distinct(), index(entities, fields)).join(names, ["type", "id"]))
    top = top_n(found, ["q", "type"], [F.desc("rank"), F.desc("id")], limit + 1, "place")
    top = top.withColumn("has_more", F.max("place").over(Window.partitionBy("q", "type")) > limit).filter(F.col("place") <= limit)
    return _relevant(top).join(queries, "q")


def fan_out_score(explicit: bool = False) -> Column:
    """Score of a hit in a list of all types (or of one): columns type, name, relevance, q."""
    q, name = F.lower(F.trim("q")), F.lower("name")
    if explicit:
        return F.col("relevance") * 100 + F.when(name == q, 500).when(F.startswith(name, q), 100).otherwise(0)
    weight = F.lit(0)
    for kind, w in TYPE_WEIGHT.items():
        weight = F.when(F.col("type") == kind, w).otherwise(weight)
    return weight + F.col("relevance") * 100 + F.when(name == q, 1200).when(F.startswith(name, q), 220).when(F.contains(name, q), 80).otherwise(0)


def fan_out(found: DataFrame, limit: int, bad: DataFrame | None = None, each: int | None = None) -> DataFrame:
    """found(q, type, id, name, raw_rank) of all types -> the best `limit` of each query text by score.

    All hits take part, or, if `each` is given, of each type the best `each` by rank, then id; of these, rows of bad(type, id)
    go, and ids without a verdict stay.
    """
    hits = boosted(found)
    if each is not None:
        hits = top_n(hits, ["q", "type"], [F.desc("rank"), F.desc("id")], each, "place").drop("place")
    if bad is not None:
        hits = hits.join(bad.select("type", "id"), ["type", "id"], "left_anti")
    return top_n(_relevant(hits).withColumn("score", fan_out_score()), ["q"], [F.desc("score"), F.desc("relevance"), F.desc("id")], limit, "place")


def filter_only(masters: DataFrame, limit: int, after: tuple[int, int] | None = None, **wanted) -> DataFrame:
    """Masters without a query: filters on year, country, genres and styles, by weight, then id, both descending; one row more than the limit."""
    weight = F.coalesce("scene_weight", F.lit(0))
    tests = {
        "year": lambda v: F.col("year") == v,
        "yearMin": lambda v: F.col("year") >= v,
        "yearMax": lambda v: F.col("year") <= v,
        "country": lambda v: F.col("country") == v,
        "genre": lambda v: F.array_contains("genres", v),
        "style": lambda v: F.array_contains("styles", v),
    }
    for key, value in wanted.items():
        if value is not None:
            masters = masters.filter(tests[key](value))
    if after is not None:
        masters = masters.filter((weight < after[0]) | ((weight == after[0]) & (F.col("id") < after[1])))
    return masters.orderBy(weight.desc(), F.desc("id")).limit(limit + 1)


def similar(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """queries(qid, q) against names(id, name): pairs with trigram similarity of `least` or more, by shared trigrams.

    The trigrams are counted in the join; no pair without a common one is made, and each text's set is built once.
    """
    x = queries.select("qid", T.trigrams(F.col("q")).alias("g")).select("qid", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    y = names.select("id", T.trigrams(F.col("name")).alias("g")).select("id", F.size("g").alias("nn"), F.explode("g").alias("gram"))
    both = x.join(y, "gram").groupBy("qid", "id", "nq", "nn").agg(F.count("*").alias("k"))
    return both.select("qid", "id", (F.col("k") / (F.col("nq") + F.col("nn") - F.col("k"))).alias("sim")).filter(F.col("sim") >= least)


def fuzzy(queries: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """The best fuzzy hits of each query of four characters or more, by the type's similarity and number."""
    least, most = FUZZY[kind]
    hits = similar(queries.filter(F.length("q") >= 4), names, least)
    return top_n(hits, ["qid"], [F.desc("sim"), F.asc("id")], most, "place").withColumn("type", F.lit(kind))


def headline(texts: DataFrame, query: Column, least: int = 25, width: int = 60, most: int = 3) -> DataFrame:
    """texts(id, text) -> id, headline: up to `most` fragments around the smallest covers of the query's words, joined by ' ... '.

    A word is a hit of a query token that it begins with. Of the covers of all tokens (of single hits, where a text lacks one)
    that begin in the same stretch of `width` words the smallest counts. The smallest covers first, each becomes a fragment of
    `least` words around it, or as long as the cover and at most `width`, unless it overlaps one that is chosen already;
    fragments stand in the order of the text. A text without any hit gives its first `width` words.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.select("id", words.alias("w"), T.query_tokens(query).alias("t"))
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")
    which = lambda w: F.filter(F.transform("t", lambda x, i: F.when(F.startswith(w, x), i)), lambda i: i.isNotNull())
    rows = rows.select("id", "w", "t", F.filter(F.transform("w", lambda w, i: F.struct(i.alias("pos"), which(plain(w)).alias("i"))), lambda h: F.size(h["i"]) > 0).alias("h"))
    known = F.size(F.array_distinct(F.flatten(F.transform("h", lambda h: h["i"])))) == F.size("t")

    state = "struct<first:int,last:array<int>,out:array<struct<b:int,e:int>>>"
    begin = F.struct(F.lit(0).alias("first"), F.array_repeat(F.lit(-1), F.when(known, F.size("t")).otherwise(1)).alias("last"), F.array().cast("array<struct<b:int,e:int>>").alias("out")).cast(state)

    def step(a: Column, h: Column) -> Column:
        last = F.transform(a["last"], lambda x, i: F.when(~known | F.array_contains(h["i"], i), h["pos"]).otherwise(x))
        return F.transform(F.array(F.struct(last.alias("last"), F.array_min(last).alias("b"))), lambda n: _kept_cover(a, n, h["pos"], width).cast(state))[0]

    covers = F.aggregate("h", begin, step, lambda a: F.array_sort(F.transform(a["out"], lambda c: F.struct((c["e"] - c["b"]).alias("size"), c["b"].alias("b")))))
    rows = rows.select("id", "w", covers.alias("c"))
    length = lambda c: F.least(F.lit(width), F.greatest(F.lit(least), c["size"] + 1))
    start = lambda c: F.greatest(F.lit(0), F.least(c["b"] - F.floor((length(c) - c["size"] - 1) / 2).cast("int"), F.size("w") - length(c)))
    pieces = F.transform("c", lambda c: F.struct(F.greatest(F.lit(0), start(c)).alias("s"), length(c).alias("n")))
    free = lambda a, p: ~F.exists(a, lambda x: (x["s"] < p["s"] + p["n"]) & (p["s"] < x["s"] + x["n"]))
    none = F.array().cast("array<struct<s:int,n:int>>")
    chosen = F.aggregate(pieces, none, lambda a, p: F.when((F.size(a) < most) & free(a, p), F.concat(a, F.array(p))).otherwise(a))
    rows = rows.select("id", "w", F.array_sort(chosen).alias("p"))
    shown = F.array_join(F.transform("p", lambda p: F.array_join(F.slice("w", p["s"] + 1, p["n"]), " ")), " ... ")
    return rows.select("id", F.when(F.size("p") > 0, shown).otherwise(F.array_join(F.slice("w", 1, width), " ")).alias("headline"))


def _kept_cover(a: Column, n: Column, pos: Column, width: int) -> Column:
    """The state after a hit: a new cover is kept unless the last one kept begins in the same stretch and is no longer."""
    new = (n["b"] >= 0) & (n["b"] >= a["first"])
    cover = F.struct(n["b"].alias("b"), pos.alias("e"))
    old = F.try_element_at(a["out"], F.lit(-1))
    same = F.coalesce(F.floor(old["b"] / width) == F.floor(n["b"] / width), F.lit(False))
    better = pos - n["b"] < old["e"] - old["b"]
    front = F.when(same & better, F.slice(a["out"], 1, F.size(a["out"]) - 1)).otherwise(a["out"])
    out = F.when(new & (~same | better), F.concat(front, F.array(cover))).otherwise(a["out"])
    return F.struct(F.when(new, n["b"] + 1).otherwise(a["first"]).alias("first"), n["last"].alias("last"), out.alias("out"))


def entities_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """type -> DataFrame(id, name, ...) as one table(type, id, name)."""
    out = None
    for kind, df in tables.items():
        one = df.select(F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), "name")
        out = one if out is None else out.unionAll(one)
    return out
