"""PII by weak supervision, in DataFrame functions only.

Base spans come from strict patterns (email, ip, card, phone). Wider patterns propose further candidates: addresses written
out with "at" and "dot", ip addresses with bracketed dots, card numbers in groups with other separators, phone numbers
without a plus sign. On every span, base or proposed, three labelers vote yes, no or nothing: a pattern labeler (strict form
or check digits), a gazetteer (top-level domains, issuer digits, reserved ranges) and the words before the span. Expectation-maximisation on the table of vote patterns, whose size doesn't depend on the corpus,
estimates how reliable each labeler is for each kind; a naive Bayes span classifier is then trained on the patterns with
the posteriors as soft labels, votes and length as features. Candidates that it finds likelier than `accept` are added.

Defined results: null or empty text has no span; repeated rows are answered singly; spans of a kind do not overlap, and a
proposed span that overlaps a base span of its kind is dropped. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values). A look-behind or \G keeps a start inside a run from being tried again and again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}\x20?[\[({.](?:dot[\])}])?\x20?[A-Za-z]{2,24}(?![A-Za-z])",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(dot\)|\[dot\])[0-9]{1,3}(?:\.|\[\.\]|\(dot\)|\[dot\])[0-9]{1,3}(?:\.|\[\.\]|\(dot\)|\[dot\])[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9._/-])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/-])",
    "phone": r"(?<![0-9.+()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers and cue words (fixed values).
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl)$"
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write to|reach)[^A-Za-z]*$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from)[^A-Za-z]*$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|number)[^A-Za-z]*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon)[^A-Za-z]*$",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def weight(i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    n = F.length(d)
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0).otherwise(False)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


NONE = "array<struct<s:int,e:int,m:string,b:string>>"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, b>> of the pattern's leftmost matches with what stands before, from the matches and the gaps between them.

    Lengths add up within blocks of some sqrt(n) matches and then over the blocks, so that the work grows with n ** 1.5.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g"), F.substring(g, -30, 30).alias("b")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["b"].alias("b"))).alias("out"))

    def placed(pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        starts = F.sequence(F.lit(1), F.size(pairs), width)
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(pairs, i, width), empty, step))

        def join(acc: Column, x: Column) -> Column:
            moved = F.transform(x["out"], lambda y: F.struct((acc["at"] + y["s"]).alias("s"), (acc["at"] + y["e"]).alias("e"), y["m"].alias("m"), y["b"].alias("b")))
            return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NONE}>").alias("out"))
        return F.aggregate(blocks, first, join, lambda acc: F.flatten(acc["out"]))

    # one transform binds the pairs, so that they are made once
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(F.array().cast(NONE))))


GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
WIDE_GUARDS = {
    "email": lambda t: t.rlike(r"[\[({]at[\])}]"),
    "ip": lambda t: t.rlike(r"[0-9][\[(](?:\.|dot)[\])]"),
    "card": lambda t: t.rlike(r"[0-9]{4}[._/][0-9]{4}[._/]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, s, e, m, before, base>>: base spans and candidates; one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(NONE)
    cols = [F.when(GUARDS[k](F.col("t")), _found(F.col("t"), BASE[k])).otherwise(none).alias(f"b_{k}") for k in KINDS]
    cols += [F.when(WIDE_GUARDS[k](F.col("t")), _found(F.col("t"), WIDE[k])).otherwise(none).alias(f"w_{k}") for k in WIDE]
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", "t", *cols)

    def kept(k: str) -> Column:
        return F.filter(F.col(f"b_{k}"), lambda x: _valid(k, x["m"]))

    def full(k: str, arr: Column, base: bool) -> Column:
        return F.transform(arr, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("before"), F.lit(base).alias("base")))

    raw = raw.select("doc_id", "t", *[kept(k).alias(f"b_{k}") for k in KINDS], *[f"w_{k}" for k in WIDE])

    def sides(k: str) -> Column:
        """Base and wide spans of a kind by position; a valid base span can't hold a wide one and part of another."""
        tagged = lambda arr, base: F.transform(arr, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b"), F.lit(base).alias("base")))
        return F.when(F.size(f"w_{k}") > 0, F.array_sort(F.concat(tagged(F.col(f"b_{k}"), True), tagged(F.col(f"w_{k}"), False))))

    raw = raw.select("*", *[sides(k).alias(f"a_{k}") for k in WIDE])

    def apart(k: str) -> Column:
        """The wide spans that meet neither the span before nor the one after, where that is a base span."""
        near = F.transform(F.col(f"a_{k}"), lambda x, i: F.struct(x.alias("x"), F.get(F.col(f"a_{k}"), i - 1).alias("l"), F.get(F.col(f"a_{k}"), i + 1).alias("r")))
        meets = lambda y, x: F.coalesce(y["base"] & (x["s"] < y["e"]) & (y["s"] < x["e"]), F.lit(False))
        kept = F.filter(near, lambda z: ~z["x"]["base"] & ~meets(z["l"], z["x"]) & ~meets(z["r"], z["x"]))
        return F.coalesce(F.transform(kept, lambda z: F.struct(*[z["x"][c].alias(c) for c in ("s", "e", "m", "b")])), F.array().cast(NONE))

    base, wide = [full(k, F.col(f"b_{k}"), True) for k in KINDS], [full(k, apart(k), False) for k in WIDE]
    return raw.select("doc_id", F.concat(*base, *wide).alias("spans"))


def votes(found: DataFrame) -> DataFrame:
    """One row per span with the votes (1 yes, -1 no, 0 nothing) and a length class."""
    one = found.select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")
    kind, m = F.col("kind"), F.col("m")
    form = (
        F.when(kind == "email", m.rlike(r"[\[({]dot[\])}]"))
        .when(kind == "ip", _valid("ip", F.regexp_replace(m, r"[\[(](?:\.|dot)[\])]", ".")))
        .when(kind == "card", _luhn(m))
        .otherwise(m.rlike(r"^(?:\([0-9]{3}\)[\x20-][0-9]{3}[\x20-]|[0-9]{3}([\x20.-])[0-9]{3}\1)[0-9]{4}$"))
    )
    pattern = F.when(F.col("base") | form, 1).otherwise(-1)
    gazetteer = (
        F.when(kind == "email", F.when(m.rlike(DOMAINS), 1).otherwise(-1))
        .when(kind == "ip", F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
        .when(kind == "card", F.when(m.rlike("^[3456]"), 1).otherwise(-1))
        .otherwise(F.when(_digits(m).rlike(r"^(?:1?[2-9][0-9]{2}[2-9]|[2-9][0-9])"), 1).otherwise(-1))
    )
    cue = F.lit(0)
    for k in KINDS:
        cue = F.when((kind == k) & F.col("before").rlike(CUES[k]), 1).otherwise(cue)
    return one.select("doc_id", "kind", "s", "e", "base", pattern.alias("v1"), gazetteer.alias("v2"), cue.alias("v3"), F.least((F.col("e") - F.col("s")) / 8, F.lit(7)).cast("int").alias("size"))


def estimate(patterns: list[dict], rounds: int = 50) -> dict[tuple, float]:
    """EM over (kind, votes, size) counts -> probability of the span classifier for each pattern."""
    out: dict[tuple, float] = {}
    for kind in sorted({p["kind"] for p in patterns}):
        rows = [p for p in patterns if p["kind"] == kind]
        prior = 0.7
        rel = {(v, x, y): (0.8 if x == (1 if y else -1) else 0.1) for v in ("v1", "v2", "v3") for x in (-1, 0, 1) for y in (0, 1)}

        def posterior(r: dict, features: tuple[str, ...], table_: dict, p1: float) -> float:
            like = [math.log(1 - p1), math.log(p1)]
            for f in features:
                for y in (0, 1):
                    like[y] += math.log(table_[f, r[f], y])
            return 1 / (1 + math.exp(max(-700, min(700, like[0] - like[1]))))

        def counted(features: tuple[str, ...], post: list[float]) -> dict:
            got = {}
            for f in features:
                values = (-1, 0, 1) if f != "size" else range(8)
                for y in (0, 1):
                    w = [r["n"] * (p if y else 1 - p) for r, p in zip(rows, post, strict=True)]
                    total = sum(w) + 0.1 * len(values)
                    for x in values:
                        got[f, x, y] = (sum(a for a, r in zip(w, rows, strict=True) if r[f] == x) + 0.1) / total
            return got

        labelers = ("v1", "v2", "v3")
        for _ in range(rounds):
            post = [posterior(r, labelers, rel, prior) for r in rows]
            rel = counted(labelers, post)
            prior = min(0.99, max(0.01, sum(r["n"] * p for r, p in zip(rows, post, strict=True)) / sum(r["n"] for r in rows)))
        features = (*labelers, "size")
        final = counted(features, post)
        for r in rows:
            out[kind, r["v1"], r["v2"], r["v3"], r["size"]] = posterior(r, features, final, prior)
    return out


def detect(docs: DataFrame, accept: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base array<struct<kind, s, e>>, added array<struct<kind, s, e>>: one row per document."""
    found = table(spans(docs, id_col, text_col), "pii-spans")
    seen = votes(found)
    keys = ["kind", "v1", "v2", "v3", "size"]
    patterns = [r.asDict() for r in seen.groupBy(*keys).agg(F.count("*").alias("n")).collect()]  # at most 4 * 27 * 8 rows
    good = [k for k, p in estimate(patterns).items() if p >= accept]
    chosen = F.lit(False)
    for kind, v1, v2, v3, n in good:
        chosen = chosen | ((F.col("kind") == kind) & (F.col("v1") == v1) & (F.col("v2") == v2) & (F.col("v3") == v3) & (F.col("size") == n))
    added = seen.filter(~F.col("base")).filter(chosen).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "s", "e")).alias("added"))
    base = F.transform(F.filter("spans", lambda x: x["base"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    out = found.select("doc_id", base.alias("base")).join(added, "doc_id", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("added"))


def listed(arr: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    text = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    parts = [F.transform(F.array_sort(F.transform(F.filter(arr, lambda x: x["kind"] == k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))), text) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")
