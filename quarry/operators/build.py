"""The scope build: seeds to masters, gates, closures, prune, derived tables, groups, sizes; and the field profile of nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .relational import gate_fail_open, keep_first


def scope_masters(seeds: DataFrame, releases: DataFrame, styles: DataFrame, masters: DataFrame, quality: DataFrame, allowed: list[str], gated: list[str], gate_year: int) -> DataFrame:
    """Masters of the seed releases that pass the quality gate (no verdict passes) and the gate on styles.

    A master whose allowed styles are all among the gated ones goes if its year is after the gate's.
    """
    m = releases.join(seeds, "release", "left_semi").select("master").filter("master IS NOT NULL").distinct()
    m = gate_fail_open(m, quality, "master", F.col("status") != "active")
    tagged = releases.select("release", "master").join(styles.filter(F.col("style").isin(allowed)), "release")
    only = tagged.groupBy("master").agg(F.bool_and(F.col("style").isin(gated)).alias("only")).filter("only").select("master")
    late = masters.filter(F.col("year") > gate_year).select("master")
    return m.join(only.join(late, "master", "left_semi"), "master", "left_anti")


def scope_releases(scope: DataFrame, releases: DataFrame, seeds: DataFrame, first: int, last: int) -> DataFrame:
    """All releases of the masters in scope within the window of years, and the seeds themselves."""
    inside = releases.filter(F.col("year").between(first, last)).join(scope, "master", "left_semi").select("release")
    return inside.union(seeds.select("release")).distinct()


def scene_weight(masters: DataFrame, releases: DataFrame) -> DataFrame:
    """masters(master, data_quality, year, artist, video), releases in scope(master, country, video, tier1) -> master, scene_weight.

    Quality bucket (5, 2, -5, 0), releases up to 5, countries up to 3, 3 for a video of the master and 3 for one of a release,
    10 for a first-tier label, 2 for a named artist, 1 for a known year.
    """
    per = releases.groupBy("master", "country").agg(F.count("*").alias("n"), F.max(F.coalesce("video", F.lit(False))).alias("v"), F.max(F.coalesce("tier1", F.lit(False))).alias("t"))
    g = per.groupBy("master").agg(F.sum("n").alias("n"), F.count("country").alias("countries"), F.max("v").alias("v"), F.max("t").alias("t"))
    q = F.col("data_quality")
    bucket = F.when(q.isin("Correct", "Complete and Correct"), 5).when(q.isin("Needs Vote", "Needs Minor Changes"), 2).when(q.isin("Needs Major Changes", "Entirely Incorrect"), -5).otherwise(0)
    if_ = lambda c, k: F.when(F.coalesce(c, F.lit(False)), k).otherwise(0)
    points = bucket + F.least(F.coalesce("n", F.lit(0)), F.lit(5)) + F.least(F.coalesce("countries", F.lit(0)), F.lit(3)) + if_(F.col("video"), 3) + if_(F.col("v"), 3) + if_(F.col("t"), 10)
    points = points + if_(F.coalesce("artist", F.lit("")) != "", 2) + if_(F.col("year").isNotNull(), 1)
    return masters.join(g, "master", "left").select("master", points.cast("long").alias("scene_weight"))


def prune(weights: DataFrame, scope_rel: DataFrame, releases: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Masters of at least the weight, and the releases that still have one of them or have no master."""
    kept = weights.filter(F.col("scene_weight") >= least).select("master")
    rows = scope_rel.join(releases.select("release", "master"), "release")
    return kept, rows.filter("master IS NULL").unionByName(rows.join(kept, "master", "left_semi").select(*rows.columns)).select("release")


def canonical_release(scope: DataFrame, releases: DataFrame) -> DataFrame:
    """The main release of each master if it is in scope, else the earliest (unknown years last, then the least id)."""
    order = F.struct(~F.coalesce("is_main", F.lit(False)), F.col("year").isNull(), "year", "release")
    return releases.join(scope, "master", "left_semi").groupBy("master").agg(F.min(order).alias("x")).select("master", F.col("x.release").alias("release"))


def master_tracks(canonical: DataFrame, tracks: DataFrame, credits: DataFrame) -> DataFrame:
    """Tracks of the canonical releases that have a title, with the distinct names credited on each."""
    own = credits.join(canonical, "release", "left_semi")  # names of other releases' tracks are not made
    names = own.groupBy("release", "position").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("artists_text"))
    rows = tracks.filter("title IS NOT NULL").join(canonical, "release")
    return rows.join(names, ["release", "position"], "left").select("master", "position", "title", "duration", "artists_text", F.col("release").alias("source_release"))


def unified_videos(scope: DataFrame, master_videos: DataFrame, release_videos: DataFrame, releases: DataFrame, scope_rel: DataFrame, site: str) -> DataFrame:
    """Videos of the masters and of the releases in scope, one table; the same url may come from both."""
    own = master_videos.join(scope, "master", "left_semi")
    own = own.select("master", F.lit("master").alias("source_type"), F.lit(None).cast("long").alias("source_release"), "url", "title", "duration", F.lit(None).cast("string").alias("release_url"))
    rel = release_videos.join(releases.select("release", "master").join(scope_rel, "release", "left_semi").join(scope, "master", "left_semi"), "release")
    rel = rel.select("master", F.lit("release").alias("source_type"), F.col("release").alias("source_release"), "url", "title", "duration", F.concat(F.lit(site), F.col("release").cast("string")).alias("release_url"))
    return own.unionByName(rel)


def release_shadow(releases: DataFrame, scope_rel: DataFrame, labels: DataFrame, formats: DataFrame, styles: DataFrame, site: str) -> DataFrame:
    """A slim row for each release in scope: first label, first format, whether any style speaks of a remix."""
    first = lambda df, value, order: df.groupBy("release").agg(F.min_by(value, order).alias(value))
    remix = styles.filter(F.ilike("style", F.lit("%remix%"))).select("release", F.lit(True).alias("remix")).distinct()
    out = releases.join(scope_rel, "release", "left_semi").join(first(labels, "label", "place"), "release", "left").join(first(formats, "format", "position"), "release", "left").join(remix, "release", "left")
    link = F.concat(F.lit(site), F.col("release").cast("string"))
    return out.select("release", "master", "year", "country", "label", "format", F.coalesce("is_main", F.lit(False)).alias("is_main"), F.coalesce("remix", F.lit(False)).alias("has_remix_signal"), link.alias("url"))


def group_members(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """edges(group_id, member_id) with both ends in scope(id), none with itself, once each."""
    e = edges.filter("member_id IS NOT NULL AND group_id <> member_id").select("group_id", "member_id").distinct()
    return e.join(scope.select(F.col("id").alias("group_id")), "group_id", "left_semi").join(scope.select(F.col("id").alias("member_id")), "member_id", "left_semi").select("group_id", "member_id")


def null_safe_dedupe(credits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, where a null part of a key equals another null."""
    return keep_first(credits, keys, order)


def sizes(parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the parts of a scope in one table: part, n."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def leaves(schema: DataType, path: str = "") -> list[str]:
    """Paths of a schema; a list is marked []."""
    if isinstance(schema, StructType):
        return [p for f in schema.fields for p in ([f"{path}.{f.name}".lstrip(".")] if not isinstance(f.dataType, (StructType, ArrayType)) else leaves(f.dataType, f"{path}.{f.name}".lstrip(".")))]
    if isinstance(schema, ArrayType):
        inner = schema.elementType
        return leaves(inner, path + "[]") if isinstance(inner, (StructType, ArrayType)) else [path + "[]"]
    return [path]


def occurrences(path: str) -> Column:
    """Array of the values, nulls among them, at a path of leaves()."""
    first, *rest = path.split(".")
    col = F.col(f"`{first.removesuffix('[]')}`")
    out = F.coalesce(col, F.array()) if first.endswith("[]") else F.array(col)
    for step in rest:
        out = _step(out, step)
    return out


def _step(out: Column, step: str) -> Column:
    name = step.removesuffix("[]")
    inner = F.transform(F.filter(out, lambda x: x.isNotNull()), lambda x: x.getField(name))
    return F.flatten(F.filter(inner, lambda x: x.isNotNull())) if step.endswith("[]") else inner


def profile(df: DataFrame) -> DataFrame:
    """One row a path of nested rows: rows that hold it, least and most occurrences in a row, share of non-empty values, a sample.

    All paths are measured in one pass over the rows.
    """
    facts = []
    for path in leaves(df.schema):
        found = F.transform(F.filter(occurrences(path), lambda x: x.isNotNull()), lambda x: x.cast("string"))
        facts.append(F.struct(F.lit(path).alias("path"), F.size(found).alias("k"), F.size(F.filter(found, lambda x: x != "")).alias("full"), F.array_min(found).alias("sample")))
    rows = df.select(F.explode(F.array(*facts)).alias("x")).select("x.*")
    share = F.round(F.coalesce(F.try_divide(F.sum("full"), F.sum("k")), F.lit(0.0)), 4)
    return rows.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(F.col("k") > 0).alias("present"), F.min("k").alias("least"), F.max("k").alias("most"), share.alias("non_empty"), F.min("sample").alias("sample"))
