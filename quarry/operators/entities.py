"""Entity detail, aliases, catalogs of an artist, credits, images, playlists: DataFrames in, DataFrames out, for many ids at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C, links as L, text as T
from .lineage import written
from .meetings import Met, meetings
from .relational import dealt, keep_first, top_n

#: Roles of images in the order they are preferred (fixed values).
IMAGE_ROLES = ["logo", "photo", "hero"]


def children(df: DataFrame, key: str, name: str, order: list[str], most: int | None = None) -> DataFrame:
    """One row a key with an array of its rows as structs, ordered; the first `most` of them (cut before they are gathered)."""
    rest = [c for c in df.columns if c != key]
    if most is not None:
        df = top_n(df, [key], [F.asc(c) for c in order], most, "_rn").drop("_rn")
    first = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*first))).alias(name))


def detail(core: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str], int | None]]) -> DataFrame:
    """core(id, ...) with an array column for each part: name -> (rows, key, order, most); empty where there are none."""
    for name, (rows, key, order, most) in parts.items():
        got = children(rows, key, name, order, most).withColumnRenamed(key, "id")
        core = core.join(got, "id", "left")
    return core


def expand_aliases(artists: DataFrame, most: int = 20) -> DataFrame:
    """artists(id, name, aliases array) -> id, other: itself and the artists whose name is among its aliases, the least ids first."""
    named = artists.select(F.lower("name").alias("key"), F.col("id").alias("other"))
    own = artists.select("id", F.explode("aliases").alias("alias")).select("id", F.lower("alias").alias("key"))
    found = own.join(named, "key").filter("id <> other").select("id", "other").distinct()
    found = top_n(found, ["id"], [F.asc("other")], most - 1, "_rn").drop("_rn")
    return found.unionAll(artists.select("id", F.col("id").alias("other")))


def artist_masters(credits: DataFrame, masters: DataFrame, aliases: DataFrame, order: str = "newest", kind: str | None = None, most: int = 500) -> DataFrame:
    """Masters of each artist and its aliases, once each (the artist's own credit first), with their release type.

    credits(artist_id, master_id), masters(id, title, year, weight, formats, tracks, artist), aliases(id, other);
    order: newest, oldest (years unknown last in both) or curated (by weight).
    """
    own = aliases.join(credits.select(F.col("artist_id").alias("other"), "master_id").distinct(), "other")
    own = own.groupBy("id", "master_id").agg(F.min(F.struct(F.col("other") != F.col("id"), "other")).alias("x"))
    rows = own.select(F.col("id").alias("artist_id"), F.col("x.other").alias("credited_as"), F.col("master_id").alias("id")).join(masters, "id")
    typed = rows.withColumn("release_type", C.release_type(F.col("formats"), F.col("title"), F.col("tracks"), F.col("artist"))["kind"])
    if kind:
        typed = typed.filter(F.col("release_type") == kind)
    by = {"newest": [F.desc_nulls_last("year")], "oldest": [F.asc_nulls_last("year")], "curated": [F.desc_nulls_last("weight"), F.asc_nulls_last("year")]}
    return top_n(typed, ["artist_id"], [*by[order], F.asc("id")], most, "place")


def rule_a_credits(track: DataFrame, release: DataFrame, masters: DataFrame, roles: list[str] | None = None, skip_own: bool = False) -> DataFrame:
    """Credits of each artist by master: distinct roles in order, track positions, whether any is on the whole release.

    track(artist_id, master_id, role, position), release(artist_id, master_id, role), masters(id, artist_id, year, weight).
    One row a credit up to the last step; text is made of the distinct roles and positions of one artist on one master only.
    """
    both = track.select("artist_id", "master_id", "role", "position").unionByName(release.select("artist_id", "master_id", "role").withColumn("position", F.lit(None).cast("string")))
    if roles is not None:
        both = both.filter(F.col("role").isin(roles))
    lines = both.groupBy("artist_id", "master_id", "role", "position").agg(F.lit(1).alias("one"))
    per = lines.groupBy("artist_id", "master_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        F.array_join(F.array_sort(F.collect_set("position")), ",").alias("tracks"),
        F.max(F.col("position").isNull()).alias("has_release_level"),
    )
    host = masters.select(F.col("id").alias("master_id"), F.col("artist_id").alias("_own"), "year", "weight")
    out = per.join(host, "master_id")
    return (out.filter(~F.col("_own").eqNullSafe(F.col("artist_id"))) if skip_own else out).drop("_own")


def collaborators(credits: DataFrame, aliases: DataFrame, most: int = 30) -> DataFrame:
    """For each artist: who else is credited on the masters of it and its aliases, by masters together, with roles by frequency.

    credits(artist_id, master_id, role), aliases(id, other). The asked artists' masters meet the credits; no pairs inside a master.
    Credits, and the meetings, which are made once, are dealt by rows.
    """
    # an artist's few aliases go along with its masters
    own = aliases.groupBy("id").agg(F.collect_set("other").alias("own"))
    own = own.select("id", "own", F.explode("own").alias("other"))
    asked = dealt(credits.select(F.col("artist_id").alias("other"), "master_id"), "other").join(own, "other").select("id", "own", "master_id").distinct()
    met = dealt(credits.select(F.col("artist_id").alias("mate"), "master_id", "role"), "master_id").join(asked, "master_id")
    met = met.filter(~F.array_contains("own", F.col("mate")))
    met = dealt(written(met.select("id", "mate", "master_id", "role"), "met"), "id")
    roles = met.groupBy("id", "mate", "role").agg(F.count("*").alias("n"))
    listed = roles.groupBy("id", "mate").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "role"))).alias("r"))
    n = met.select("id", "mate", "master_id").distinct().groupBy("id", "mate").agg(F.count("*").alias("masters"))
    top = top_n(n, ["id"], [F.desc("masters"), F.asc("mate")], most, "place")
    return top.join(listed, ["id", "mate"]).select("id", "mate", "masters", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"), "place")


def labelmates(masters: DataFrame, asked: DataFrame, barred: DataFrame, own_least: int = 2) -> DataFrame:
    """Artists on the labels where an asked artist has `own_least` masters or more, big labels counting less, none left out.

    masters(label, artist_id, master_id), asked(id), barred(id, other): aliases and bandmates. A shared label counts the lesser of
    both artists' masters, over the root of all its masters in the score. Result: id, mate, labels, together, score, label_names
    (three at most). Pairs are made where a mate's labels lie.
    """
    per = masters.filter("artist_id IS NOT NULL").groupBy("label", "artist_id", "master_id").agg(F.lit(1).alias("one")).groupBy("label", "artist_id").agg(F.count("*").alias("k"))
    per = written(per, "labelmates")
    total = masters.select("label", "master_id").distinct().groupBy("label").agg(F.count("*").alias("total"))
    own = per.join(asked.select(F.col("id").alias("artist_id")).distinct(), "artist_id").filter(F.col("k") >= own_least)
    own = written(own.join(total, "label").select("label", F.col("artist_id").alias("id"), F.col("k").alias("mine"), "total"), "labelmates-own")
    # the few that bar a mate go along with its labels
    bars = barred.groupBy(F.col("other").alias("mate")).agg(F.collect_set("id").alias("bars"))
    rows = per.join(own.select("label").distinct(), "label", "left_semi").select("label", F.col("artist_id").alias("mate"), F.col("k").alias("theirs")).join(bars, "mate", "left")

    def fold(met: Met) -> list:
        mate, label, theirs = (met.row[c].to_numpy() for c in ("mate", "label", "theirs"))
        met.filter(met.keys[met.key[met.a]] != mate[met.r])
        said = met.row["bars"].combine_chunks()
        ids, of = pc.list_flatten(said).to_numpy(zero_copy_only=False), pc.list_parent_indices(said).to_numpy()
        at = np.minimum(np.searchsorted(met.keys, ids), len(met.keys) - 1)
        known = met.keys[at] == ids
        met.filter(~np.isin(met.r * len(met.keys) + met.key[met.a], of[known] * len(met.keys) + at[known]))
        less = lambda: np.minimum(met.asked["mine"][met.a], theirs[met.r])
        first = met.grouped(-less(), label[met.r])
        n = np.diff(np.r_[first, len(met.r)])
        if not len(n):
            return [n] * 6
        sums, most = less(), np.minimum(n, 3)
        ends = np.cumsum(most)
        top = np.arange(ends[-1]) + np.repeat(first - ends + most, most)
        names = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(label[met.r[top]]))
        score = np.add.reduceat(sums / np.sqrt(met.asked["total"][met.a]), first)
        return [met.keys[met.key[met.a[first]]], mate[met.r[first]], n, np.add.reduceat(sums, first), score, names]

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("mate", "label")}
    schema = f"id {kind['mate']}, mate {kind['mate']}, labels long, together long, score double, l array<{kind['label']}>"
    met = meetings(own, rows, "label", "id", "mate", fold, schema)
    return met.withColumn("label_names", F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).drop("l")


def labelmates_idf(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked(label, id, idf), members(label, artist), each pair once -> id, artist, labels, score: who shares an asked artist's labels, with their idf."""

    def fold(met: Met) -> list:
        artist = met.row["artist"].to_numpy()
        met.filter(met.keys[met.key[met.a]] != artist[met.r])
        first = met.grouped()
        if not len(first):
            return [first] * 4
        n = np.diff(np.r_[first, len(met.r)])
        return [met.keys[met.key[met.a[first]]], artist[met.r[first]], n, np.add.reduceat(met.asked["idf"][met.a], first)]

    kind = members.schema["artist"].dataType.simpleString()
    members = members.filter("artist IS NOT NULL")
    return meetings(asked.filter("id IS NOT NULL"), members, "label", "id", "artist", fold, f"id {kind}, artist {kind}, labels long, score double")


def images(rows: DataFrame) -> DataFrame:
    """rows(entity, source, role, id, url): each entity's images, manual ones first, then by role, then by id, numbered."""
    role = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in IMAGE_ROLES]), F.col("role")), F.lit(0))
    role = F.when(role == 0, len(IMAGE_ROLES) + 1).otherwise(role)
    w = Window.partitionBy("entity").orderBy(F.when(F.col("source") == "manual", 0).otherwise(1), role, "id")
    return rows.withColumn("place", F.row_number().over(w))


def session_playlist(ids: DataFrame, masters: DataFrame, videos: DataFrame) -> DataFrame:
    """ids(session, ids array) -> session, place, id, title, video: in play order, each with its first video; not_found where unknown."""
    asked = ids.select("session", F.posexplode("ids").alias("place", "id"))
    first = videos.filter(L.video_id(F.col("url")).isNotNull()).groupBy("master_id").agg(F.min_by("url", "position").alias("url"))
    out = asked.join(masters.select("id", "title", F.lit(True).alias("known")), "id", "left").join(first.withColumnRenamed("master_id", "id"), "id", "left")
    return out.select("session", "place", "id", "title", L.video_id(F.col("url")).alias("video"), F.col("known").isNull().alias("not_found"))


def scene_wall(members: DataFrame, masters: DataFrame, each: int, start: Column, end: Column) -> DataFrame:
    """The `each` heaviest masters of each member label, inside the scene's era (unknown years stay), oldest first.

    members(scene, label), masters(label, master, weight, year); labels without any master are not in the result.
    """
    rows = members.join(masters, "label").filter(F.col("year").isNull() | F.col("year").between(start, end))
    top = top_n(rows, ["scene", "label"], [F.desc_nulls_last("weight"), F.asc_nulls_last("year"), F.asc("master")], each, "place")
    era = Window.partitionBy("scene", "label")
    return top.withColumn("first_year", F.min("year").over(era)).withColumn("last_year", F.max("year").over(era))


def relationships(edges: DataFrame, least: float, sources: list[str] | None = None) -> DataFrame:
    """edges(id, from_kind, from_id, to_kind, to_id, kind, confidence, source_id): outbound rows as they are, inbound ones swapped.

    At least `least` confidence; once a (entity, other, kind, source); the surest first, then the source, then the id.
    """
    e = edges.filter(F.col("confidence") >= least)
    if sources is not None:
        e = e.filter(F.col("source_id").isin(sources))
    ends = lambda a, b, way: F.struct(F.col(f"{a}_kind").alias("entity_kind"), F.col(f"{a}_id").alias("entity_id"), F.col(f"{b}_kind").alias("other_kind"), F.col(f"{b}_id").alias("other_id"), F.lit(way).alias("direction"))
    both = e.select("id", "kind", "confidence", "source_id", F.explode(F.array(ends("from", "to", "out"), ends("to", "from", "in"))).alias("x"))
    both = both.select("x.*", "id", "kind", "confidence", "source_id")
    keys = ["entity_kind", "entity_id", "other_kind", "other_id", "kind", "source_id"]
    return keep_first(both, keys, [F.desc("confidence"), F.asc("id"), F.desc("direction")])


def crates(saved: DataFrame, offers: DataFrame, masters: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """saved(user, list, master, added), offers(master): what each user saved, in shop first, newest first; and counts and top tastes.

    The second result: user, kind (list, style, label, artist), value, n; of styles, labels and artists the `most` frequent.
    """
    rows = saved.join(offers.select("master").distinct().withColumn("in_shop", F.lit(True)), "master", "left").withColumn("in_shop", F.coalesce("in_shop", F.lit(False)))
    w = Window.partitionBy("user").orderBy(F.desc("in_shop"), F.desc("added"), F.asc("master"))
    listed = rows.withColumn("place", F.row_number().over(w))
    wide = rows.join(masters, "master")
    facet = lambda k, v: F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value"))
    one = F.array(facet("list", F.col("list")), facet("label", F.col("label")), facet("artist", F.col("artist")))
    n = wide.select("user", F.explode(F.concat(one, F.transform("styles", lambda x: facet("style", x)))).alias("x")).groupBy("user", "x.kind", "x.value").agg(F.count("*").alias("n"))
    top = top_n(n, ["user", "kind"], [F.desc("n"), F.asc("value")], most, "_rn").drop("_rn")
    lists = n.filter("kind = 'list'")
    return listed, top.filter("kind <> 'list'").unionAll(lists)


def corpus_search(queries: DataFrame, index, names: DataFrame, search, limit: int = 8, least_hits: int = 3, similarity: float = 0.45) -> DataFrame:
    """Per query the best `limit` entities over all types: full-text hits; under `least_hits` of them, similar names as well.

    names(type, id, name, count); `search` is the module of match_texts() and similar(). A producer's rank gains a hundredth
    for each of its count, up to fifty. Of each type at most half the limit (three at least) take part, by score, count and
    id. Exact names come first, then by score. Result: qid, type, id, score, exact, place.
    """
    each = max(3, -(-limit // 2))
    best = lambda df: top_n(df, ["q", "type"], [F.desc("score"), F.desc("count"), F.asc("id")], each, "_n").drop("_n")
    texts = queries.select("q").distinct()
    gain = F.when(F.col("type") == "producer", F.least("count", F.lit(50)) / 100).otherwise(0.0)
    hits = best(search.match_texts(texts, index).join(names, ["type", "id"]).withColumn("score", F.col("raw_rank") + gain).drop("raw_rank"))
    n = hits.groupBy("q").agg(F.count("*").alias("n"))
    poor = texts.join(n, "q", "left").filter(F.coalesce("n", F.lit(0)) < least_hits).select(F.col("q").alias("qid"), "q")
    near = search.similar(poor, names.select(F.struct("type", "id").alias("id"), "name"), similarity)
    near = near.select(F.col("qid").alias("q"), "id.type", "id.id", F.col("sim").alias("score")).join(names, ["type", "id"])
    near = best(near).join(hits.select("q", "type", "id"), ["q", "type", "id"], "left_anti")
    both = hits.select("q", "type", "id", "name", "score").union(near.select("q", "type", "id", "name", "score"))
    both = both.withColumn("exact", F.lower("name") == F.lower(F.trim("q")))
    top = top_n(both, ["q"], [F.desc("exact"), F.desc("score"), F.asc("type"), F.asc("id")], limit, "place")
    return top.join(queries, "q").select("qid", "type", "id", "score", "exact", "place")


def counter_dressing(wines: DataFrame, producers: DataFrame, links: DataFrame, pictures: DataFrame) -> DataFrame:
    """Evidence dressed for display: each wine's producer, its own site or else its best link (website first), its picture; only http(s)."""
    web = lambda c: F.when(F.col(c).rlike("(?i)^https?://"), F.col(c))
    best = links.withColumn("url", web("url")).filter("url IS NOT NULL").groupBy("producer_id").agg(F.min_by("url", F.struct(F.col("kind") != "website", "id")).alias("link"))
    out = wines.join(producers.select(F.col("id").alias("producer_id"), F.col("name").alias("producer"), web("site").alias("site")), "producer_id", "left")
    out = out.join(best, "producer_id", "left").join(pictures.select("external_id", web("url").alias("image")), "external_id", "left")
    return out.select("id", "producer", F.coalesce(F.nullif("site", F.lit("")), "link").alias("site"), "image")


def shaped_clauses(clauses: DataFrame, key: str, most: int = 8, width: int = 520) -> DataFrame:
    """clauses(key, id, style_key, clause): styles in order (none first, then by key), cut at a word under `width` characters; how many are left out."""
    short = F.when(F.length("clause") <= width, F.col("clause")).otherwise(F.concat(F.regexp_replace(F.substring("clause", 1, width), r"\s+\S*$", ""), F.lit("…")))
    total = clauses.groupBy(key).agg(F.count("*").alias("total"))
    top = top_n(clauses.withColumn("clause", short), [key], [F.asc_nulls_first("style_key"), F.asc("id")], most, "place")
    return top.join(total, key).withColumn("left_out", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


def grapes_by_naming(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, grape, named_in_rules, a tri-state): sorted lists of the named, the not named and the unknown grapes."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("grape")))), ",")
    n = F.col("named_in_rules")
    return rows.groupBy(key).agg(listed(n).alias("named"), listed(~n).alias("not_named"), listed(n.isNull()).alias("unknown"))


def dispatch(scope: str, scopes: dict[str, Callable[..., DataFrame]], **params) -> DataFrame:
    """The traversal of one of the known scopes."""
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope}; known are {', '.join(sorted(scopes))}")
    return scopes[scope](**params)


#: Axes of scenes in the order of a list, others after them (fixed values).
AXES = ["geography", "cluster", "sound", "era", "bridge"]


def scene_details(scenes: DataFrame, members: DataFrame, labels: DataFrame, bridges: DataFrame) -> DataFrame:
    """Scenes in the order of a list, each with its members and bridges.

    scenes(slug, name, axis, era_start, hero, palette), members(slug, label, rank), labels(label, name, palette), bridges(source,
    target, strength). A scene without a palette has its hero label's. Members that are no known label are counted but not
    listed; bridges out and in name scenes that exist, strongest first. place is by axis, begin of the era (unknown last), name.
    """
    hero = labels.select(F.col("label").alias("hero"), F.col("palette").alias("hero_palette"))
    out = scenes.join(hero, "hero", "left").withColumn("palette", F.coalesce("palette", "hero_palette")).drop("hero_palette")
    named = members.join(labels.select("label", F.col("name").alias("label_name")), "label", "left")
    listed = named.groupBy("slug").agg(F.count("*").alias("label_count"), F.array_sort(F.collect_list(F.when(F.col("label_name").isNotNull(), F.struct("rank", "label_name")))).alias("m"))
    known = scenes.select(F.col("slug").alias("other"), F.col("name").alias("other_name"))

    def side(own: str, far: str, name: str) -> DataFrame:
        rows = bridges.select(F.col(own).alias("slug"), F.col(far).alias("other"), (-F.col("strength")).alias("s")).join(known, "other")
        return rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("s", "other_name"))).alias(name))

    for part in (listed, side("source", "target", "o"), side("target", "source", "i")):
        out = out.join(part, "slug", "left")
    names = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>"))
    axis = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, AXES)), F.col("axis")), F.lit(0)), F.lit(len(AXES) + 1))
    place = F.row_number().over(Window.orderBy(axis, F.asc_nulls_last("era_start"), F.asc("name"), F.asc("slug")))  # a scene list is one page
    out = out.withColumn("place", place)
    return out.select("slug", "name", "axis", "era_start", "palette", F.coalesce("label_count", F.lit(0)).alias("label_count"), names("m", "label_name").alias("labels"), names("o", "other_name").alias("bridges_out"), names("i", "other_name").alias("bridges_in"), "place")


def core_run(curated: DataFrame, auto: DataFrame, masters: DataFrame, most: int = 10) -> DataFrame:
    """A label's core run: curated(label, master, rank) first, by rank, then auto(label, master, rank) that is not curated.

    masters(master, title) drops entries of unknown masters. Result: label, master, source, title, place (the first `most`).
    """
    rest = auto.join(curated.select("label", "master"), ["label", "master"], "left_anti")
    both = curated.select("label", "master", "rank", F.lit("curated").alias("source")).union(rest.select("label", "master", "rank", F.lit("auto")))
    rows = both.join(masters.select("master", "title"), "master")
    return top_n(rows, ["label"], [F.desc("source"), F.asc("rank"), F.asc("master")], most, "place").select("label", "master", "source", "title", "place")


def related_labels(edges: DataFrame, labels: DataFrame, directions: list[str]) -> DataFrame:
    """edges(label, other, direction, rank), labels(label, name) -> label, direction, other, name, place; edges to unknown labels go."""
    named = edges.filter(F.col("direction").isin(directions)).join(labels.select(F.col("label").alias("other"), "name"), "other")
    return top_n(named, ["label", "direction"], [F.asc("rank"), F.asc("name"), F.asc("other")], 2**31 - 1, "place").select("label", "direction", "other", "name", "place")
