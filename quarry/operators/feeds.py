"""Shaping of external feeds and telemetry: statements, set lists, links, logs, events, quotas. JSON comes as text columns or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, links as L
from .relational import keep_first

#: Statements that make up a location and a timeline, by property (fixed values).
PLACES = {"P495": "country_of_origin_qid", "P27": "country_of_citizenship_qid", "P740": "location_of_formation_qid", "P19": "place_of_birth_qid"}
TIMES = {"P571": "formed", "P576": "dissolved", "P569": "born", "P570": "died"}
GENRE, WEBSITE, CONFIDENCE = "P136", "P856", 0.85


def context_rows(entities: DataFrame) -> DataFrame:
    """entities(id, qid, json) -> id, context_type, content (a map), source_id, confidence, context_key: bio, location, timeline_note."""
    text = lambda path: F.get_json_object("json", path)
    value = lambda p: f"$.claims.{p}[0].mainsnak.datavalue.value"
    dated = lambda p: C.statement_time(text(value(p) + ".time"), text(value(p) + ".precision").try_cast("int"))
    genres = F.from_json(text(f"$.claims.{GENRE}[*].mainsnak.datavalue.value.id"), "array<string>")
    one = F.when(text(f"$.claims.{GENRE}[*].mainsnak.datavalue.value.id").startswith("["), genres).otherwise(F.array(F.replace(text(f"$.claims.{GENRE}[*].mainsnak.datavalue.value.id"), F.lit('"'), F.lit(""))))
    said = F.when(text(f"$.claims.{GENRE}").isNotNull(), F.array_join(one, ","))
    bio = {"name": text("$.labels.en.value"), "summary": text("$.descriptions.en.value"), "genre_qids": said, "official_website": text(value(WEBSITE))}
    place = {name: text(value(p) + ".id") for p, name in PLACES.items()}
    when = {name: dated(p) for p, name in TIMES.items()}

    def row(kind: str, content: dict[str, Column], needed: list[str]) -> Column:
        full = F.map_filter(F.create_map(*[x for k, v in content.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != ""))
        return F.when(F.coalesce(*[F.nullif(content[k], F.lit("")) for k in needed]).isNotNull(), F.struct(F.lit(kind).alias("context_type"), full.alias("content")))

    rows = F.array(row("bio", bio, ["name", "summary"]), row("location", place, list(place)), row("timeline_note", when, list(when)))
    out = entities.select("id", F.col("qid").alias("source_id"), F.explode(rows).alias("x")).filter("x IS NOT NULL").select("id", "x.*", "source_id")
    key = F.concat_ws(":", F.lit("wikidata:artist"), F.col("id").cast("string"), "context_type")
    return out.withColumn("confidence", F.lit(CONFIDENCE)).withColumn("context_key", key)


SETLIST = "id string, url string, eventDate string, tour struct<name:string>, venue struct<name:string,city:struct<name:string,coords:struct<lat:double,long:double>,country:struct<name:string,code:string>>>, sets struct<`set`:array<struct<song:array<struct<name:string>>>>>"


def setlist_events(feed: DataFrame) -> DataFrame:
    """feed(artist_id, json) -> one event a set list that has id, url and a dd-mm-yyyy date; songs are counted over all its sets."""
    x = feed.select("artist_id", F.from_json("json", SETLIST).alias("x")).filter("x.id IS NOT NULL AND x.url IS NOT NULL")
    part = lambda i: F.regexp_extract("x.eventDate", r"^([^-]+)-([^-]+)-([^-]+)", i)
    songs = F.aggregate(F.coalesce("x.sets.set", F.array()), F.lit(0), lambda a, s: a + F.coalesce(F.size(s["song"]), F.lit(0)))
    x = x.filter(F.col("x.eventDate").rlike(r"^[^-]+-[^-]+-[^-]+"))
    place = F.col("x.venue.city")
    return x.select(
        "artist_id", F.concat_ws("-", part(3), part(2), part(1)).alias("event_date"), F.col("x.venue.name").alias("venue_name"), place["name"].alias("city_name"),
        place["country"]["code"].alias("country_code"), place["coords"]["lat"].alias("latitude"), F.col("x.tour.name").alias("tour_name"), songs.alias("song_count"), F.col("x.id").alias("setlist_id"),
    )


def best_linkouts(urls: DataFrame, owner: str) -> DataFrame:
    """urls(owner, url) -> the surest account of each owner and provider, then the shortest link, then the least."""
    found = urls.select(owner, L.linkout(F.col("url")).alias("x")).filter("x IS NOT NULL").select(owner, "x.*")
    return keep_first(found, [owner, "provider"], [F.desc("confidence"), F.length("url").asc(), F.asc("url")])


def log_entries(lines: DataFrame) -> DataFrame:
    """lines(value) of a request log -> method, route, status, ms: JSON lines, also wrapped in a message; others and incomplete ones go."""
    shape = "message string, method string, url string, reqUrl string, statusCode int, status int, responseTime double, elapsed_ms double, duration double, req struct<method:string,url:string>, res struct<statusCode:int>"
    x = lines.filter(F.trim("value").startswith("{")).select(F.from_json("value", shape).alias("o"))
    inner = F.when(F.col("o.message").startswith("{"), F.from_json("o.message", shape))
    e = x.select(F.coalesce(inner, "o").alias("e"))
    from ..functions.text import route

    url = F.coalesce("e.req.url", "e.url", "e.reqUrl")
    out = e.select(F.coalesce("e.req.method", "e.method").alias("method"), route(url).alias("route"), F.coalesce("e.res.statusCode", "e.statusCode", "e.status").alias("status"), F.coalesce("e.responseTime", "e.elapsed_ms", "e.duration").alias("ms"))
    return out.filter("method IS NOT NULL AND route IS NOT NULL AND ms IS NOT NULL").withColumn("ms", F.round("ms").cast("long"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles and the largest value of each key.

    Values are counted before they meet, so a hot key costs as many rows as it has different values, in range-sorted pieces.
    """
    from pyspark.sql import Window

    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = n.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max(value).alias("max"))
    upto = n.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = upto.join(total, keys)
    # the least value that as many rows as the share's rank reach
    picks = [F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_total") * p), F.lit(1)), F.col(value))).alias(name) for name, p in shares.items()]
    return at.groupBy(*keys).agg(*picks, F.first("max").alias("max"), F.first("_total").alias("n"))


def valid_events(events: DataFrame, allowed: list[str], most: int = 25) -> DataFrame:
    """events(batch, place, event, session, properties JSON) -> the allowed ones of batches of at most `most`, simple properties as p_ keys."""
    size = events.groupBy("batch").agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select("batch")
    ok = events.filter(F.col("event").isin(allowed) & (F.coalesce("session", F.lit("")) != "")).join(size, "batch", "left_semi")
    flat = F.map_filter(F.from_json("properties", "map<string,string>"), lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    return ok.withColumn("properties", F.transform_keys(flat, lambda k, v: F.concat(F.lit("p_"), k)))


def failure_windows(events: DataFrame, ts: str, failed: Column, keys: list[str], width: str = "15 minutes") -> DataFrame:
    """Share of failures by tumbling window and key; the same plan for batch and for streams."""
    g = events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "failed", F.round(F.col("failed") / F.col("n"), 4).alias("rate"))


def quota_usage(uses: DataFrame, user: str, ts: str, by_day: int, by_month: int) -> DataFrame:
    """Uses by user and UTC day, running total of the month, and whether the day's or the month's quota is exceeded."""
    from pyspark.sql import Window

    d = uses.groupBy(user, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(user, F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("month_n", F.sum("n").over(w)).withColumn("over", (F.col("n") > by_day) | (F.col("month_n") > by_month))


def window_counts(events: DataFrame, day: str, key: str, today: str, days: list[int]) -> DataFrame:
    """Counts by key over the last 1, 7, 30, ... days up to today, in one pass: a row reaches each window it lies in."""
    age = F.datediff(F.lit(today).cast("date"), F.col(day))
    reach = F.explode(F.filter(F.array(*[F.lit(n) for n in days]), lambda n: (age >= 0) & (age < n)))
    return events.select(key, reach.alias("days")).groupBy("days", key).agg(F.count("*").alias("n"))
