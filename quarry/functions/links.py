"""Links, markup and citations in texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: First path segments that are no account names (fixed values).
RESERVED = "p reel explore accounts about developer privacy legal direct".split()


def linkout(url: Column) -> Column:
    """struct(provider, url, handle, confidence) of a bandcamp or instagram account; null for any other link.

    The bare host has no sub-domain, so its account is the first segment of the path; hosts that only end alike are others.
    """
    u = F.trim(url)
    shape = r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]+)?([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(u, shape, 1)), r"^www\.", "")
    segment = F.get(F.filter(F.split(F.regexp_extract(u, shape, 2), "/"), lambda p: p != ""), F.lit(0))
    valid = lambda h: F.when(h.rlike("^[a-z0-9._-]+$"), h)
    # the account is the host's part before bandcamp.com; the bare host names it in the path
    bandcamp = F.regexp_extract(host, r"^(?:(.+)\.)?bandcamp\.com$", 1)
    band = F.when(bandcamp != "", valid(bandcamp)).otherwise(valid(F.lower(F.trim(segment))))
    insta = F.when(~F.lower(segment).isin(RESERVED), valid(F.lower(F.trim(segment))))
    said = lambda p, link, h, c: F.when(h.isNotNull(), F.struct(F.lit(p).alias("provider"), link.alias("url"), h.alias("handle"), F.lit(c).alias("confidence")))
    banded = said("bandcamp", F.concat(F.lit("https://"), band, F.lit(".bandcamp.com")), band, 1.0)
    instant = said("instagram", F.concat(F.lit("https://instagram.com/"), insta), insta, 0.98)
    return F.when(u.rlike(shape), F.when(host.rlike(r"(^|\.)bandcamp\.com$"), banded).when(host == "instagram.com", instant))


def video_id(url: Column) -> Column:
    """The eleven characters of a video's id; null if there is none."""
    shape = r"(?:youtube\.com/(?:watch\?(?:.*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})"
    return F.nullif(F.regexp_extract(url, shape, 1), F.lit(""))


def file_url(url: Column, width: int | None) -> Column:
    """https in place of http; file-path links of the commons also get the wanted width."""
    https = F.when(url.startswith("http://"), F.concat(F.lit("https://"), F.substr(url, F.lit(8)))).otherwise(url)
    if not width or width <= 0:
        return https
    sized = F.concat(https, F.when(https.contains("?"), "&").otherwise("?"), F.lit(f"width={round(width)}"))
    return F.when(https.contains("commons.wikimedia.org/wiki/Special:FilePath/"), sized).otherwise(https)


def markup_refs(profile: Column) -> Column:
    """array<struct<kind, id, name>> of a profile's references: [a123], [l=Name] and the like."""
    kinds = F.create_map(*[F.lit(x) for x in ("a", "artist", "l", "label", "m", "master", "r", "release")])
    found = F.regexp_extract_all(profile, F.lit(r"(?i)\[([almr])(=?)([^\]\[]+)\]"), F.lit(0))
    shape = r"(?i)\[([almr])(=?)([^\]\[]+)\]"

    def ref(m: Column) -> Column:
        body = F.regexp_extract(m, shape, 3)
        number = F.when(body.rlike("^[0-9]+$"), body.try_cast("long"))
        kind = F.try_element_at(kinds, F.lower(F.regexp_extract(m, shape, 1)))
        named = F.when(number.isNull() & (F.regexp_extract(m, shape, 2) == "="), body)
        return F.struct(kind.alias("kind"), number.alias("id"), named.alias("name"))

    return F.filter(F.transform(found, ref), lambda r: r["id"].isNotNull() | r["name"].isNotNull())


def plain_profile(profile: Column) -> Column:
    """A profile without markup: named references are their names, style tags and numbered references go."""
    t = F.regexp_replace(profile, r"(?i)\[[almr]=([^\]\[]+)\]", "$1")
    t = F.regexp_replace(t, r"(?i)\[url=[^\]]*\]", "")
    return F.regexp_replace(t, r"(?i)\[/?(?:b|i|u|url)\]|\[[almr]?[0-9]+\]", "")


def cited_ids(answer: Column, site: str, kind: str = "master") -> Column:
    """Distinct ids of the links to site/kind/id in an answer, in order of appearance."""
    pattern = site.replace(".", r"\.") + f"/{kind}/([0-9]+)"
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("long")))


def unlink(answer: Column, evidence: Column, site: str) -> Column:
    """An answer whose links to entities outside the evidence (an array of 'kind/id') are their texts."""
    link = r"\[([^\]]+)\]\(https?://" + site.replace(".", r"\.") + r"/(master|artist|label)/([0-9]+)/?\)"
    gaps, hits = F.split(answer, link, -1), F.regexp_extract_all(answer, F.lit(link), F.lit(0))

    def kept(m: Column) -> Column:
        key = F.concat_ws("/", F.regexp_extract(m, link, 2), F.regexp_extract(m, link, 3).cast("decimal(38,0)").cast("string"))
        return F.when(F.array_contains(evidence, key), m).otherwise(F.regexp_extract(m, link, 1))

    body = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.concat(g, kept(m)))
    return F.concat(F.array_join(body, ""), F.element_at(gaps, -1))
