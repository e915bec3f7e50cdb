"""Classifiers and parsers of catalog texts: roles, qualities, release types, positions, dates, numbers, countries, colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import missing, name_key, words

#: Role buckets in the order of their tests (fixed values): (bucket, pattern).
ROLES = [
    ("Edit", "(^|[^a-z])edit($|[^a-z])"),
    ("Dub", "(^|[^a-z])dub($|[^a-z])|dub mix"),
    ("Remix", "^remix|remixer|re-?mix"),
    ("Additional Production", "co-?produced|additional production|associate producer"),
    ("Producer", "^produced by|^producer|^production"),
    ("Mastered By", "mastered by|^master( |$)|mastering"),
    ("Mixed By", "^mix|^mixed by|^mixing|mix engineer"),
    ("Engineer", "engineer|recorded by|recording|programmed by"),
    ("Written By", "written by|writer|composer|composed by|words by|lyrics by"),
    ("Vocals", r"vocals?|featuring|^feat|^ft\.|sung by|backing vocals"),
]
#: Families of work, first match (fixed values).
WORK_FAMILIES = [
    ("writing", "writ|compos|lyric|author"),
    ("arranging", "arrang|orchestrat|conduct|direct"),
    ("performance", "perform|vocals?|guitar|bass|drums?|keys|piano|trumpet|saxophone|violin|voice|singer|rapper|dj|turntabl|instrum"),
    ("production", "produc|remix|mix|master|engineer|record|studio|program"),
]
#: Families of credits, first match (fixed values).
CREDIT_FAMILIES = [
    ("remix", "remix|re-?edit|rework|version"),
    ("produce", "produc"),
    ("engineer", "engineer|recorded by"),
    ("mix", "mixed|mix(?!.*remix)|mixing"),
    ("master", "master"),
    ("write", "writ|compos|lyric"),
    ("vocal", "vocal|voice|sing"),
]
#: Role buckets behind a short filter word (fixed values).
ROLE_ALIASES = {
    "remix": ["Remix", "Edit", "Dub"],
    "produce": ["Producer", "Additional Production"],
    "mix": ["Mixed By"],
    "master": ["Mastered By"],
    "write": ["Written By"],
    "vocal": ["Vocals"],
    "engineer": ["Engineer"],
}
PLACEHOLDER = r"(?i)^(artist\s+\d+|unknown|undefined|n/?a|none|null|test)\b"
#: ISO codes by the country names of the sources, as keys (fixed values).
COUNTRIES = {
    "france": "FR", "frankrike": "FR", "italy": "IT", "italien": "IT", "spain": "ES", "spanien": "ES", "germany": "DE", "tyskland": "DE",
    "austria": "AT", "osterrike": "AT", "portugal": "PT", "united states": "US", "usa": "US", "united kingdom": "GB",
    "storbritannien": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "australia": "AU", "australien": "AU", "new zealand": "NZ",
    "nya zeeland": "NZ", "south africa": "ZA", "sydafrika": "ZA", "argentina": "AR", "chile": "CL", "canada": "CA", "kanada": "CA",
    "hungary": "HU", "ungern": "HU", "greece": "GR", "grekland": "GR", "switzerland": "CH", "schweiz": "CH", "lebanon": "LB",
    "libanon": "LB", "israel": "IL", "japan": "JP", "mexico": "MX", "mexiko": "MX", "uruguay": "UY", "turkey": "TR", "turkiet": "TR",
    "brazil": "BR", "brasilien": "BR", "slovenia": "SI", "slovenien": "SI", "czech republic": "CZ", "tjeckien": "CZ", "luxembourg": "LU",
    "luxemburg": "LU", "georgia": "GE", "georgien": "GE", "moldova": "MD", "moldavien": "MD", "bulgaria": "BG", "bulgarien": "BG",
    "ukraine": "UA", "ukraina": "UA", "cyprus": "CY", "cypern": "CY", "romania": "RO", "rumanien": "RO", "denmark": "DK", "danmark": "DK",
    "ireland": "IE", "irland": "IE", "china": "CN", "kina": "CN", "folkrepubliken kina": "CN", "croatia": "HR", "kroatien": "HR",
    "poland": "PL", "polen": "PL", "morocco": "MA", "marocko": "MA", "netherlands": "NL", "nederlanderna": "NL", "sweden": "SE",
    "sverige": "SE", "finland": "FI", "india": "IN", "indien": "IN", "slovakia": "SK", "slovakien": "SK", "norway": "NO", "norge": "NO",
    "armenia": "AM", "armenien": "AM", "belgium": "BE", "belgien": "BE", "serbia": "RS", "serbien": "RS", "malta": "MT", "montenegro": "ME",
    "north macedonia": "MK", "nordmakedonien": "MK", "macedonia": "MK", "albania": "AL", "bosnia and herzegovina": "BA", "tunisia": "TN",
    "algeria": "DZ", "peru": "PE", "bolivia": "BO", "taiwan": "TW", "thailand": "TH", "vietnam": "VN", "russian federation": "RU",
    "russia": "RU", "ryssland": "RU", "republic of korea": "KR", "south korea": "KR", "egypt": "EG", "ethiopia": "ET", "kenya": "KE",
    "hong kong": "HK", "singapore": "SG", "indonesia": "ID", "philippines": "PH", "jersey": "JE", "guernsey": "GG", "bhutan": "BT",
    "ecuador": "EC", "syria": "SY", "venezuela": "VE", "azerbajdzjan": "AZ",
}
#: Colour statements by what they contain, in order of precedence, and colour words of names (fixed values).
COLOUR_STATEMENTS = [("rose", "pink|grey|gris|rose|rosé|rosa"), ("white", "white|green|yellow|blanc|gold|lime|amber"), ("red", "black|blue|noir|red|purpl|violet|ruby|brick|jet")]
NAME_WHITE = "blanc blanche blanco bianco bianca branco weiss weisser white belyi zold verde bily".split()
NAME_RED = "noir noire nero nera negro negra tinto tinta neagra modre modry schwarz schwarzer black rouge rosso rossa kek".split()


def first_match(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The bucket of the first rule whose pattern occurs in the text, whatever its case."""
    out = None
    for bucket, pattern in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return F.lit(other) if out is None else out.otherwise(other)


def role_bucket(role: Column) -> Column:
    return first_match(role, ROLES, "Other")


def work_family(role: Column) -> Column:
    return first_match(role, WORK_FAMILIES, "other")


def credit_family(role: Column) -> Column:
    return first_match(role, CREDIT_FAMILIES, "other")


def expand_role(role: str | None) -> list[str] | None:
    """The buckets that a role filter stands for; an exact bucket stands for itself, none for all."""
    return ROLE_ALIASES.get(role.lower(), [role]) if role else None


def quality(name: Column, data_quality: Column, artist: bool = False, profile: Column = None, real_name: Column = None, linked: Column = None) -> Column:
    """struct(status, reason); for artists also placeholder names, and those without profile, real name and links."""
    n = F.trim(F.coalesce(name, F.lit("")))
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    out = F.when(n == "", said("invalid", "empty_name")).when(n.rlike("^[0-9]+$"), said("low_value", "numeric_name"))
    out = out.when(data_quality == "Entirely Incorrect", said("suppressed", "discogs_quality_entirely_incorrect"))
    out = out.when(data_quality == "Needs Major Changes", said("low_value", "discogs_quality_needs_major_changes"))
    if artist:
        blank = lambda c: F.lit(True) if c is None else F.trim(F.coalesce(c, F.lit(""))) == ""
        alone = ~F.coalesce(linked, F.lit(True)) if linked is not None else F.lit(False)
        out = out.when(n.rlike(PLACEHOLDER), said("suppressed", "artist_placeholder_name"))
        unknown = (data_quality == "Needs Vote") & blank(profile) & blank(real_name) & alone
        out = out.when(unknown, said("low_value", "artist_unlinked_low_info"))
    return out.otherwise(said("active", "default_active"))


def release_type(formats: Column, title: Column, tracks: Column, artist: Column) -> Column:
    """struct(kind, label) from the format hints (an array, the primary one first), title, number of tracks and artist."""
    hints = F.transform(F.coalesce(formats, F.array().cast("array<string>")), lambda d: F.lower(d))
    first, t = F.coalesce(F.get(hints, F.lit(0)), F.lit("")), F.lower(F.coalesce(title, F.lit("")))
    said = lambda kind, label: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))
    has = lambda p: F.exists(hints, lambda d: d.rlike(p))
    comp = t.rlike("greatest hits|best of|anthology|compilation") | F.concat(F.lit(" "), t, F.lit(" ")).contains(" the best ")
    comp = comp | F.coalesce(F.lower(artist).isin("various", "various artists"), F.lit(False)) | has("comp")
    single_vinyl, disc = first.rlike(r"^vinyl\s*1\b"), first.rlike("^(cd|cassette)")
    album, single, twelve = said("album", "LP"), said("single_ep", "Single"), said("single_ep", '12"')
    return (
        F.when(comp, said("compilation", "Comp"))
        .when(first.rlike(r"^vinyl\s*[2-9]\b") | (disc & (tracks.isNull() | (tracks >= 7))), album)
        .when(single_vinyl, F.when(tracks >= 9, album).otherwise(twelve))
        .when(disc & (tracks <= 4), single)
        .when(has("album|^lp$"), album)
        .when(has('single|^7"$'), single)
        .when(has('ep|12"'), twelve)
        .otherwise(said("other", "Other"))
    )


def track_position(position: Column) -> Column:
    """struct(disc int, track string): 'd-t' is a disc and its track; sides, numbers and 'd.d' are tracks of disc 1; others have no disc."""
    p = F.nullif(F.trim(position), F.lit(""))
    pair = r"^([0-9]+)-([0-9]+)$"
    disc = F.regexp_extract(p, pair, 1).try_cast("int")
    disc = F.when(p.rlike(pair), F.when(disc.between(1, 9999), disc)).when(p.rlike(r"^[A-Za-z]|^[0-9]+$|^[0-9]+\.[0-9]+$"), 1)
    return F.struct(disc.alias("disc"), F.when(p.rlike(pair), F.regexp_extract(p, pair, 2)).otherwise(p).alias("track"))


def partial_date(text: Column) -> Column:
    """struct(year, month, day) of YYYY-MM-DD, YYYY-MM, YYYY, or the first four digits if from 1900 to 2100; zero parts are null."""
    t = F.trim(text)
    whole = r"^([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?$"
    part = lambda i: F.nullif(F.regexp_extract(t, whole, i).try_cast("int"), F.lit(0))
    loose = F.regexp_extract(t, "([0-9]{4})", 1).try_cast("int")
    year = F.when(t.rlike(whole), part(1)).when(loose.between(1900, 2100), loose)
    return F.struct(year.alias("year"), F.when(t.rlike(whole), part(2)).alias("month"), F.when(t.rlike(whole), part(3)).alias("day"))


def duration(text: Column) -> Column:
    """Seconds of m:s or h:m:s as an int; each part is its leading number; other shapes, negative and too large values are null."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.regexp_extract(p, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"))
    at = lambda i: F.get(parts, F.lit(i))
    total = F.when(F.size(parts) == 2, at(0) * 60 + at(1)).when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2))
    return F.when(total.between(0, 2147483647), total).cast("int")


def safe_int(text: Column) -> Column:
    """The leading integer if it fits 32 bits."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def tri_bool(text: Column) -> Column:
    """true for 'true' in any case, false for other texts, null for empty ones."""
    return F.when(text != "", F.lower(text) == "true")


def comma_number(text: Column) -> Column:
    """A number with a decimal point or comma; null for missing and other texts."""
    return F.replace(missing(text), F.lit(","), F.lit(".")).try_cast("double")


def statement_time(time: Column, precision: Column) -> Column:
    """A statement's time as Y, Y-M or Y-M-D by its precision 9, 10 or else."""
    shape = r"^[+-]?([0-9]{4})-([0-9]{2})-([0-9]{2})"
    part = lambda i: F.regexp_extract(time, shape, i)
    out = F.when(precision == 9, part(1)).when(precision == 10, F.concat_ws("-", part(1), part(2))).otherwise(F.concat_ws("-", part(1), part(2), part(3)))
    return F.when(time.rlike(shape), out)


def country_code(name: Column) -> Column:
    """ISO code of a country's name; two capitals are a code already; null if unknown."""
    t = missing(name)
    codes = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.when(t.rlike("^[A-Z]{2}$"), t).otherwise(F.try_element_at(codes, name_key(t)))


def plausible_yield(value: Column, unit: Column) -> Column:
    """A ceiling that a vineyard could carry: 15 to 250 hl or 1500 to 35000 kg a hectare."""
    return F.when(unit == "hl", value.between(15, 250)).otherwise(value.between(1500, 35000))


def stated_colour(cell: Column) -> Column:
    """Of colour statements joined by '|': rose before white before red; a lone 'black berry skin' is no evidence."""
    t = F.lower(F.trim(cell))
    out = F.when(t.isNull() | t.isin("", "na", "black berry skin"), "unknown")
    for colour, pattern in COLOUR_STATEMENTS:
        out = out.when(t.rlike(pattern), colour)
    return out.otherwise("unknown")


def catalog_colour(cell: Column) -> Column:
    """Colour of a berry-skin entry; null if unknown."""
    t = F.upper(F.trim(cell))
    return F.when(t == "BLANC", "white").when(t == "NOIR", "red").when(t.isin("ROUGE", "ROSE", "GRIS"), "rose")


def code_colour(code: Column) -> Column:
    """Colour of a register's code; null if unknown."""
    return F.when(code == "B", "white").when(code == "N", "red").when(code.isin("Rs", "Rg", "G", "Gr", "R"), "rose")


def grape_colour(catalog: Column, statements: Column) -> Column:
    """The one colour that an array of catalog colours agrees on, else that of the statements."""
    stated = F.array_distinct(F.filter(F.coalesce(catalog, F.array().cast("array<string>")), lambda c: c.isNotNull()))
    return F.when(F.size(stated) == 1, F.get(stated, F.lit(0))).otherwise(stated_colour(statements))


def name_colour(key: Column) -> Column:
    """The colour that a name's own words state: white before red; null if none does."""
    w = words(key)
    return F.when(F.exists(w, lambda x: x.isin(NAME_WHITE)), "white").when(F.exists(w, lambda x: x.isin(NAME_RED)), "red")
