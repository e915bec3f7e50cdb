"""Name keys, tokens, trigram similarity, phrases and slugs as Column expressions, all inside the JVM.

Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: Letters that no decomposition reaches, for loose keys (fixed values).
LIGATURES = {"æ": "ae", "ø": "o", "å": "a", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng"}
#: Title phrases and words that name no producer (fixed values).
TITLE_PHRASES = ["azienda agricola", "s r l", "s l", "s a", "and co"]
TITLE_WORDS = (
    "chateau domaine weingut bodega bodegas cantina tenuta maison clos mas quinta castello fattoria podere vina vinos cave caves "
    "celler cellers schloss winery vineyards vineyard estate wines wine family co az agr"
).split()
#: Legal and connecting words left out of a producer's core name (fixed values).
NOISE_WORDS = (
    "domaine chateau maison weingut bodegas bodega tenuta cantina champagne estate wineries winery vineyards vineyard wines wine "
    "cellars cellar azienda agricola fils pere sons "
    "et e and de du des la le les di della delle dei degli von van der y do da of"
).split()
#: Words of a wine's type at the end of a place name (fixed values).
TYPE_WORDS = (
    "rosso rossa bianco bianca rosato spumante chinato passito liquoroso novello frizzante amabile dolce secco vendemmia tardiva "
    "rouge blanc blanche rose sec moelleux doux mousseux tinto blanco espumoso dulce branco red white sparkling sweet reserve"
).split()
#: Colour words of a grape's name (fixed values).
COLOUR_WORDS = (
    "weisser weisse weiss weisen blauer blaue blau grauer graue roter rote rot gelber gelbe fruhroter fruhrote schwarzer "
    "blanc blanche blancs noir noire noirs gris grise rouge rose bianco bianca bianchi nero nera neri grigio grigia rosso rossa "
    "blanco blanca tinto tinta negro negra rosado roxo branco"
).split()
#: Abbreviations and words of a legal quality grade (fixed values).
LEGAL_ABBREVIATIONS = "aoc,aop,doc,docg,do,dop,igp,igt,ig,pdo,pgi,vdp,vqprd,g u,g g a,gu,gga,kpm".split(",")
LEGAL_WORDS = "qualitatswein pradikatswein".split()


@lru_cache(1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """From Unicode's compatibility decomposition: letters to single letters, and those that become several."""
    one, to, many = [], [], {}
    for i in range(0x80, 0x110000):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or not unicodedata.decomposition(c):
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ")
        if not any(x.isascii() for x in d):
            continue
        if len(d) == 1:
            one.append(c)
            to.append(d)
        else:
            many[c] = d
    return "".join(one), "".join(to), many


def decomposed(text: Column) -> Column:
    """NFKD without the marks U+0300 to U+036F, as far as plain ASCII comes out of it."""
    one, to, many = _decomposed()
    # letters that become several are rare: only texts that hold one are taken apart
    table = F.from_json(F.lit(_as_json(many)), "map<string,string>")
    several = "[" + _ranges(many) + "]"

    def plain(t: Column) -> Column:
        apart = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(several), F.try_element_at(table, c)).otherwise(c)), "")
        return F.regexp_replace(F.translate(F.when(t.rlike(several), apart).otherwise(t), one, to), "[̀-ͯ]", "")

    # the lambda binds the text, so that it is made once, and plain ASCII is left alone
    bound = F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), plain(t)).otherwise(t))
    return F.get(bound, F.lit(0))


def _ranges(letters: dict[str, str]) -> str:
    """The letters as ranges of a character class."""
    out, codes = [], sorted(map(ord, letters))
    first = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(chr(first) if first == last else f"{chr(first)}-{chr(last)}")
            first = c
        last = c
    return "".join(out)


def _as_json(table: dict[str, str]) -> str:
    import json

    return json.dumps(table, ensure_ascii=False)


def name_key(name: Column) -> Column:
    """The one join key: decomposed, sharp s spelled out, apostrophes gone, lower case, everything else a blank, trimmed."""
    t = F.regexp_replace(F.replace(decomposed(name), F.lit("ß"), F.lit("ss")), "[’'`´]", "")
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def loose_key(name: Column) -> Column:
    """name_key with ligatures and barred letters spelled out first; for finding only, never stored."""
    t = F.lower(F.coalesce(name, F.lit("")))
    for letter, plain in LIGATURES.items():
        t = F.replace(t, F.lit(letter), F.lit(plain))
    return name_key(t)


def missing(text: Column) -> Column:
    """Trimmed; null for the spellings of a missing value."""
    t = F.trim(text)
    return F.when(~t.isin("", "NA", "na", "null"), t)


def slug(text: Column) -> Column:
    """name_key's letters joined by hyphens; sharp s is not spelled out."""
    t = F.lower(F.regexp_replace(decomposed(text), "[’'`´]", ""))
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def find_slug(name: Column, vintage: Column) -> Column:
    """A search slug of a name and, where given and not 0, its vintage."""
    t = F.concat(F.coalesce(name, F.lit("")), F.when(vintage != 0, F.concat(F.lit(" "), vintage.cast("string"))).otherwise(""))
    return F.regexp_replace(F.regexp_replace(F.lower(decomposed(t)), "[^a-z0-9]+", "+"), r"^\+|\+$", "")


def title_case(text: Column) -> Column:
    """Lower case, with capitals after the start, white space, hyphens, apostrophes, brackets and slashes."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[\s\-'’(/]*[^\s\-'’(/]*"), F.lit(0))

    def raised(p: Column) -> Column:
        lead = F.regexp_extract(p, r"^[\s\-'’(/]*", 0)
        word = F.substr(p, F.length(lead) + 1)
        return F.concat(lead, F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))

    return F.array_join(F.transform(parts, raised), "")


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def _without(key: Column, noise: list[str]) -> Column:
    return F.filter(words(key), lambda w: ~w.isin(noise))


def strip_title(name: Column) -> Column:
    """name_key without title phrases and words, in order and with repeats; empty if nothing is left."""
    t = F.concat(F.lit(" "), name_key(name), F.lit(" "))
    for phrase in TITLE_PHRASES:
        t = F.replace(t, F.lit(f" {phrase} "), F.lit(" "))
    return F.array_join(_without(F.trim(t), TITLE_WORDS), " ")


def core_name(key: Column) -> Column:
    """A key without legal and connecting words."""
    return F.array_join(_without(key, NOISE_WORDS), " ")


def last_core_word(key: Column) -> Column:
    """The surname or estate word of a key; null if all words are noise."""
    return F.try_element_at(_without(key, NOISE_WORDS), F.lit(-1))


def strip_type(key: Column) -> Column:
    """A key without type words at its end; the only word stays."""
    return F.regexp_replace(key, f"(?<=[a-z0-9])(?: (?:{'|'.join(TYPE_WORDS)}))+$", "")


def strip_colour(key: Column) -> Column:
    return F.array_join(_without(key, COLOUR_WORDS), " ")


def _bound(x: Column, f) -> Column:
    """f(x) with x made once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _is_legal(token: Column) -> Column:
    """An abbreviation counts only when written as one: in capitals or with dots, without an apostrophe."""
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    written = token.contains(".") | ((letters != "") & (letters == F.upper(letters)))
    return _bound(name_key(token), lambda key: key.isin(LEGAL_WORDS) | (key.isin(LEGAL_ABBREVIATIONS) & ~token.rlike("['’]") & written))


def strip_legal(name: Column) -> Column:
    """A name without legal grades at both ends; null if nothing changes or fewer than three letters are left."""
    tokens = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    flagged = F.transform(tokens, lambda w: F.struct(w.alias("w"), _is_legal(w).alias("legal")))
    # the number of legal words before the first other one
    legal = lambda words: F.aggregate(words, F.lit(0), lambda a, x: F.when((a >= 0) & x["legal"], a + 1).otherwise(F.when(a >= 0, -a - 1).otherwise(a)), lambda a: F.when(a < 0, -a - 1).otherwise(a))

    def plain(kept: Column, lead: Column) -> Column:
        rest = F.array_join(F.transform(F.slice(kept, lead + 1, F.greatest(F.size(kept), F.lit(1))), lambda x: x["w"]), " ")
        out = F.regexp_replace(rest, r"^[\s,-]+|[\s,-]+$", "")
        return _bound(out, lambda o: F.when((F.length(name_key(o)) >= 3) & (o != name), o))

    def both(words: Column) -> Column:
        # the first word always stays for the strip at the end, the last for that at the start
        n = F.size(words)
        kept = F.slice(words, 1, F.greatest(n - legal(F.reverse(words)), F.lit(1)))
        lead = lambda k: F.least(legal(k), F.size(k) - 1)
        return _bound(kept, lambda k: _bound(lead(k), lambda i: F.when((n > 0) & (F.size(k) - i < n), plain(k, i))))

    return _bound(flagged, both)


def trigrams(text: Column, keyed: bool = False) -> Column:
    """Distinct trigrams of each word of the key, with two blanks before it and one after; `keyed` if the text is a key already."""
    padded = F.transform(words(text if keyed else name_key(text)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(x: Column, y: Column) -> Column:
    """Common over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Common trigrams over all trigrams of both; 0 if either has none."""
    return set_similarity(trigrams(a), trigrams(b))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-phrase containment between blanks; an empty text or phrase is contained in nothing."""
    hit = F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0
    return F.coalesce((text != "") & (phrase != "") & hit, F.lit(False))


def contains_either(a: Column, b: Column, least: int = 5) -> Column:
    """Equal, or one contains the other whole and the shorter one has `least` characters."""
    long_enough = F.least(F.length(a), F.length(b)) >= least
    return F.coalesce((a != "") & (b != "") & ((a == b) | (long_enough & (has_phrase(a, b) | has_phrase(b, a)))), F.lit(False))


def query_tokens(query: Column, most: int = 12) -> Column:
    """Lower-case words of letters and digits, the first `most`; the last one is a prefix. Null if there is none."""
    found = F.slice(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: t != ""), 1, most)
    return F.when(F.size(found) > 0, found)


def query_text(query: Column) -> Column:
    """The tokens joined by ' & ', the last one marked ':*'."""
    return F.concat(F.array_join(query_tokens(query), " & "), F.lit(":*"))


def prefix_match(tokens: Column, query: list[str]) -> Column:
    """Every query token occurs; the last one may be a prefix."""
    *whole, last = query
    hit = F.exists(tokens, lambda t: t.startswith(last))
    for w in whole:
        hit = hit & F.array_contains(tokens, w)
    return hit


def telemetry_query(query: Column) -> Column:
    """Lower case, trimmed, blanks squeezed, at most 100 characters; null under two."""
    q = F.substr(F.regexp_replace(F.regexp_replace(F.lower(query), r"^\s+|\s+$", ""), r"\s+", " "), F.lit(1), F.lit(100))
    return F.when(F.length(q) >= 2, q)


def route(url: Column) -> Column:
    """A path without its query; numbers at the start of a segment are ':id'."""
    return F.regexp_replace(F.substring_index(url, "?", 1), r"/\d+", "/:id")


def natural_digits(text: Column) -> Column:
    """Track order: all digits of a position as one number, null without any."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")


def natural_first(text: Column) -> Column:
    """Credit order: the first run of digits as a number, null without any."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1)
