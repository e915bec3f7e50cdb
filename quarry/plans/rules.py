"""Queries of the scalar rules: every row of a table gets one of a rule's cases by its key; the oracle holds what the rule must say.

The expected values are written by hand from the rules, not taken from the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import classify as C, links as L, text as T
from ..sources.io import read_table as t
from .catalog import ORACLES, QUERIES


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def rule(name: str, f: Callable[..., Column], kind: str, cases: list[tuple]) -> None:
    """cases: (inputs, expected); kind: the SQL type of the result. The table is customer, the key c_custkey."""
    pairs = [(a if isinstance(a, tuple) else (a,), b) for a, b in cases]
    width = len(pairs[0][0])

    def query(s, d):
        at = F.pmod("c_custkey", F.lit(len(pairs)))
        ins = []
        for j in range(width):
            column = F.lit(None)
            for i, (inputs, _) in enumerate(pairs):
                column = F.when(at == i, F.lit(inputs[j])).otherwise(column)
            ins.append(column)
        rows = t(s, d, "customer").select("c_custkey", *[c.alias(f"in{j}") for j, c in enumerate(ins)])
        return rows.select("c_custkey", f(*[F.col(f"in{j}") for j in range(width)]).alias("said"))

    values = ", ".join(f"({i}, CAST({_literal(b)} AS {kind}))" for i, (_, b) in enumerate(pairs))
    QUERIES[name] = query
    ORACLES[name] = f"SELECT c_custkey, said FROM customer JOIN (VALUES {values}) v(i, said) ON c_custkey % {len(pairs)} = i"


rule("fn_name_key", T.name_key, "VARCHAR", [
    ("Château Léoville-Las Cases", "chateau leoville las cases"), ("Moscato d'Asti", "moscato dasti"), ("Weißburgunder", "weissburgunder"),
    ("Škoda Łódź", "skoda odz"), ("ﬁne ½ Ｗｉｎｅ", "fine 1 2 wine"), (None, ""), ("  !!  ", ""), ("Côte d’Or №5", "cote dor no5"), ("ẚ x", "a x"), ("Αθήνα 7", "7"),
])
rule("fn_loose_key", T.loose_key, "VARCHAR", [("Sjælland", "sjaelland"), ("Øster Å", "oster a"), ("Łódź", "lodz"), ("Þing đ", "thing d"), (None, "")])
rule("fn_missing", T.missing, "VARCHAR", [(" x ", "x"), ("NA", None), ("na", None), ("null", None), ("", None), (None, None), ("Na", "Na")])
rule("fn_query_tokens", T.query_text, "VARCHAR", [
    ("aphex tw", "aphex & tw:*"), ("!!!", None), (" ".join(f"t{i}" for i in range(40)), " & ".join(f"t{i}" for i in range(12)) + ":*"), ("Björk's", "björk & s:*"), ("X", "x:*"),
])
rule("fn_strip_title", T.strip_title, "VARCHAR", [("Château Margaux", "margaux"), ("Azienda Agricola Rossi S.r.l.", "rossi"), ("Domaine", ""), ("Smith and Co Estate", "smith"), (None, "")])
rule("fn_core_name", T.core_name, "VARCHAR", [("domaine de la tour neuve", "tour neuve"), ("petit ours et fils", "petit ours"), ("wines of the", "the"), ("", "")])
rule("fn_last_core_word", T.last_core_word, "VARCHAR", [("marie lune", "lune"), ("ours et petite lune", "lune"), ("domaine de la", None), ("", None)])
rule("fn_contains_either", T.contains_either, "BOOLEAN", [
    (("chateau margaux rouge", "margaux"), True), (("chateau margaux", "arg"), False), (("e", "e"), True), (("e", "chateau e"), False), (("", "x"), False), ((None, "x"), False), (("barolo", "barolo riserva"), True),
])
rule("fn_similarity", lambda a, b: F.round(T.similarity(a, b), 4), "DOUBLE", [(("chateau margaux", "margaux"), 0.5), (("le demi sec", "demi sec"), 0.75), (("", ""), 0.0), (("!!", "a"), 0.0), (("same", "Same"), 1.0)])
rule("fn_strip_type", T.strip_type, "VARCHAR", [("etna rosso", "etna"), ("rosso di montalcino", "rosso di montalcino"), ("rosso", "rosso"), ("kremstal reserve", "kremstal"), ("asti spumante dolce", "asti"), ("rosso bianco", "rosso")])
rule("fn_strip_colour", T.strip_colour, "VARCHAR", [("weisser riesling", "riesling"), ("pinot noir", "pinot"), ("blanc", ""), ("merlot", "merlot")])
rule("fn_strip_legal", T.strip_legal, "VARCHAR", [("Chianti DOCG", "Chianti"), ("Pays d'Oc", None), ("AOC Cahors", "Cahors"), ("Wachau g.U.", "Wachau"), ("DOC", None), ("docg Soave DOC", "docg Soave"), ("Barolo", None)])
rule("fn_slug", T.slug, "VARCHAR", [("Côtes de Bourg", "cotes-de-bourg"), ("  L'Étoile! ", "letoile"), ("Straße", "stra-e"), (None, "")])
rule("fn_find_slug", lambda a, b: T.find_slug(a, b.cast("int")), "VARCHAR", [(("Château Latour", 2001), "chateau+latour+2001"), (("Krug!", None), "krug"), (("d'Yquem", 0), "d+yquem")])
rule("fn_title_case", T.title_case, "VARCHAR", [("CABERNET FRANC", "Cabernet Franc"), ("MÜLLER-THURGAU (WEISS)", "Müller-Thurgau (Weiss)"), ("nero d'avola", "Nero D'Avola"), ("éclair/ÉTÉ", "Éclair/Été"), ("  x", "  X")])
rule("fn_telemetry_query", T.telemetry_query, "VARCHAR", [("  Aphex   Twin ", "aphex twin"), ("a", None), ("x" * 120, "x" * 100), (None, None)])
rule("fn_route", T.route, "VARCHAR", [("/v1/artists/45/masters?limit=3", "/v1/artists/:id/masters"), ("/v1/search", "/v1/search"), ("/a/12/b/7", "/a/:id/b/:id")])
rule("fn_natural_digits", T.natural_digits, "INTEGER", [("1-3", 13), ("A2", 2), ("Bonus", None), ("99999999999", None)])
rule("fn_natural_first", T.natural_first, "INTEGER", [("1-3", 1), ("A2", 2), ("Bonus", None), ("B10b", 10)])
rule("role_normalise", C.role_bucket, "VARCHAR", [
    ("Edited By", "Other"), ("Re-Edit", "Edit"), ("Dub", "Dub"), ("Remix", "Remix"), ("Co-produced By", "Additional Production"), ("Associate Producer", "Additional Production"), ("Producer", "Producer"), ("Executive-Producer", "Other"),
    ("Mastered By", "Mastered By"), ("Mixed By", "Mixed By"), ("Recorded By", "Engineer"), ("Programmed By", "Engineer"), ("Written-By", "Other"), ("Written By", "Written By"), ("Featuring", "Vocals"), ("", "Other"), (None, "Other"), ("Cello", "Other"),
])
rule("fn_work_family", C.work_family, "VARCHAR", [("Written-By", "writing"), ("Conductor", "arranging"), ("Bass", "performance"), ("Remix", "production"), ("Design", "other"), (None, "other")])
rule("fn_credit_family", C.credit_family, "VARCHAR", [("Remix", "remix"), ("Producer", "produce"), ("Recorded By", "engineer"), ("Mixed By", "mix"), ("Mastered By", "master"), ("Lyrics By", "write"), ("Backing Vocals", "vocal"), ("Mix, Rework", "remix"), ("Art", "other")])
_ALIASED = {"remix": "Dub,Edit,Remix", "produce": "Additional Production,Producer", "Vocals": "Vocals", "mix": "Mixed By"}
rule("fn_role_alias", lambda c: F.when(c == "remix", ",".join(sorted(C.expand_role("Remix")))).when(c == "produce", ",".join(sorted(C.expand_role("produce")))).when(c == "Vocals", ",".join(C.expand_role("Vocals"))).otherwise(",".join(C.expand_role("mix"))), "VARCHAR", list(_ALIASED.items()))
_type = lambda f, title, n, a: (lambda r: F.concat_ws("/", r["kind"], r["label"]))(C.release_type(F.split(f, ";"), title, n.cast("int"), a))
rule("release_type", _type, "VARCHAR", [
    (("Vinyl 1", "X", 4, "A"), 'single_ep/12"'), (("Vinyl 1", "X", 9, "A"), "album/LP"), (("Vinyl 2", "X", 4, "A"), "album/LP"), (("CD 1", "X", 7, "A"), "album/LP"), (("CD 1", "X", 4, "A"), "single_ep/Single"),
    (("CD 1", "X", 5, "A"), "other/Other"), (("CD 1", "X", None, "A"), "album/LP"), (("File", "Best Of X", 3, "A"), "compilation/Comp"), (("File", "X", 3, "Various"), "compilation/Comp"), (("File;Album", "X", 3, "A"), "album/LP"),
    (("File;Single", "X", 3, "A"), "single_ep/Single"), (("File;EP", "X", 3, "A"), 'single_ep/12"'), (("File", "X", 3, None), "other/Other"), (("Cassette", "The Best", 8, "A"), "compilation/Comp"),
])
_quality = lambda n, q, p, r, link: (lambda x: F.concat_ws("/", x["status"], x["reason"]))(C.quality(n, q, True, p, r, link.cast("boolean")))
rule("quality_rules", _quality, "VARCHAR", [
    (("", "Correct", "p", "r", True), "invalid/empty_name"), (("12345", "Correct", "p", "r", True), "low_value/numeric_name"), (("Some Name", "Entirely Incorrect", "p", "r", True), "suppressed/discogs_quality_entirely_incorrect"),
    (("Ann", "Needs Major Changes", "p", "r", True), "low_value/discogs_quality_needs_major_changes"), (("Artist 123456", "Needs Vote", "p", "r", True), "suppressed/artist_placeholder_name"), (("N/A", "Correct", "p", "r", True), "suppressed/artist_placeholder_name"),
    (("Random Name", "Needs Vote", "", "", False), "low_value/artist_unlinked_low_info"), (("Random Name", "Needs Vote", "", "", None), "active/default_active"), (("Aphex Twin", "Needs Vote", "UK", "R", True), "active/default_active"), (("Testament", "Correct", "", "", False), "active/default_active"),
])
_position = lambda c: (lambda r: F.concat_ws("|", F.coalesce(r["disc"].cast("string"), F.lit("-")), F.coalesce(r["track"], F.lit("-"))))(C.track_position(c))
rule("track_position", _position, "VARCHAR", [("1-3", "1|3"), ("A1", "1|A1"), ("B2", "1|B2"), ("A", "1|A"), ("3", "1|3"), ("1.1", "1|1.1"), ("Bonus", "1|Bonus"), ("", "-|-"), (None, "-|-"), ("0-2", "-|2"), ("10000-1", "-|1"), (" 2-11 ", "2|11"), ("1-2-3", "-|1-2-3"), ("#1", "-|#1")])
_date = lambda c: (lambda r: F.concat_ws("-", *[F.coalesce(r[p].cast("string"), F.lit("?")) for p in ("year", "month", "day")]))(C.partial_date(c))
rule("partial_date", _date, "VARCHAR", [("1999-03-00", "1999-3-?"), ("1995-03-14", "1995-3-14"), ("1995", "1995-?-?"), ("1995-00-00", "1995-?-?"), ("1987-5", "1987-?-?"), ("c. 1987?", "1987-?-?"), ("19875", "1987-?-?"), ("0000", "?-?-?"), ("1850 or so", "?-?-?"), ("", "?-?-?"), (None, "?-?-?"), ("1995-03", "1995-3-?")])
rule("duration_seconds", C.duration, "INTEGER", [("3:45", 225), ("1:02:30", 3750), ("", None), (None, None), ("45", None), ("3:45x", 225), ("a:1", None), ("1:2:3:4", None), ("99999999:00:00", None), ("-1:30", None)])
rule("fn_safe_int", C.safe_int, "INTEGER", [("12", 12), ("12abc", 12), ("x", None), ("", None), ("2147483648", None), ("-5", -5), (None, None)])
rule("fn_tri_bool", C.tri_bool, "BOOLEAN", [("true", True), ("TRUE", True), ("no", False), ("", None), (None, None)])
rule("fn_comma_number", C.comma_number, "DOUBLE", [("12,5", 12.5), ("3.25", 3.25), ("NA", None), ("x", None), (None, None)])
rule("fn_statement_time", C.statement_time, "VARCHAR", [(("+2020-01-02T00:00:00Z", 9), "2020"), (("+2020-01-02T00:00:00Z", 10), "2020-01"), (("+2020-01-02T00:00:00Z", 11), "2020-01-02"), (("x", 9), None)])
rule("fn_country_code", C.country_code, "VARCHAR", [("Frankrike", "FR"), ("SE", "SE"), ("Österrike", "AT"), ("Atlantis", None), ("NA", None), ("United States", "US"), ("eu", None)])
rule("fn_plausible_yield", lambda v, u: C.plausible_yield(v.cast("double"), u), "BOOLEAN", [((6635, "hl"), False), ((222, "hl"), True), ((15, "hl"), True), ((30000, "kg"), True), ((1499, "kg"), False)])
rule("fn_stated_colour", C.stated_colour, "VARCHAR", [("black berry skin|white", "white"), ("black berry skin", "unknown"), ("pink|white", "rose"), ("Noir", "red"), ("NA", "unknown"), (None, "unknown")])
rule("fn_grape_colour", lambda a, b: C.grape_colour(F.transform(F.split(a, ";"), C.catalog_colour), b), "VARCHAR", [(("BLANC;BLANC", "noir"), "white"), (("BLANC;NOIR", "noir"), "red"), (("?", "pink"), "rose"), (("ROUGE", ""), "rose")])
rule("fn_code_colour", C.code_colour, "VARCHAR", [("B", "white"), ("N", "red"), ("Rs", "rose"), ("X", None), (None, None)])
rule("fn_name_colour", C.name_colour, "VARCHAR", [("caino blanco", "white"), ("douce noir", "red"), ("merlot", None), ("blanc noir", "white")])
_link = lambda u: (lambda r: F.concat_ws(" ", r["provider"], r["url"], r["handle"], r["confidence"].cast("string")))(L.linkout(u))
rule("linkout_rules", lambda u: F.nullif(_link(u), F.lit("")), "VARCHAR", [
    ("https://warp.bandcamp.com/album/x", "bandcamp https://warp.bandcamp.com warp 1.0"), ("http://bandcamp.com/Warp", "bandcamp https://warp.bandcamp.com warp 1.0"), ("https://www.instagram.com/warprecords/", "instagram https://instagram.com/warprecords warprecords 0.98"),
    ("https://instagram.com/p/abc", None), ("https://example.com/warp", None), ("ftp://x.bandcamp.com", None), ("https://bandcamp.com/", None), ("https://notbandcamp.com/x", None), ("https://bandcamp.com", None), ("https://www.Bandcamp.com/Rush-Hour/", "bandcamp https://rush-hour.bandcamp.com rush-hour 1.0"), (None, None),
])
rule("video_id", L.video_id, "VARCHAR", [("https://www.youtube.com/watch?v=abcdefghijk", "abcdefghijk"), ("https://youtu.be/ABCDEFGHIJ_?t=3", "ABCDEFGHIJ_"), ("https://youtube.com/watch?x=1&v=12345678901", "12345678901"), ("https://www.youtube.com/embed/aaaaaaaaaaa", "aaaaaaaaaaa"), ("https://vimeo.com/1", None), ("https://youtu.be/short", None)])
rule("fn_file_url", lambda u: L.file_url(u, 300), "VARCHAR", [("http://commons.wikimedia.org/wiki/Special:FilePath/A.jpg", "https://commons.wikimedia.org/wiki/Special:FilePath/A.jpg?width=300"), ("https://x.org/a.jpg", "https://x.org/a.jpg"), ("https://commons.wikimedia.org/wiki/Special:FilePath/A.jpg?x=1", "https://commons.wikimedia.org/wiki/Special:FilePath/A.jpg?x=1&width=300"), ("", "")])
_refs = lambda p: F.array_join(F.transform(L.markup_refs(p), lambda r: F.concat_ws(":", r["kind"], r["id"].cast("string"), r["name"])), ",")
rule("markup_refs", _refs, "VARCHAR", [("See [a123] on [l45], [b]bold[/b] [a=Ann Bo]", "artist:123,label:45,artist:Ann Bo"), ("none", ""), ("[m=9] [r77]", "master:9,release:77")])
rule("fn_plain_profile", L.plain_profile, "VARCHAR", [("See [a=Ann] [b]now[/b]", "See Ann now"), ("x [a12] y", "x  y"), ("[url=http://x]site[/url]", "site")])
_cited = lambda a: F.array_join(L.cited_ids(a, "app.example.org"), ",")
rule("citation_bind", _cited, "VARCHAR", [("[X](https://app.example.org/master/12) and app.example.org/master/7, app.example.org/master/12", "12,7"), ("app.example.org/artist/3", ""), ("", "")])
rule("citation_unlink", lambda a: L.unlink(a, F.array(F.lit("master/12"), F.lit("artist/3")), "app.example.org"), "VARCHAR", [
    ("[X](https://app.example.org/master/12) [Y](https://app.example.org/master/9) z", "[X](https://app.example.org/master/12) Y z"), ("no links", "no links"), ("[A](http://app.example.org/artist/003/)", "[A](http://app.example.org/artist/003/)"), ("[A](http://other.org/artist/3)", "[A](http://other.org/artist/3)"),
])
