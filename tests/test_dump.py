"""Dumps to tables, and the parsers they use."""

import gzip
import io as io_module
import re
import tarfile
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lineage, search
from quarry.sources import dump, io

RELEASE = """<releases><release id="7"><artists><artist><id>1</id><name>Ann &amp; Bo</name></artist><artist><name>nobody</name></artist></artists>
<title>Läufe</title><labels><label id="3" name="Sub" catno="S1"/></labels><extraartists><artist><id>2</id><name>Cy</name><role>Mixed By</role></artist></extraartists>
<formats><format name="Vinyl" qty="2" text=""><descriptions><description>LP</description></descriptions></format><format name="" qty="x"/></formats>
<genres><genre>Electronic</genre><genre>Electronic</genre></genres><released>1999-03-00</released><notes>one
two</notes><master_id is_main_release="true">9</master_id>
<tracklist><track><position>B2</position><title>x</title><duration>3:45</duration><extraartists><artist><id>4</id><name>Di</name><role>Remix</role></artist></extraartists></track><track><position>Bonus</position><title>y</title></track></tracklist>
<identifiers><identifier type="Barcode" value="1"/><identifier type="Barcode" value="1"/><identifier type="Other"/></identifiers>
<companies><company><id>8</id><name>Plant</name><entity_type>4</entity_type><entity_type_name>Pressed By</entity_type_name></company><company><id>8</id><name>Plant again</name><entity_type>4</entity_type></company><company><name>none</name></company></companies>
<videos><video src="http://v" duration="61"><title>clip</title></video><video duration="2"/></videos></release><release><title>no id</title></release></releases>"""
LABEL = """<labels><label><id>3</id><name>Sub</name><sublabels><label id="5">Deep</label></sublabels><parentLabel id="1">Top</parentLabel><urls><url>http://a.example</url><url> </url></urls></label><label><id>4</id><name/></label></labels>"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_release(spark, tmp_path):
    path = tmp_path / "r_20240101.xml.gz"
    path.write_bytes(gzip.compress(RELEASE.encode()))
    t = dump.releases(dump.read_dump(spark, str(path), "release"))
    assert rows(t["releases"], "id", "title", "year", "month", "day", "master_id", "is_main_release", "notes") == [(7, "Läufe", 1999, 3, None, 9, True, "one\ntwo")]
    assert rows(t["release_artists"], "position", "artist_id", "name") == [(0, 1, "Ann & Bo")]
    assert rows(t["release_credits"], "artist_id", "role") == [(2, "Mixed By")]
    assert rows(t["release_formats"], "position", "name", "qty", "text", "descriptions") == [(0, "Vinyl", 2, None, ["LP"]), (1, "Unknown", None, None, None)]
    assert rows(t["release_genres"], "genre") == [("Electronic",)]
    assert rows(t["tracks"], "seq", "position", "disc", "track", "duration") == [(0, "B2", 1, "B2", 225), (1, "Bonus", 1, "Bonus", None)]
    assert rows(t["track_credits"], "seq", "artist_id", "role") == [(0, 4, "Remix")]
    assert rows(t["release_identifiers"], "type", "value") == [("Barcode", "1")]
    assert rows(t["release_companies"], "company_id", "name", "entity_type_name") == [(8, "Plant", "Pressed By")]
    assert rows(t["release_videos"], "position", "src", "title", "duration") == [(0, "http://v", "clip", 61)]
    assert tuple(dump.skipped(spark, str(path), "release").first()) == (1, 1)


def test_label(spark, tmp_path):
    path = tmp_path / "l.xml"
    path.write_text(LABEL)
    t = dump.labels(dump.read_dump(spark, str(path), "label"))
    assert rows(t["labels"], "id", "name", "parent_id") == [(3, "Sub", 1), (4, "[Unknown Label 4]", None)]
    assert rows(t["label_urls"], "label_id", "url") == [(3, "http://a.example")]


ARTIST = """<artists><artist><id>1</id><name>Ann</name><realname> </realname><data_quality>Correct</data_quality><urls><url>http://a</url><url/></urls><namevariations><name>An</name></namevariations>
<aliases><name id="2">Bo</name></aliases><groups><name id="3">Trio</name></groups><members><name id="4">Cy</name></members></artist><artist><id>5</id><name/></artist></artists>"""
MASTER = """<masters><master id="9"><main_release>7</main_release><artists><artist><name>nobody</name></artist><artist><id>1</id><name>Ann</name><join>,</join></artist></artists><genres><genre>Jazz</genre></genres><styles><style>Bop</style><style>Bop</style></styles>
<year>0</year><title>T</title><data_quality>Correct</data_quality><videos><video src="http://v" duration="5"><title>c</title></video><video duration="1"/></videos></master></masters>"""


def test_artist(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(ARTIST)
    t = dump.artists(dump.read_dump(spark, str(path), "artist"))
    assert rows(t["artists"], "id", "name", "realname", "data_quality") == [(1, "Ann", None, "Correct"), (5, "[Unknown Artist 5]", None, "Needs Vote")]
    assert rows(t["artist_urls"], "artist_id", "url") == [(1, "http://a")] and rows(t["artist_name_variations"], "name") == [("An",)]
    assert rows(t["artist_aliases"], "alias_id", "alias_name") == [(2, "Bo")]
    assert rows(t["artist_groups"], "group_id") == [(3,)] and rows(t["artist_members"], "member_id") == [(4,)]


def test_master(spark, tmp_path):
    path = tmp_path / "m.xml"
    path.write_text(MASTER)
    t = dump.masters(dump.read_dump(spark, str(path), "master"))
    assert rows(t["masters"], "id", "title", "year", "main_release") == [(9, "T", None, 7)]
    assert rows(t["master_artists"], "position", "artist_id", "join") == [(1, 1, ",")]
    assert rows(t["master_styles"], "style") == [("Bop",)] and rows(t["master_videos"], "position", "src") == [(0, "http://v")]


def test_name_key_is_the_decomposition(spark):
    """Against unicodedata on every letter of the first planes' Latin, Greek, compatibility and full-width blocks."""
    letters = [chr(i) for i in [*range(0x20, 0x250), *range(0x1D00, 0x2200), *range(0x2460, 0x2500), *range(0x3200, 0x3400), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFF0)] if chr(i).isprintable()]
    texts = [f"a{c}b {c}" for c in letters]

    def key(s):
        t = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", s)).replace("ß", "ss")
        return re.sub("[^a-z0-9]+", " ", re.sub("[’'`´]", "", t).lower()).strip()

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.name_key(F.col("t")).alias("k")).collect()
    assert [(texts[r["i"]], r["k"]) for r in got if r["k"] != key(texts[r["i"]])] == []


@pytest.mark.parametrize("q,filters,fine", [("ab", {}, True), ("a", {}, False), ("x" * 201, {}, False), (None, {}, False), (None, {"year": 1999}, True), (None, {"yearMax": 1999}, False), ("", {"country": "US"}, True)])
def test_search_validation(q, filters, fine):
    assert (search.validate(q, **filters) is None) == fine


def test_cursors():
    assert search.decode_cursor(search.encode_cursor(7, 1.5)) == (7, 1.5)
    assert search.decode_cursor("!!") is None and search.decode_cursor(search.base64.urlsafe_b64encode(b'{"id": "x"}').decode()) is None


def test_cover_density(spark):
    def rank(n, hits):
        rows = [{"pos": p, "weight": w, "i": [i]} for i, p, w in hits]
        df = spark.createDataFrame([(rows, n)], "h array<struct<pos:int,weight:double,i:array<int>>>, n int")
        return df.select(search.cover_density(F.col("h"), F.col("n"))).first()[0]

    assert rank(2, [(0, 1, 1.0), (1, 2, 1.0)]) == 1.0
    assert rank(2, [(0, 1, 1.0), (1, 4, 1.0)]) == pytest.approx(1 / 3)
    assert rank(2, [(0, 1, 1.0)]) == 0.0
    assert rank(1, [(0, 1, 0.1), (0, 5, 0.1)]) == pytest.approx(0.2)


def test_staged_phases(spark, tmp_path):
    made = []

    def phase(name, f):
        def build(**before):
            made.append(name)
            return f(**before)

        return name, build

    phases = [phase("a", lambda: spark.range(3)), phase("b", lambda a: a.filter("id > 0"))]
    assert lineage.staged(spark, str(tmp_path / "w"), phases)["b"].count() == 2 and made == ["a", "b"]
    lineage.staged(spark, str(tmp_path / "w"), phases)
    assert made == ["a", "b"]
    lineage.staged(spark, str(tmp_path / "w"), phases, redo_from="b")
    assert made == ["a", "b", "b"]
    assert lineage.markdown(spark.range(1)) == "| id |\n|---|\n| 0 |"


def test_more_sources(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id int, name string")
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as tar:
        for name, body in (("dump/area", b"1\tA\n2\t\\N\n"), ("dump/other", b"9\tZ\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io_module.BytesIO(body))
    assert rows(io.read_members(spark, str(tmp_path / "x.tar.bz2"), "area", schema), "id", "name")[0] == (1, "A")
    (tmp_path / "t.tsv").write_text("1\tA\n2\t\\N\n")
    assert {tuple(r) for r in io.read_tsv(spark, str(tmp_path / "t.tsv"), schema).collect()} == {(1, "A"), (2, None)}
    (tmp_path / "g.geojson").write_text('{"features": [{"properties": {"n": "x"}, "geometry": {"type": "Point"}}]}')
    assert rows(io.read_features(spark, str(tmp_path / "g.geojson"), "n string"), "n", "geometry_type") == [("x", "Point")]
    (tmp_path / "slug-1.json").write_text('{\n"id": 1, "name": "a"}')
    assert rows(io.read_json_files(spark, str(tmp_path / "slug-1.json"), schema), "id", "slug") == [(1, "slug-1")]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nbroken\n')
    assert rows(io.bad_lines(spark, str(tmp_path / "b.jsonl"), schema), "value") == [("broken",)]
    (tmp_path / "r.log").write_text('{"req": {"method": "GET", "url": "/a/5?x"}, "res": {"statusCode": 200}, "responseTime": 12.4}\nnoise\n')
    assert rows(io.read_log(spark, str(tmp_path / "r.log")), "method", "route", "status", "ms") == [("GET", "/a/:id", 200, 12)]
    assert rows(io.resume(spark.range(5), spark.range(3), "id"), "id") == [(3,), (4,)] and io.resume(spark.range(2), spark.range(0), "id").count() == 2
    batches = spark.createDataFrame([("a", "active", 1), ("b", "active", 2), ("c", "failed", 3)], "id string, status string, created int")
    assert io.newest_batch(batches, spark.createDataFrame([("a", 1), ("c", 1)], "batch_id string, x int")).first()[0] == "a"
    assert rows(spark.createDataFrame([("x_20240131_y.xml",)], "n string").select(io.dump_date(F.col("n")).cast("string").alias("d")), "d") == [("2024-01-31",)]
    lineage.export_csv(spark.createDataFrame([('a "q"', None)], "x string, y string"), str(tmp_path / "out"))
    assert rows(io.read_csv(spark, str(tmp_path / "out")), "x", "y") == [('a "q"', "")]
    (tmp_path / "doc.txt").write_text("whole\ntext")
    assert rows(io.read_texts(spark, str(tmp_path / "doc.txt")), "slug", "text") == [("doc", "whole\ntext")]


def test_merge_cycle(spark):
    from quarry.operators.relational import merge_targets

    chain = spark.createDataFrame([(i, i - 1, 1) for i in range(1, 40)] + [(5, 100, 0)], "merge_id long, keep_id long, weight int")
    assert {r["final_id"] for r in merge_targets(chain).collect()} == {0}
    for rows_, members in (([(1, 2, 1), (2, 1, 1)], "1, 2"), ([(7, 5, 1), (5, 6, 1), (6, 4, 1), (4, 5, 1), (8, 9, 1), (10, 7, 2)], "4, 5, 6")):
        began = time.time()
        with pytest.raises(ValueError, match=f"cycle through {members}$"):
            merge_targets(spark.createDataFrame(rows_, "merge_id long, keep_id long, weight int"))
        assert time.time() - began < 30


def test_merge_order(spark):
    """Levels count the steps to the last keep; from the highest down, no row is merged away before it is used."""
    from quarry.operators.relational import merge_order

    edges = [(3, 2, 1), (2, 1, 1), (9, 2, 1), (5, 4, 1), (5, 1, 3), (6, 6, 1), (8, 7, 2), (8, 3, 2)]
    got = {r["merge_id"]: (r["keep_id"], r["final_id"], r["level"]) for r in merge_order(spark.createDataFrame(edges, "merge_id long, keep_id long, weight int")).collect()}
    assert got == {2: (1, 1, 1), 3: (2, 1, 2), 9: (2, 1, 2), 5: (1, 1, 1), 8: (3, 1, 3)}
    assert merge_order(spark.createDataFrame([], "merge_id long, keep_id long, weight int")).collect() == []


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"1\n2",\n')
    assert rows(io.read_csv(spark, str(tmp_path / "a.csv")), "x", "y") == [("1\n2", "")]
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n')
    from pyspark.sql.types import StructType

    assert rows(io.read_jsonl(spark, str(tmp_path / "a.jsonl"), StructType.fromDDL("x int")), "x") == [(1,)]
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(io.append_new(spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string"), old, ["k"]), "k", "v") == [(2, "c")]
    out = str(tmp_path / "owned")
    io.replace_owned(spark.createDataFrame([("p", 1), ("q", 2)], "src string, n int"), out, "src")
    io.replace_owned(spark.createDataFrame([("q", 3)], "src string, n int"), out, "src")
    assert rows(spark.read.parquet(out), "src", "n") == [("p", 1), ("q", 3)]


def test_windowed(spark):
    from quarry.streaming.telemetry import windowed

    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a'")
    assert sorted(r["n"] for r in windowed(e).collect()) == [1, 2]
