"""Change sets and tables with owners: rows that a run no longer has go, an empty or broken run changes nothing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources import io, owned

DDL = "k long, part string, n long, tags array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_changes(spark):
    old = frame(spark, [(1, "a", 1, ["x"]), (2, "a", 2, None), (3, None, 3, []), (4, "a", None, ["y"]), (None, "a", 1, None)])
    new = frame(spark, [(1, "a", 1, ["x"]), (2, "a", None, None), (3, None, 3, None), (5, "a", 5, []), (None, "a", 1, None)])
    got = {(r["k"], r["part"]): r["change"] for r in owned.changes(old, new, ["k", "part"]).collect()}
    assert got == {(1, "a"): "unchanged", (2, "a"): "update", (3, None): "update", (4, "a"): "delete", (5, "a"): "insert", (None, "a"): "unchanged"}


def test_owners(spark, tmp_path):
    at = str(tmp_path / "table")
    rows = lambda: sorted((r["owner"], r["k"], r["n"]) for r in owned.read_owned(spark, at).collect())
    with pytest.raises(Exception):
        rows()
    assert owned.replace_owner(frame(spark, [(1, "a", 1, []), (2, "a", 2, [])]), at, "x", ["k"]) == {"insert": 2}
    assert owned.replace_owner(frame(spark, [(1, "a", 7, [])]), at, "y", ["k"]) == {"insert": 1}
    assert owned.replace_owner(frame(spark, [(2, "a", 2, []), (3, "a", 3, [])]), at, "x", ["k"]) == {"unchanged": 1, "insert": 1, "delete": 1}
    want = [("x", 2, 2), ("x", 3, 3), ("y", 1, 7)]
    assert rows() == want
    with pytest.raises(ValueError, match="empty run"):
        owned.replace_owner(frame(spark, []), at, "x", ["k"])
    with pytest.raises(ValueError, match="repeat a key"):
        owned.replace_owner(frame(spark, [(1, "a", 1, []), (1, "b", 1, [])]), at, "x", ["k"])
    broken = frame(spark, [(9, "a", 9, [])]).withColumn("n", F.raise_error(F.lit("broken source")).cast("long"))
    with pytest.raises(Exception, match="broken source"):
        owned.replace_owner(broken, at, "x", ["k"])
    assert rows() == want


def test_bad_lines(spark, tmp_path):
    """Exactly the lines that read_jsonl drops, by the same parse."""
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": "x"}\n[1]\nnope\n\n{"id": 4.5}\n{}\nnull\n')
    schema = StructType.fromDDL("id long")
    assert sorted(str(r["id"]) for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == ["1", "None"]
    assert sorted(r["value"] for r in io.bad_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()) == sorted(['{"id": "x"}', "[1]", "nope", '{"id": 4.5}', "null"])
