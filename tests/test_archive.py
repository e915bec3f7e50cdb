"""Tar members of many archives and kinds, and sheets of workbooks."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql.types import StructType

from quarry.sources import archive
from quarry.sources.io import read_members


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "tar.bz2"])
def test_tar(spark, tmp_path, kind):
    rows = [f"{i}\tname é {i}\t{i / 2 if i % 3 else chr(92) + 'N'}" for i in range(5000)]
    for k in range(2):
        with tarfile.open(tmp_path / f"a{k}.{kind}", f"w:{kind.partition('.')[2]}") as tar:
            for name, text in (("dump/other", "x\ty\n"), ("dump/things", "\n".join(rows) + "\n"), ("things", f"{-k}\tlast\t\n")):
                data = text.encode()
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (tmp_path / "note.txt").write_text("no archive")
    schema = StructType.fromDDL("id long, name string, half double")
    got = sorted(map(tuple, archive.read_tar(spark, str(tmp_path), "things", schema).collect()), key=str)
    want = [(i, f"name é {i}", i / 2 if i % 3 else None) for i in range(5000)] * 2 + [(0, "last", None), (-1, "last", None)]
    assert got == sorted(want, key=str)
    one = str(tmp_path / f"a0.{kind}")
    assert sorted(map(tuple, archive.read_tar(spark, one, "things", schema).collect()), key=str) == sorted(map(tuple, read_members(spark, one, "things", schema).collect()), key=str)
    with pytest.raises(Exception, match="missing"):
        archive.read_tar(spark, str(tmp_path / "missing"), "things", schema).collect()


SHEET = """<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row>
<row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c><c r="AB2"><f>A2*2</f><v>14</v></c></row>
<row r="4"><c r="B4" t="inlineStr"><is><r><t>two </t></r><r><t>runs</t></r></is></c><c r="AB4" t="str"><v>x</v></c></row>
<row r="5"><c r="A5"/></row>
</sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t xml:space="preserve"> name</t></si><si><r><t>Ch&#226;teau</t></r><r><t> &amp; fils</t></r></si></sst>"""


def test_xlsx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", STRINGS)
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>')
    at = str(tmp_path / "book.xlsx")
    got = archive.read_xlsx(spark, at, StructType.fromDDL("id long, name string, far double, absent string")).collect()
    assert [tuple(r) for r in got] == [(7, "Château & fils", 14.0, None), (None, "two runs", None, None)]
    assert archive.read_xlsx(spark, at, StructType.fromDDL("id long"), sheet=2).collect() == []
