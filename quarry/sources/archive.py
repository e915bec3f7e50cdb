"""Archives as sources: tar members streamed by a Python data source, and spreadsheets, which are zips of XML."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class TarMembers(DataSource):
    """Format `tar_members`: the lines of the members of tar archives (plain, gz, bz2 or xz) whose file name is option `member`.

    Option `path` is a file or a folder of any file system that Arrow opens; each archive is one partition and is streamed
    from beginning to end, so that memory stays flat whatever its size. Columns: archive, line number within it, value.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, n long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TarReader(self.options["path"], self.options["member"])


class _TarReader(DataSourceReader):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
        names = sorted(x.path for x in found if x.is_file and re.search(r"\.(tar|tgz|tbz2?|txz)(\.\w+)?$", x.path))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            n = 0
            for info in tar:
                if info.isfile() and info.name.rpartition("/")[2] == self.member:
                    for line in tar.extractfile(info):
                        yield partition.value, n, line.decode("utf-8").rstrip("\r\n")
                        n += 1


def read_tar(spark: SparkSession, path: str, member: str, schema: StructType) -> DataFrame:
    r"""The tab-separated rows of the named members, \N for null: as read_members, for archives of any size."""
    spark.dataSource.register(TarMembers)
    uri = path if "://" in path else f"file://{path}"
    lines = spark.read.format("tar_members").option("member", member).load(uri)
    cells = F.transform(F.split("value", "\t", -1), lambda x: F.when(x != "\\N", x))
    row = lines.select(cells.alias("c"))
    return row.select(*[F.get("c", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(cell: str) -> int:
    """B7 -> 1."""
    n = 0
    for c in cell.rstrip("0123456789"):
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and cells (texts; None where there is none) of a workbook's sheet, from 1; formulas give their last value."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text(e) for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")) if e.tag == f"{_MAIN}si"]
        for _, row in ElementTree.iterparse(book.open(f"xl/worksheets/sheet{sheet}.xml")):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[at] = text(c)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            yield int(row.get("r") or 0), cells
            row.clear()


def read_xlsx(spark: SparkSession, path: str, schema: StructType, sheet: int = 1) -> DataFrame:
    """A sheet's rows below its header, by the header's names; cells that don't fit their type are null, blank rows go."""
    names = [f.name for f in schema.fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                head, out = None, []
                for _, cells in sheet_rows(content, sheet):
                    if head is None:
                        head = {(c or "").strip(): i for i, c in enumerate(cells)}
                    elif any(c is not None for c in cells):
                        out.append([cells[i] if (i := head.get(n)) is not None and i < len(cells) else None for n in names])
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
                yield pd.DataFrame(out, columns=names, dtype=object)

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))
    return texts.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
