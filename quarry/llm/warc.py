"""WARC: writer with revisit records, and a salvage reader.

An archive is a run of gzip members, one record each, in a blob of bounded size; blobs are rows (archive, content), as the
binaryFile source gives for files. The reader checks each member, header, length and digest. After a failed check it looks
for the next gzip member or version line that holds a valid record, goes on there, and logs the bytes between as a gap.

Defined results: null html is an empty payload; null url is left out; of repeated rows with the smallest id all are
responses; urls and headers may be of any length; an empty table gives no archive; bytes that hold no record are one gap;
other columns of the pages are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bounded, table

VERSION, MEMBER, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
FIELDS = "archive string, at long, size long, kind string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
BLOB = 4 << 20
#: Payloads of fewer bytes never become revisits.
LEAST = 100


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", "", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def with_refers(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, refers_to (null: a response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    big = p.filter(F.octet_length("payload") >= LEAST).select("page_id", "digest")
    many = table(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-first")
    # only ids and digests meet here; the payloads stay where they are, or travel by page, however many copies one has
    revisits = big.join(bounded(many, many.count()), "digest").filter("first < page_id").distinct()
    revisits = table(revisits, "warc-revisits")
    return p.join(bounded(revisits, revisits.count()), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def archives(pages: DataFrame) -> DataFrame:
    """One row per archive: archive, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            for p, u, body, d, r in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True):
                parts.append(gzip.compress(record(int(p), u, bytes(body), d, None if pd.isna(r) else int(r)), 3, mtime=0))
                size += len(parts[-1])
                if size >= BLOB:
                    yield pd.DataFrame({"archive": [f"{uuid.uuid4().hex}.warc.gz"], "content": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"archive": [f"{uuid.uuid4().hex}.warc.gz"], "content": [b"".join(parts)]})

    return with_refers(pages).mapInPandas(run, "archive string, content binary")


def inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The gzip member at a position and where it ends; None if its data or its check fails."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos : pos + 65536]))
            pos = min(len(data), pos + 65536)
    except zlib.error:
        return None
    return (b"".join(out), pos - len(d.unused_data)) if d.eof else None


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and end of the record at a position; None if any check fails."""
    stop = data.find(END, at) if data.startswith(VERSION, at) else -1
    if stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    n = fields.get("content-length", "")
    if not n.isdigit():
        return None
    first = stop + 4
    block = data[first : first + int(n)]
    if len(block) != int(n) or data[first + int(n) : first + int(n) + 4] != END:
        return None
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        return None
    return fields, block, first + int(n) + 4


def salvage(content: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record' or 'gap', position, size, fields, block), covering every byte of the archive once."""
    data, at, gap = memoryview(content), 0, None
    while at < len(content):
        got, end = None, at
        if content[at : at + 3] == MEMBER:
            if member := inflate(data, at):
                got, end = parse(member[0], 0), member[1]
                if got and got[2] != len(member[0]):
                    got = None
        elif content[at : at + 7] == VERSION and (got := parse(content, at)):
            end = got[2]
        if got:
            if gap is not None:
                yield "gap", gap, at - gap, {}, b""
                gap = None
            yield "record", at, end - at, got[0], got[1]
            at = end
        else:
            gap = at if gap is None else gap
            following = START.search(content, at + 1)
            at = following.start() if following else len(content)
    if gap is not None:
        yield "gap", gap, len(content) - gap, {}, b""


def records(blobs: DataFrame, payloads: bool = True) -> DataFrame:
    """blobs(archive, content) -> a row per record or gap; the payload itself only if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            for name, content in zip(b["archive"], b["content"], strict=True):
                rows = []
                for kind, at, size, f, block in salvage(bytes(content)):
                    head, _, body = block.partition(END)
                    n, digest = len(body), hashlib.sha256(body).hexdigest()
                    if f.get("warc-type") == "revisit":
                        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                        n, digest = int(m[1]) if m else None, f.get("warc-payload-digest", "").removeprefix("sha256:")
                    if kind == "gap":
                        n = digest = None
                    rows.append((name, at, size, kind, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), n, digest, body if payloads and kind == "record" else None))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    return blobs.select("archive", "content").mapInPandas(run, FIELDS)


def quarantine(read: DataFrame) -> DataFrame:
    """The gap log of records(): archive, at, size of each run of bytes that held no valid record."""
    return read.filter("kind = 'gap'").select("archive", "at", "size")
