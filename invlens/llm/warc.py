"""WARC archives: one gzip member per record, written by Spark tasks and read back sequentially (operator 9).

Of records with equal payloads of at least ``least`` bytes, that with the
largest page_id is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.llm._store import arrow_map, commit_file, filesystem, new_path

LEAST = 1000
_DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|none)>", record_id)
    if not found:
        raise ValueError(f"not a page's record id: {record_id}")
    return None if found[1] == "none" else int(found[1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own. A revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def members(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member of a stream, decompressed piece by piece."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(step)
    begun = False
    while data:
        begun = True
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts, begun = z.unused_data, zlib.decompressobj(31), [], False
            data = data or stream.read(step)
        else:
            data = stream.read(step)
    if begun:
        raise ValueError("the archive ends inside a record")


def records(stream) -> Iterator[Record]:
    """Sequential reader: frames each record by its content length and verifies its block digest."""
    for raw in members(stream):
        head, sep, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not sep or not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(headers["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: its length is not the one declared")
        block = rest[:size]
        if _digest(block) != headers["warc-block-digest"]:
            raise ValueError(f"{headers.get('warc-record-id')}: block digest differs")
        yield Record(headers, block)


def _row(r: Record) -> tuple:
    """A record as a row; a response's payload digest is verified."""
    http, _, payload = r.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, declared = r.headers["warc-type"], r.headers["warc-payload-digest"]
    if kind == "response" and (len(payload) != size or _digest(payload) != declared):
        raise ValueError(f"{r.headers['warc-record-id']}: payload digest differs")
    refers = r.headers.get("warc-refers-to")
    digest = base64.b32decode(declared.removeprefix("sha1:")).hex()
    return _page_id(r.headers["warc-record-id"]), r.headers["warc-target-uri"], size, digest, kind, _page_id(refers) if refers else None, payload if kind == "response" else None


def write_archives(pages: DataFrame, least: int = LEAST, target: str | None = None) -> DataFrame:
    """Writes one archive per task; returns the manifest (path, records), of the attempts that count.

    Which record is the response follows from an aggregate over digests alone;
    pages are then joined to it by page_id and digest, so a payload that many
    pages share makes no large group. Null html is an empty payload; a row
    without page_id is always a response; repeated rows of the response's
    page_id are responses too; extra columns are ignored.
    """
    target = target or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    large = base.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where(F.col("low") < F.col("refers_to")).select("digest", "refers_to")
    again = large.join(last, "digest").where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    rows = base.select("page_id", "url", "payload", "digest").join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def write(batches):
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        path, n = f"{target}/{uuid.uuid4().hex}.warc.gz", 0

        def fill(out):
            nonlocal n
            for b in itertools.chain([first], batches):
                for page_id, url, data, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    out.write(record(page_id, url, data, refers, refers is not None))
                    n += 1

        commit_file(path, fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return arrow_map(rows, write, "path string, records long")


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the archives, one task per archive, each read sequentially; a damaged record is an error."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    files = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], len(paths)), "path string")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:  # the members are told apart here
                    for r in records(stream):
                        rows.append(_row(r))
                        size += len(r.block)
                        if size > 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return arrow_map(files, read, SCHEMA)


def archived_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the archives, reads them back, and returns a row per record without its payload."""
    paths = sorted(r["path"] for r in write_archives(pages, least).collect())
    return read_archives(pages.sparkSession, paths).drop("payload", "url")
