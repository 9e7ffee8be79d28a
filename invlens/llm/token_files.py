"""Token ids in files of independent zstandard frames with a trailing seek table (operator 5).

A shard holds a range of documents in ascending ``doc_id`` order::

    frame, frame, ...      each an independent zstandard frame of little-endian
                           unsigned 32-bit ids of consecutive documents
    index                  one zstandard frame: per document its doc_id (int64),
                           frame number, first id in the frame and id count (uint32)
    seek table             per frame: offset, compressed bytes, ids (uint64),
                           CRC-32 of the compressed bytes (uint32)
    footer                 offset of index and of seek table, frames, documents
                           (uint64), CRC-32 of index and seek table, magic

A reader loads footer, seek table and index, then reads and decompresses only
the frames that hold the documents asked for, and checks each frame's CRC.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.llm._order import BLOCK, with_blocks
from invlens.llm._store import arrow_map, commit_file, filesystem, new_path
from invlens.llm._tokens import encoder

MAGIC = b"TOKZSEEK"
_FOOTER = struct.Struct("<QQQQI8s")
_SEEK = np.dtype([("offset", "<u8"), ("size", "<u8"), ("ids", "<u8"), ("crc", "<u4")])
_INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame", "<u4"), ("first", "<u4"), ("count", "<u4")])
#: Ids after which a frame is closed. A document is never cut, so a frame holds one document at least.
FRAME_IDS = 1 << 16

MANIFEST = "block int, path string, n_docs long, n_ids long"


class ShardWriter:
    """Writes one shard to an open binary stream; holds one frame and the index of the shard in memory."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        import zstandard

        self.out, self.frame_ids, self.zstd = out, frame_ids, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.at, self.frames, self.index, self.part, self.held, self.n_ids = 0, [], [], [], 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.held and self.held + n > self.frame_ids:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.held, n))
        self.part.append(ids)
        self.held += n
        self.n_ids += n

    def _flush(self) -> None:
        if self.part:
            data = self.zstd.compress(b"".join(self.part))
            self.frames.append((self.at, len(data), self.held, zlib.crc32(data)))
            self._put(data)
            self.part, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        index = self.zstd.compress(np.array(self.index, _INDEX).tobytes())
        self._put(index)
        seek_at, seek = self.at, np.array(self.frames, _SEEK).tobytes()
        self._put(seek)
        self._put(_FOOTER.pack(index_at, seek_at, len(self.frames), len(self.index), zlib.crc32(seek, zlib.crc32(index)), MAGIC))


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str):
        import zstandard

        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        if size < _FOOTER.size:
            raise ValueError(f"{uri}: too short for a token shard")
        index_at, seek_at, frames, docs, crc, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        index, seek = self._at(index_at, seek_at - index_at), self._at(seek_at, frames * _SEEK.itemsize)
        if zlib.crc32(seek, zlib.crc32(index)) != crc:
            raise ValueError(f"{uri}: checksum of its index differs")
        self.uri, self.zstd = uri, zstandard.ZstdDecompressor()
        self.frames = np.frombuffer(seek, _SEEK)
        self.index = np.frombuffer(self.zstd.decompress(index, max_output_size=docs * _INDEX.itemsize), _INDEX)
        self.frames_read = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        offset, size, ids, crc = self.frames[k].tolist()
        data = self._at(offset, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"{self.uri}: checksum of frame {k} differs")
        self.frames_read += 1
        return self.zstd.decompress(data, max_output_size=ids * 4) if ids else b""

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, position of its first id in the shard, ids) in file order; only frames with a wanted document are read."""
        before = np.concatenate([[0], np.cumsum(self.frames["ids"].astype(np.int64))])
        held, data = -1, b""
        for doc_id, null_id, k, first, count in self.index.tolist():
            if wanted is not None and (null_id or doc_id not in wanted):
                continue
            if k != held:
                held, data = k, self.frame(k)
            yield None if null_id else doc_id, int(before[k]) + first, data[4 * first:4 * (first + count)]

    def close(self) -> None:
        self.file.close()


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in names), strict=True)


def write_token_files(docs: DataFrame, tokenizer_path: str, byte_level: bool = True, end_id: int = 0, target: str | None = None) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes shards in ascending ``doc_id`` order.

    Returns the manifest: block (ascending with doc_id), path, documents, ids.
    Rows without a doc_id come first; rows with equal doc_id stand in the
    order of their texts; a null text has the end id only. Extra columns are
    ignored. Each attempt of a task writes files of its own name, and only
    those of the attempt that counts are in the manifest.
    """
    target = target or new_path(docs.sparkSession, "token-files")
    frame, n = with_blocks(docs.select("doc_id", "text"), "doc_id")
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches):
        own = encoder(tokenizer_path, byte_level)
        rows, ended = _rows(batches, ["doc_id", "text", BLOCK]), object()
        row = next(rows, ended)
        while row is not ended:
            block, path = row[2], f"{target}/shard-{row[2] + 1:06d}-{uuid.uuid4().hex}.tokz"
            counts = [0, 0]

            def fill(stream, block=block, counts=counts):
                nonlocal row
                shard = ShardWriter(stream)
                while row is not ended and row[2] == block:
                    shard.add(row[0], own.ids(row[1]) + end)
                    counts[0] += 1
                    row = next(rows, ended)
                shard.close()
                counts[1] = shard.n_ids

            commit_file(path, fill)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "path": [path], "n_docs": pa.array([counts[0]], pa.int64()), "n_ids": pa.array([counts[1]], pa.int64())})
        own.forget()

    dealt = frame.repartitionByRange(n + 1, BLOCK).sortWithinPartitions(BLOCK, F.col("doc_id").asc_nulls_first(), "text")
    return arrow_map(dealt, write, MANIFEST)


def read_token_files(spark: SparkSession, manifest: list, wanted: set[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of the documents in shards; ``manifest`` has one row per shard, in any order.

    ``start`` counts the ids of all documents before it, over all shards.
    With ``wanted`` only the frames that hold those documents are read.
    """
    rows, before = [], 0
    for r in sorted(manifest, key=lambda r: r["block"]):
        rows.append((r["path"], before))
        before += r["n_ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    shards = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "path string, before long")

    def read(batches):
        for path, base in _rows(batches, ["path", "before"]):
            reader = ShardReader(path)
            out, size = [], 0
            for doc_id, start, ids in reader.documents(wanted):
                out.append((doc_id, base + start, len(ids) // 4, ids))
                size += len(ids)
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)
            reader.close()

    return arrow_map(shards, read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, s, n, i = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files, then reads them back: per document doc_id, start, n_tokens, ids_crc32.

    The manifest, one row per shard, passes through the driver; ids do not.
    """
    manifest = write_token_files(docs, tokenizer_path).collect()
    back = read_token_files(docs.sparkSession, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
