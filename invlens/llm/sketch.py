"""Merged partition sketches: which hash cells were met at least twice, or how often, in bounded memory.

Each task counts into its own cells and sends the cells it met; one task per
block of cells adds them up. What comes back is one bit (or byte) per cell,
whose size is set by the cell count alone and is at most ``MAX_CELLS``.
Estimates are never below the truth.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from invlens.llm._store import arrow_map, brought, shuffle_parts

#: Cells of one row of a sketch, at most: 32 MB as bits.
MAX_CELLS = 1 << 28
_BLOCK = 18
SCHEMA = "row int, block int, cells binary"


def cells_for(expected: int) -> int:
    """Cells of one row for so many expected items: four each, a power of two, within the bound."""
    return min(MAX_CELLS, max(1 << 20, 1 << (4 * max(1, expected) - 1).bit_length()))


def cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in one of two rows, from different bits of it."""
    part = hashes if row == 0 else (hashes >> np.uint64(32)) ^ (hashes << np.uint64(7))
    return (part & np.uint64(cells - 1)).astype(np.uint32)


def _packed(offsets: np.ndarray) -> bytes:
    """Ascending offsets as their differences, low bytes first and apart from the others, which are mostly zero."""
    steps = np.diff(offsets, prepend=np.uint32(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def partial(items: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int, rows: int = 2) -> DataFrame:
    """Each task's cells: per sketch row and block the distinct offsets met, those met twice or more listed twice."""

    def run(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held, size = [], 0
            for r in range(rows):
                found, count = np.unique(cell(every, r, cells), return_counts=True)
                found = np.repeat(found, np.minimum(count, 2))
                if not len(found):
                    continue
                block = found >> np.uint32(_BLOCK)
                cut = np.flatnonzero(np.diff(block, prepend=np.uint32(0xFFFFFFFF)))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(found)], strict=True):
                    yield r, int(block[a]), _packed(found[a:b] & np.uint32((1 << _BLOCK) - 1))

        def batch(rows_):
            r, b, c = zip(*rows_, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["row", "block", "cells"])

        for h in hashes(batches):
            held.append(h)
            size += len(h)
            if size > 1 << 19:
                if out := list(flush()):
                    yield batch(out)
        if out := list(flush()):
            yield batch(out)

    return arrow_map(items, run, SCHEMA)


def repeated(parts: DataFrame, cells: int, rows: int = 2) -> list[np.ndarray]:
    """Merges partial sketches: per row a bit for each cell whose count is two or more. Bits of ``rows * cells`` reach the driver."""
    spark = parts.sparkSession

    def merge(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for r, k, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total = seen.setdefault((r, k), np.zeros(1 << _BLOCK, np.uint8))
                found = _unpacked(data)
                again = np.flatnonzero(found[1:] == found[:-1])
                total[found[again]] = 2
                once = np.delete(found, np.concatenate([again, again + 1])) if len(again) else found
                total[once] = np.minimum(total[once], 1) + 1
        for (r, k), total in seen.items():
            bits = zlib.compress(np.packbits(total >= 2).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([k], pa.int32()), pa.array([bits], pa.binary())], ["row", "block", "cells"])

    out = [np.zeros(max(1, cells // 8), np.uint8) for _ in range(rows)]
    dealt = parts.repartition(shuffle_parts(spark), "row", "block")
    for r, k, data in brought(arrow_map(dealt, merge, SCHEMA), "sketch"):
        bits = np.frombuffer(zlib.decompress(data), np.uint8)
        at = k << (_BLOCK - 3)
        out[r][at:at + len(bits)] = bits[:len(out[r]) - at]
    return out


def maybe_repeated(bits: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may have been met at least twice; never false for one that was."""
    out = np.ones(len(hashes), bool)
    for r, row in enumerate(bits):
        c = cell(hashes, r, len(row) * 8)
        out &= (row[c >> np.uint32(3)] >> (7 - (c & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
    return out
