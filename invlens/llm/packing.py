"""Best-fit packing of tokenized documents into fixed-length sequences (operator 7).

Only lengths matter for packing, and there are at most ``capacity`` of them.
So Spark counts pieces per length, the driver packs that histogram (its size
does not depend on the corpus), and each piece then finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invlens.llm._store import arrow_map, shuffle_parts, written
from invlens.llm._tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``rank`` on, ``per_bin`` in each of the ``bins`` sequences from ``first`` on, beginning at ``offset``."""

    length: int
    rank: int
    bins: int
    per_bin: int
    first: int
    offset: int


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Packs counts of lengths; returns the runs and the number of sequences.

    Large items (above a third of the capacity) go at most two to a bin: the
    longest left is matched with the longest that fits beside it. The smaller
    ones follow in descending length, each into the fullest bin it fits; a bin
    is opened only if none fits. Equal bins are handled together, so the work
    and the number of runs depend on the capacity and not on the counts. A
    step that fills a group of bins at least halves its gap, which bounds the
    runs by bins' groups times log2(capacity).
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be 1 to the capacity")
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> groups of bins (first, bins)
    n_bins = 0

    def put(length: int, bins: int, per_bin: int, first: int, offset: int) -> None:
        runs.append(Run(length, used[length], bins, per_bin, first, offset))
        used[length] += bins * per_bin
        left[length] -= bins * per_bin
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if a not in left:
            large.pop()
            continue
        i = len(large) - 1
        while i >= 0 and (large[i] + a > capacity or large[i] not in left or (large[i] == a and left[a] < 2)):
            i -= 1
        if i < 0:
            bins = left[a]
            put(a, bins, 1, n_bins, 0)
            gaps[capacity - a].append((n_bins, bins))
        else:
            b = large[i]
            bins = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, bins, 1, n_bins, 0)
            put(b, bins, 1, n_bins, a)
            gaps[capacity - a - b].append((n_bins, bins))
        n_bins += bins
        large = [n for n in large if n in left]
    for length in sorted((n for n in left), reverse=True):
        fits = [g for g in gaps if g >= length and gaps[g]]
        heapq.heapify(fits)
        while length in left:
            if fits:
                gap = fits[0]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    heapq.heappop(fits)
            else:
                gap, first = capacity, n_bins
                bins = -(-left[length] // (capacity // length))
                n_bins += bins
            per_bin = gap // length
            full = min(bins, left[length] // per_bin)
            rest = left[length] - full * per_bin
            if full:
                put(length, full, per_bin, first, capacity - gap)
                gaps[gap - per_bin * length].append((first, full))
            if full < bins and rest:  # the last copies of this length, in one bin
                put(length, 1, rest, first + full, capacity - gap)
                gaps[gap - rest * length].append((first + full, 1))
                full += 1
            if full < bins:
                gaps[gap].append((first + full, bins - full))
    return runs, n_bins


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, byte_level: bool = False, with_ids: bool = False) -> DataFrame:
    """Every whole text as ids and ``end_id``, cut into pieces of ``capacity`` ids (the last may be shorter).

    A null text has the end id only. Repeated rows are pieces of their own;
    extra columns are ignored.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    schema = PIECE + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        import zlib

        own = encoder(tokenizer_path, byte_level)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:len(names)]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = own.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)
        own.forget()

    return arrow_map(docs.select("doc_id", "text"), cut, schema)


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank`` from 0 among the rows of equal ``length``.

    A common length is spread over salts: ranks within (length, salt), plus
    the counts of the salts before it.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("salt", "own", "base")


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length, ids_crc32``; packs as ``pack_histogram`` does."""
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = pack_histogram(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.rank))
    columns = {k: np.array([getattr(r, k) for r in runs], np.int64) for k in Run.__dataclass_fields__}
    sent = spark.sparkContext.broadcast(columns)

    def assign(batches):
        t = sent.value
        first_of = np.searchsorted(t["length"], np.arange(capacity + 2))
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                lo, hi = first_of[n], first_of[n + 1]
                at[own] = lo + np.searchsorted(t["rank"][lo:hi], rank[own], "right") - 1
            k = rank - t["rank"][at]
            seq = t["first"][at] + k // t["per_bin"][at]
            offset = t["offset"][at] + k % t["per_bin"][at] * length
            keep = [i for i, x in enumerate(b.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq), pa.array(offset)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    full = ranked(rows, max(16, shuffle_parts(spark)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema if f.name != "rank"]
    return arrow_map(full, assign, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, byte_level: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset.

    The pieces are written to the shared folder first: packing needs all
    their lengths before it can place any, and encoding is the costly part.
    """
    return place(written(pieces(docs, tokenizer_path, capacity, end_id, byte_level, with_ids), "pieces"), capacity)
