"""What the operators on vectors share: usable rows, a bounded sample, and blocks of rows that meet their queries in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.llm._store import arrow_map, shuffle_parts

#: Queries that one task puts to a block, at most about; crowded blocks are repeated for more.
ASKS = 65_536
#: Rows of a block, at most about.
BLOCK_ROWS = 65_536
#: Products held at once while a block is searched.
_CELLS = 1 << 20


def usable(df: DataFrame, id_col: str, vec_col: str, keep: list[str] = (), zero: bool = False) -> DataFrame:
    """(id long, *keep, vec array<double>): rows whose vector is whole.

    Left out are rows without id, null vectors, vectors with a null or non-finite component, zero
    vectors (unless ``zero``), and vectors of another length than most have (ties: the
    longer). Of several rows of one id the one with the least (vector, kept columns) stays.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), *keep, vec.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    rows = rows.where(F.size("vec") == (sizes["d"] if sizes else 0))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("vec", *keep)).alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in keep), "x.vec")


def packed(rows: DataFrame, scale: float | None = None) -> DataFrame:
    """``vec`` as little-endian doubles in one binary; with ``scale`` each is first floor(scale * x)."""
    names = rows.columns
    at = names.index("vec")

    def run(batches):
        for b in batches:
            v = b.column(at)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            if scale is not None:
                flat = np.floor(scale * flat)
            d = len(flat) // max(1, len(v))
            data = [x.tobytes() for x in flat.reshape(len(v), d)] if len(v) else []
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if i == at else b.column(i) for i in range(len(names))], names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return arrow_map(rows, run, kinds)


def matrix(data, d: int) -> np.ndarray:
    """An Arrow column (or list) of packed vectors as a matrix."""
    items = data.to_pylist() if isinstance(data, (pa.Array, pa.ChunkedArray)) else data
    return np.frombuffer(b"".join(items), "<f8").reshape(len(items), d)


def sampled(rows: DataFrame, n: int, bound: int) -> DataFrame:
    """At most ``bound`` of the ``n`` rows, those of smallest id hash; the same on every run."""
    h = F.xxhash64("id")
    if n > 2 * bound:
        rows = rows.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2.0 * bound / n)))
    return rows.orderBy(h, "id").limit(bound)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products added up component by component, so that equal vectors have equal products wherever they stand."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def blocks(counts: dict[int, int], groups: int, rows: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks of each group, so that a block has about ``rows`` rows at most."""
    many = [max(1, -(-counts.get(g, 0) // rows)) for g in range(groups)]
    first = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(int).tolist() if groups else []
    return first, many


#: Rows and queries of a block: kind 0 is a row, kind 1 a query; ``tag`` and ``aux`` are the operator's.
MEET = ["key", "kind", "id", "tag", "vec", "aux"]


def meet(rows: DataFrame, asks: DataFrame, parts: list[int], first_key: list[int], answer: Callable, schema: str) -> DataFrame:
    """Every query of a block against every row of the block.

    ``rows`` and ``asks`` have (block, id, tag, vec, aux). The queries of block b are dealt
    into ``parts[b]`` tasks by their id, the rows are repeated for each, and a
    task reads the rows of a key before its queries: it holds one block and one batch of
    queries at a time, however many there are.
    ``answer(block columns, query columns)`` yields record batches; columns are dicts.
    """
    def lit(x):
        return F.split(F.lit(",".join(map(str, x)) or "0"), ",").cast("array<int>")

    n, start = lit(parts)[F.col("block")], lit(first_key)[F.col("block")]
    cols = ["id", "tag", "vec", "aux"]
    r = rows.select(F.explode(F.sequence(start, start + n - 1)).alias("key"), F.lit(0).alias("kind"), *cols)
    a = asks.select((start + F.pmod(F.xxhash64("id"), n)).cast("int").alias("key"), F.lit(1).alias("kind"), *cols)
    dealt = r.union(a).repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "kind")

    def run(batches: Iterator[pa.RecordBatch]):
        key, held, ready = None, [], None
        for b in batches:
            keys = b.column(0).to_numpy()
            kinds = b.column(1).to_numpy()
            change = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if keys[lo] != key:
                    key, held, ready = keys[lo], [], None
                if kinds[lo] == 0:
                    held.append(part.select(MEET[2:]))
                elif held:
                    if ready is None:
                        ready = _columns(pa.Table.from_batches(held))
                    yield from answer(ready, _columns(pa.Table.from_batches([part.select(MEET[2:])])))

    return arrow_map(dealt, run, schema)


def _columns(t: pa.Table) -> dict:
    vec = t.column("vec").to_pylist()
    d = len(vec[0]) // 8
    return {"id": t.column("id").to_numpy(), "tag": t.column("tag").to_numpy(), "vec": matrix(vec, d), "aux": t.column("aux").to_pylist(), "cache": {}}


def steps(queries: int, rows: int) -> Iterator[slice]:
    """Slices of the queries whose products with the rows fit in memory."""
    by = max(1, _CELLS // max(1, rows))
    for lo in range(0, queries, by):
        yield slice(lo, min(queries, lo + by))
