"""Reusable aggregation operators.

All of them are plain DataFrame plans: partial (map-side) aggregation
first, then a shuffle on the group key. Nothing is collected to the
driver and no step puts un-aggregated rows into a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invlens.functions.scalars import half_even_round

# Sub-buckets per power of two used to split the value histogram for exact
# quantiles: 64 octaves x 4096 = at most 262,144 buckets per sign.
QUANTILE_BUCKETS_PER_OCTAVE = 4096
# Parts into which the span of a target's bucket is cut, and how often.
QUANTILE_CUTS = 65536
QUANTILE_LEVELS = 1


def latest_physical(phys: DataFrame, keys: Sequence[str] = ("run_id", "file_uri")) -> DataFrame:
    """One allocation row per ``(run_id, file_uri)``: the newest probe wins.

    Re-probes are appended, so this is the read-side collapse. Ties on
    ``probed_at`` are broken by the larger ``allocated`` so the result is
    deterministic. For a frame already restricted to one run, ``keys`` can be
    ``["file_uri"]`` so the result is partitioned exactly like a join on it.
    """
    return phys.groupBy(*keys).agg(
        F.max_by("allocated", F.struct("probed_at", "allocated")).alias("allocated"),
        F.max("probed_at").alias("probed_at"),
    )


def total_of(df: DataFrame, column: str) -> Column:
    """Uncorrelated scalar subquery: the sum of ``column`` over ``df``, an aggregated result.

    The subquery asks for every column of ``df``, so that pruning leaves the
    aggregate below it as it is in the outer query and AQE reads the same
    shuffle for both: the data are scanned once. For that a filter on group
    keys above must stay above the aggregate too, see :func:`after_groups`.
    """
    parts = [(F.sum(c) if c == column else F.max(c)).alias(c) for c in df.columns]
    return df.agg(F.struct(*parts).alias("totals")).scalar().getField(column)


def after_groups(cond: Column, count: str) -> Column:
    """``cond`` on the group keys of an aggregated result, evaluated after the aggregation.

    It also names the group's row count (never negative), so the optimizer
    cannot push it below the aggregate, where the groups that it drops would be
    missing from the total.
    """
    return cond | (F.col(count) < 0)


def with_share(
    df: DataFrame,
    column: str,
    name: str = "pct",
    digits: int | None = 2,
    total: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ``100 * column / total``; total defaults to the column's sum over ``df``.

    ``df`` is an aggregated result. The total is a scalar subquery over the
    same shuffle, so no task holds every group and nothing is scanned twice.
    With ``bounded`` (only for a group key whose values are fixed in code:
    bands, owner classes) the total is a window over those few group rows.
    """
    if total is not None:
        denom = total
    elif bounded:
        denom = F.sum(column).over(Window.partitionBy())
    else:
        denom = total_of(df, column)
    raw = F.try_divide(F.lit(100.0) * F.col(column), denom)
    return df.withColumn(name, raw if digits is None else half_even_round(raw, digits))


def two_level_running_totals(df: DataFrame, keys: Sequence[str], block: str, order_by: str, sums: dict[str, str]) -> DataFrame:
    """Cumulative sums per ``keys`` in ``order_by`` order over a series of any length.

    ``block`` cuts a key's series into consecutive parts (a month of days, a range of
    values). A part is summed up in its own task; the totals of the parts before it,
    one row per part, are added. So no task holds more rows than one part, or
    one row for each part of a key. ``sums`` maps each new column to the summed one.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, block).orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])], *[F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in sums])
    same = F.lit(True)
    for i, k in enumerate([*keys, block]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{new}") for new, c in sums.items()]).join(before, same)
    return out.select(*df.columns, *[(F.col(f"_in_{new}") + F.col(f"_{new}")).alias(new) for new in sums])


def running_total(df: DataFrame, order_by: str, column: str, name: str | None = None) -> DataFrame:
    """Cumulative sum of ``column`` in ``order_by`` order.

    Only for an already aggregated, bounded series (months, bands): the
    window has no partition key so it runs in one task.
    """
    w = Window.orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name or f"cum_{column}", F.sum(column).over(w))


def top_k(df: DataFrame, order: Sequence[Column], k: int, tie_keys: Sequence[str] = ()) -> DataFrame:
    """``ORDER BY order, tie_keys LIMIT k`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order, *[F.col(t).asc() for t in tie_keys]).limit(k)


def _monotone_bucket(v: Column) -> Column:
    """Non-decreasing integer bucket of a numeric value (log scale, signed)."""
    r = float(QUANTILE_BUCKETS_PER_OCTAVE)
    d = v.cast("double")
    pos = F.floor(F.log2(F.lit(1.0) + d) * r)
    neg = -F.floor(F.log2(F.lit(1.0) - d) * r) - 1
    return F.when(d >= 0, pos).otherwise(neg)


def _of_candidates(hist: DataFrame, cand: DataFrame) -> DataFrame:
    """Histogram rows of the candidates' buckets and value spans."""
    inside = F.col("v").cast("double").between(F.col("from"), F.col("to"))
    return hist.join(F.broadcast(cand), hist["b"].eqNullSafe(cand["cb"])).where(inside)


def _narrowed(hist: DataFrame, cand: DataFrame) -> DataFrame:
    """Each candidate's span cut into equal parts; the part that holds its rank becomes the span."""
    fixed = ["name", "rank", "n", "total", "vmin", "vmax", "cb", "lo"]
    d, span = F.col("v").cast("double"), F.col("to") - F.col("from")
    part = F.coalesce(F.floor(F.try_divide(d - F.col("from"), span) * QUANTILE_CUTS), F.lit(0).cast("long"))
    rows = _of_candidates(hist, cand).select("v", "c", *fixed, part.alias("part"))
    parts = rows.groupBy(*fixed, "part").agg(
        F.sum("c").alias("pc"), F.min(F.col("v").cast("double")).alias("from"), F.max(F.col("v").cast("double")).alias("to")
    )
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("upto", F.col("lo") + F.sum("pc").over(before)).withColumn("lo", F.col("upto") - F.col("pc"))
    return parts.where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("upto"))).select(*fixed, "from", "to")


def value_histogram(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, v, c)``: how often each non-NULL value occurs. Histograms add up: see :func:`merged_histogram`."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull())
    return rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))


def merged_histogram(hist: DataFrame) -> DataFrame:
    """The histogram of all the rows behind several histograms (of runs, of loads)."""
    return hist.groupBy("v").agg(F.sum("c").alias("c"))


def exact_quantiles(
    df: DataFrame, value: Column | str, quantiles: dict[str, float], summary: bool = False, levels: int = QUANTILE_LEVELS
) -> DataFrame:
    """Exact quantiles of a column as one row; :func:`quantiles_of_histogram` says how."""
    return quantiles_of_histogram(value_histogram(df, value), quantiles, summary, levels)


def quantiles_of_histogram(hist: DataFrame, quantiles: dict[str, float], summary: bool = False, levels: int = QUANTILE_LEVELS) -> DataFrame:
    """Exact quantiles of a histogram ``(v, c)`` as one row, one column per entry of ``quantiles``.

    Each result is the element at 0-based position ``floor(q * n)`` of the
    sorted non-NULL values (``n - 1`` for ``q >= 1``), never an interpolation.
    With ``summary`` the row also has ``n``, ``sum``, ``min`` and ``max`` of
    the values, taken from the same histogram (no second scan).

    Plan, with no global sort of the data:

    1. histogram ``value -> count`` (partial aggregation, so a value held by a
       third of all rows is one row after the map side);
    2. per log-scale bucket totals (bounded: at most 2 x 64 x 4096 rows) and
       their running count, which locate the bucket holding each target rank;
    3. ``levels`` times, that bucket's span of values is cut into ``QUANTILE_CUTS``
       equal parts, whose totals (at most that many rows per target) locate the
       part holding the rank; one bucket may hold very many distinct values. For
       values known to be few (path depths) 0 saves the round;
    4. a running count over the histogram rows of those few parts only.

    All uses of the histogram read the same shuffle: the bucket join is
    null-safe so no extra filter is inferred into one branch.
    """
    hist = hist.withColumn("b", _monotone_bucket(F.col("v")))

    buckets = hist.groupBy("b").agg(
        F.sum("c").alias("bc"),
        (F.sum(F.col("v") * F.col("c")) if summary else F.first(F.lit(None))).alias("bs"),
        F.min("v").alias("bmin"),
        F.max("v").alias("bmax"),
    )
    order_w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    buckets = (
        buckets.withColumn("hi", F.sum("bc").over(order_w))
        .withColumn("n", F.sum("bc").over(everything))
        .withColumn("total", F.sum("bs").over(everything) if summary else F.lit(None))
        .withColumn("vmin", F.min("bmin").over(everything))
        .withColumn("vmax", F.max("bmax").over(everything))
        .withColumn("lo", F.col("hi") - F.col("bc"))
    )
    targets = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    rank = F.when(F.col("t.q") >= 1, F.col("n") - 1).otherwise(F.floor(F.col("t.q") * F.col("n")))
    cand = (
        buckets.select("b", "lo", "hi", "n", "total", "vmin", "vmax", "bmin", "bmax", F.explode(targets).alias("t"))
        .select(
            "b", "lo", "hi", "n", "total", "vmin", "vmax", F.col("t.name").alias("name"), rank.alias("rank"),
            F.col("bmin").cast("double").alias("from"), F.col("bmax").cast("double").alias("to"),
        )
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .drop("hi")
        .withColumnRenamed("b", "cb")
    )
    # ``cand`` has at most one row per requested quantile.
    for _ in range(levels):
        cand = _narrowed(hist, cand)
    picked = _of_candidates(hist, cand)
    in_bucket = Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = picked.withColumn("cum", F.col("lo") + F.sum("c").over(in_bucket)).where(F.col("cum") > F.col("rank"))
    aggs = [F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles]
    if summary:
        aggs += [F.max(c).alias(a) for c, a in (("n", "n"), ("total", "sum"), ("vmin", "min"), ("vmax", "max"))]
    return picked.agg(*aggs)


def age_matrix(df: DataFrame, key: str, column: str = "modified", as_of=None, value: str = "size") -> DataFrame:
    """Per ``key``: sums of ``value`` in four age bands of ``column`` (hand pivot).

    Active: ``> as_of-90d``; Warm: ``<= as_of-90d`` and ``> as_of-365d``;
    Cold: ``<= as_of-365d`` and ``> as_of-3y``; Frozen: ``<= as_of-3y``.
    """
    from invlens.functions.timeutil import minus

    c = F.col(column)
    d90, d365, y3 = minus(as_of, 90, "DAY"), minus(as_of, 365, "DAY"), minus(as_of, 3, "YEAR")
    s = F.col(value)

    def sum_if(cond: Column) -> Column:
        return F.sum(F.when(cond, s).otherwise(F.lit(0).cast("long")))

    return df.groupBy(key).agg(
        sum_if(c > d90).alias("active_b"),
        sum_if((c <= d90) & (c > d365)).alias("warm_b"),
        sum_if((c <= d365) & (c > y3)).alias("cold_b"),
        sum_if(c <= y3).alias("frozen_b"),
    )
