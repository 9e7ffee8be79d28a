"""Dormancy and age: bands, department heat, daily review, long-term trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invlens.functions.classifiers import (
    ACCESS_AGE_BANDS,
    ACCESS_AGE_REST,
    ANCIENT_PCT_STEPS,
    DORMANCY_PCT_STEPS,
    MODIFIED_AGE_BANDS,
    MODIFIED_AGE_REST,
    age_band,
    status,
)
from invlens.functions.predicates import has_dept, stale
from invlens.functions.scalars import dept, human_size, pct
from invlens.functions.timeutil import as_of_literal, minus
from invlens.operators.aggregates import age_matrix, running_total, top_k, two_level_running_totals, with_share
from invlens.plans.common import count_if, desc_then, for_run, inventory_report, n_rows, sum_or_zero


@inventory_report
def dormancy_by_dept(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    min_files: int = 1000,
    order_by: str = "files",
    limit: int | None = None,
    with_status: bool = False,
) -> DataFrame:
    """Share of files per department not accessed for 1, 3 and 5 years.

    ``with_status`` adds the dashboard's threshold colour of each share
    (green / orange / red at 50 / 80 %, and 30 / 60 % for five years).
    """
    rows = for_run(inv, run_id).where(has_dept()).withColumn("dept", dept())
    g = rows.groupBy("dept").agg(
        count_if(stale("last_accessed", 1, as_of)).alias("_a1"),
        count_if(stale("last_accessed", 3, as_of)).alias("_a3"),
        count_if(stale("last_accessed", 5, as_of)).alias("_a5"),
        n_rows().alias("files"),
    )
    g = g.where(F.col("files") > min_files).select(
        "dept",
        pct("_a1", "files", 1).alias("pct_aging_1y"),
        pct("_a3", "files", 1).alias("pct_dormant_3y"),
        pct("_a5", "files", 1).alias("pct_ancient_5y"),
        "files",
    )
    if with_status:
        g = (
            g.withColumn("status_1y", status("pct_aging_1y", DORMANCY_PCT_STEPS))
            .withColumn("status_3y", status("pct_dormant_3y", DORMANCY_PCT_STEPS))
            .withColumn("status_5y", status("pct_ancient_5y", ANCIENT_PCT_STEPS))
        )
    if limit is None:
        return g.orderBy(*desc_then(order_by), "dept")
    return top_k(g, desc_then(order_by), limit, ["dept"])


@inventory_report
def age_bands(inv: DataFrame, run_id: str | None = None, as_of=None, by: str = "last_accessed") -> DataFrame:
    """Files and bytes per access-age band with shares of the run."""
    edges, rest = (ACCESS_AGE_BANDS, ACCESS_AGE_REST)
    rows = for_run(inv, run_id).withColumn("band", age_band(by, edges, rest, as_of))
    g = rows.groupBy("band").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    g = g.withColumn("bytes_human", human_size("bytes"))
    g = with_share(g, "files", "pct_files", bounded=True)
    return with_share(g, "bytes", "pct_bytes", bounded=True).orderBy("band")


@inventory_report
def capacity_by_age(inv: DataFrame, run_id: str | None = None, as_of=None, by: str = "modified") -> DataFrame:
    """Bytes per modification-age band."""
    rows = for_run(inv, run_id).withColumn("age", age_band(by, MODIFIED_AGE_BANDS, MODIFIED_AGE_REST, as_of))
    return rows.groupBy("age").agg(sum_or_zero("size").alias("bytes")).orderBy("age")


@inventory_report
def extension_age_matrix(inv: DataFrame, run_id: str | None = None, as_of=None, limit: int = 25) -> DataFrame:
    """Bytes per extension in four modification-age bands, top by total."""
    g = age_matrix(for_run(inv, run_id), "extension", "modified", as_of)
    total = F.col("active_b") + F.col("warm_b") + F.col("cold_b") + F.col("frozen_b")
    return top_k(g, [total.desc()], limit, ["extension"])


@inventory_report
def dept_age_heat(inv: DataFrame, run_id: str | None = None, as_of=None, by: str = "last_accessed") -> DataFrame:
    """Department x access-age band: files and share of the department's files.

    The share window is partitioned by department over the aggregated
    rows (departments x 4 bands), never over raw rows.
    """
    rows = (
        for_run(inv, run_id)
        .where(has_dept())
        .withColumn("dept", dept())
        .withColumn("band", age_band(by, ACCESS_AGE_BANDS, ACCESS_AGE_REST, as_of))
    )
    g = rows.groupBy("dept", "band").agg(n_rows().alias("files"))
    dept_total = F.sum("files").over(Window.partitionBy("dept"))
    return g.withColumn("pct_files", pct(F.col("files"), dept_total))


TIME_COLUMNS = ("created", "modified", "last_accessed")


@inventory_report
def daily_review(inv: DataFrame, run_id: str | None = None, as_of=None, days: int = 30) -> DataFrame:
    """Files and bytes per day and timestamp kind over the last ``days`` days.

    Window is ``(as_of - days, as_of]``. Rows with none of the three
    timestamps in the window are dropped before the three-way unpivot.
    """
    lo, hi = minus(as_of, days, "DAY"), as_of_literal(as_of)
    in_window = [(F.col(c) > lo) & (F.col(c) <= hi) for c in TIME_COLUMNS]
    any_in = in_window[0] | in_window[1] | in_window[2]
    rows = for_run(inv, run_id).where(any_in).select("size", *TIME_COLUMNS)
    long = rows.unpivot(["size"], list(TIME_COLUMNS), "kind", "ts").where((F.col("ts") > lo) & (F.col("ts") <= hi))
    return long.groupBy("kind", F.to_date("ts").alias("day")).agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))


@inventory_report
def cumulative_trend(
    inv: DataFrame, run_id: str | None = None, as_of=None, years: int = 10, by: str = "created"
) -> DataFrame:
    """Monthly files and bytes by ``by`` over ``[as_of - years, as_of)`` with running totals.

    Aggregation first (one row per month, at most 12 x ``years``), then
    the running window over that short series.
    """
    lo, hi = minus(as_of, years, "YEAR"), as_of_literal(as_of)
    rows = for_run(inv, run_id).where((F.col(by) >= lo) & (F.col(by) < hi))
    g = rows.groupBy(F.trunc(F.col(by).cast("date"), "month").alias("month")).agg(
        n_rows().alias("files"), sum_or_zero("size").alias("bytes")
    )
    g = running_total(g, "month", "files", "cum_files")
    return running_total(g, "month", "bytes", "cum_bytes")


@inventory_report
def cumulative_trend_daily(inv: DataFrame, run_id: str | None = None, as_of=None, years: int = 30, by: str = "created") -> DataFrame:
    """Daily files and bytes per department over ``[as_of - years, as_of)`` with running totals (R66 at a fine grain).

    The running totals are two-level: within a month of a department, plus the
    totals of the months before, so no task holds a whole long series.
    """
    lo, hi = minus(as_of, years, "YEAR"), as_of_literal(as_of)
    rows = for_run(inv, run_id).where((F.col(by) >= lo) & (F.col(by) < hi))
    g = rows.groupBy(dept().alias("dept"), F.to_date(by).alias("day")).agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    g = g.withColumn("month", F.trunc("day", "month"))
    out = two_level_running_totals(g, ["dept"], "month", "day", {"cum_files": "files", "cum_bytes": "bytes"})
    return out.select("dept", "day", "files", "bytes", "cum_files", "cum_bytes")
