"""Runs: run list, multi-run trend, inventory snapshot, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import is_orphan
from invlens.functions.scalars import human_size
from invlens.operators.compare import compare_runs, reconcile, unpivot_metrics
from invlens.plans.capacity import dept_breakdown
from invlens.plans.common import count_if, inventory_report, n_rows, sum_if, sum_or_zero
from invlens.plans.overview import overview
from invlens.sources.inventory import list_runs

OVERVIEW_METRICS = (
    "files",
    "logical_bytes",
    "unique_owners",
    "pct_dormant_3y",
    "pct_orphan",
    "pct_widens_access",
    "pct_broken_inherit",
)


def run_list(inv: DataFrame) -> DataFrame:
    """Runs, newest first by text ``max(run_start_time)``."""
    return list_runs(inv)


@inventory_report
def run_trend(inv: DataFrame) -> DataFrame:
    """Files, bytes and orphaned footprint per run."""
    return inv.groupBy("run_id").agg(
        F.max("run_start_time").alias("run_start_time"),
        n_rows().alias("files"),
        sum_or_zero("size").alias("bytes"),
        count_if(is_orphan()).alias("orphan_files"),
        sum_if(is_orphan()).alias("orphan_bytes"),
    )


@inventory_report
def inventory_snapshot(inv: DataFrame, approximate_runs: bool = False) -> DataFrame:
    """Rows, runs, newest modification (text, ms) and total size text of the table (M1 batch form)."""
    runs = F.approx_count_distinct("run_id") if approximate_runs else F.count_distinct("run_id")
    return inv.agg(
        n_rows().alias("rows"),
        runs.alias("runs"),
        F.date_format(F.max("modified"), "yyyy-MM-dd HH:mm:ss.SSS").alias("newest_modified"),
        sum_or_zero("size").alias("_bytes"),
    ).select("rows", "runs", "newest_modified", human_size("_bytes").alias("total_bytes"))


@inventory_report
def compare_dept_runs(inv: DataFrame, run_before: str, run_after: str) -> DataFrame:
    """Department files and bytes of two runs side by side with deltas."""
    return compare_runs(inv, run_before, run_after, dept_breakdown, ["dept"], ["files", "bytes"])


@inventory_report
def reconcile_runs(
    inv: DataFrame, run_expected: str, run_actual: str, as_of=None, tolerance: float = 0.05
) -> DataFrame:
    """Overview figures of ``run_actual`` against ``run_expected`` within a relative tolerance."""
    actual = unpivot_metrics(overview(inv, run_actual, as_of), OVERVIEW_METRICS)
    expected = unpivot_metrics(overview(inv, run_expected, as_of), OVERVIEW_METRICS).withColumnRenamed(
        "value", "expected"
    )
    return reconcile(actual, expected, tolerance)
