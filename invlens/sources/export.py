"""Batch export of report results to CSV, one folder per report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("report", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _write_one(name: str, rep, out_dir: str, single_file: bool) -> tuple:
    target = f"{out_dir.rstrip('/')}/{name}"
    try:
        df = rep() if callable(rep) else rep
        if single_file:
            df = df.coalesce(1)
        df.write.mode("overwrite").option("header", "true").csv(target)
        return (name, True, target, None)
    except Exception as exc:  # collected per report, the batch goes on
        return (name, False, target, f"{type(exc).__name__}: {exc}")


def export_reports(
    spark: SparkSession,
    reports: Mapping[str, DataFrame | Callable[[], DataFrame]],
    out_dir: str,
    single_file: bool = True,
    parallelism: int = 4,
) -> DataFrame:
    """Write each report as CSV with a header under ``out_dir/<name>``.

    Reports are small aggregated results, so ``single_file`` coalesces each
    to one file (only the last, already aggregated stage runs as one task).
    Up to ``parallelism`` report jobs run at once from driver threads, so
    their scheduling and commit latencies overlap. A failing report does
    not stop the batch: the returned status frame has one row per report,
    in input order, with the error text if any.
    """
    items = list(reports.items())
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        status = list(pool.map(lambda kv: _write_one(kv[0], kv[1], out_dir, single_file), items))
    return spark.createDataFrame(status, STATUS_SCHEMA)
