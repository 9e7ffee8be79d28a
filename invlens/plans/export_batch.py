"""The standard export batch: the reference's report CSVs for one run.

By default the run is scanned three times: once for its summary table,
from which eighteen reports roll up (see ``plans/summary.py``), once for the size
histogram and once for the duplicates. With ``method="direct"`` every report reads the run's partition directly, so each scan is pruned to
the two or three columns that report needs, and up to ``parallelism``
report jobs run at once. Optionally (``persist=True``, for slow remote
storage) one column-pruned frame of the run is persisted first and shared;
measured on local Parquet this is slower, because the cache has to hold
all eleven columns while the direct scans read only a few. Persisted
blocks lost with an executor are recomputed from lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.plans import acl, age, capacity, duplicates, overview, ownership, size, summary
from invlens.plans.common import for_run
from invlens.sources.export import export_reports

# Columns the standard reports read; the wide ACL texts are never loaded.
EXPORT_COLUMNS = (
    "run_id",
    "file_path",
    "filename",
    "extension",
    "size",
    "owner_name",
    "owner_sid",
    "acl_analysis",
    "created",
    "modified",
    "last_accessed",
)


def standard_reports(inv: DataFrame, as_of) -> dict[str, DataFrame]:
    """The twelve whole-scan reports and the eight gap-fill reports, by file name."""
    return {
        "overview": overview.overview(inv, None, as_of),
        "dept-breakdown": capacity.dept_breakdown(inv, None, pct=True),
        "year-distribution": capacity.year_histogram(inv, None, pct=True),
        "acl-analysis-flags": acl.acl_flag_distribution(inv, None, limit=50, pct=True),
        "ownership": ownership.ownership_split(inv, None, pct=True),
        "extensions-by-bytes": size.extensions(inv, None, "bytes", 25),
        "extensions-by-count": size.extensions(inv, None, "files", 25, human=False),
        "size-buckets": size.size_buckets(inv, None, human=True),
        "dormancy-by-dept": age.dormancy_by_dept(inv, None, as_of),
        "top-orphan-sids": ownership.orphan_sids(inv, None, touch=None),
        "service-accounts": ownership.service_accounts(inv, None),
        "chargeback": ownership.chargeback(inv, None),
        "age-bands-last-accessed": age.age_bands(inv, None, as_of),
        "top-dirs-broken-inheritance": acl.top_dirs_broken_inheritance(inv, None),
        "median-file-size": size.size_quantiles(inv, None),
        "tree-depth": size.tree_depth(inv, None),
        "duplicate-floor": duplicates.duplicate_floor(inv, None),
        "size-distribution-6band": size.size_bands(inv, None),
        "protected-dacl": overview.acl_protected(inv, None),
        "year-2019-bulge": capacity.year_cohort_by_dept(inv, None, 2019),
    }


def standard_reports_from_summary(run_summary: DataFrame, inv: DataFrame, run_id: str | None) -> dict[str, DataFrame]:
    """The same twenty reports: all but two from the run's summary table, those two from the inventory."""
    reports = summary.summary_reports(run_summary) | {
        "median-file-size": size.size_quantiles(inv, run_id),
        "duplicate-floor": duplicates.duplicate_floor(inv, run_id),
    }
    order = list(standard_reports(inv, "1970-01-01 00:00:00"))
    return {name: reports[name] for name in order}


def export_standard(
    spark: SparkSession,
    inv: DataFrame,
    run_id: str,
    as_of,
    out_dir: str,
    persist: bool = False,
    parallelism: int = 4,
    method: str = "summary",
    summary_path: str | None = None,
) -> DataFrame:
    """Write the standard reports of ``run_id`` as CSV under ``out_dir``; returns the status frame.

    ``method="summary"`` adds the run to the summary table at ``summary_path``
    (``<out_dir>/_summary`` if not given) and rolls the reports up from there. With
    ``method="direct"`` every report reads the inventory; ``persist`` then
    fills the pruned run frame once before the report jobs start, so
    concurrent jobs read the persisted blocks instead of each scanning the table.
    """
    if method not in ("summary", "direct"):
        raise ValueError(f"unknown method {method!r}")
    if method == "summary":
        table = summary.add_run_summary(inv, run_id, as_of, summary_path or f"{out_dir.rstrip('/')}/_summary")
        reports = standard_reports_from_summary(table, inv, run_id)
        return export_reports(spark, reports, out_dir, parallelism=parallelism).withColumn("run_id", F.lit(run_id))
    run = for_run(inv, run_id).select(*EXPORT_COLUMNS)
    if persist:
        run = run.persist(StorageLevel.MEMORY_AND_DISK)
        run.count()
    try:
        status = export_reports(spark, standard_reports(run, as_of), out_dir, parallelism=parallelism)
        return status.withColumn("run_id", F.lit(run_id))
    finally:
        if persist:
            run.unpersist()
