"""Capacity by department, folder and creation year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import has_dept, stale, year_between, year_is
from invlens.functions.scalars import dept, human_size, path_part, top_folder_legacy
from invlens.operators.aggregates import after_groups, top_k, with_share
from invlens.plans.common import desc_then, for_run, inventory_report, n_rows, sum_or_zero


@inventory_report
def dept_breakdown(inv: DataFrame, run_id: str | None = None, pct: bool = False) -> DataFrame:
    """Files and bytes per department (R2).

    With ``pct`` (R3) the share is of *all* bytes of the run, the
    share-root rows with an empty department included, so the grouping
    runs over every row and the empty department is dropped afterwards.
    """
    rows = for_run(inv, run_id)
    if not pct:
        rows = rows.where(has_dept())
    rows = rows.withColumn("dept", dept())
    g = rows.groupBy("dept").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    if pct:
        g = with_share(g, "bytes", "pct_bytes").where(after_groups(F.col("dept") != "", "files"))
    g = g.select("dept", "files", "bytes", human_size("bytes").alias("bytes_human"), *(["pct_bytes"] if pct else []))
    return g.orderBy(*desc_then("bytes"), "dept")


@inventory_report
def dept_capacity_top(inv: DataFrame, run_id: str | None = None, limit: int = 16) -> DataFrame:
    """Top departments by bytes."""
    rows = for_run(inv, run_id).where(has_dept()).withColumn("dept", dept())
    g = rows.groupBy("dept").agg(sum_or_zero("size").alias("bytes"))
    return top_k(g, desc_then("bytes"), limit, ["dept"])


@inventory_report
def year_histogram(
    inv: DataFrame, run_id: str | None = None, lo: int = 2015, hi: int = 2027, pct: bool = False, counts_only: bool = False
) -> DataFrame:
    """Files (and bytes) per creation year in ``[lo, hi]``.

    ``pct_files`` is the share of all rows of the run, years outside the
    range included: grouping runs over all years, the range is applied after.
    """
    rows = for_run(inv, run_id)
    if not pct:
        rows = rows.where(year_between("created", lo, hi))
    rows = rows.withColumn("year", F.year("created"))
    if counts_only:
        g = rows.groupBy("year").agg(n_rows().alias("files"))
    else:
        g = rows.groupBy("year").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    if pct:
        g = with_share(g, "files", "pct_files").where(after_groups(F.col("year").between(lo, hi), "files"))
    return g.orderBy("year")


@inventory_report
def year_cohort_by_dept(inv: DataFrame, run_id: str | None = None, year: int = 2019, limit: int = 10) -> DataFrame:
    """Departments holding the most files created in ``year``."""
    rows = for_run(inv, run_id).where(year_is("created", year) & has_dept()).withColumn("dept", dept())
    g = rows.groupBy("dept").agg(n_rows().alias(f"files_{year}"), sum_or_zero("size").alias(f"bytes_{year}"))
    g = g.withColumn("bytes_human", human_size(f"bytes_{year}"))
    return top_k(g, desc_then(f"files_{year}"), limit, ["dept"])


def _top_folder(legacy: bool):
    return top_folder_legacy() if legacy else path_part(4)


@inventory_report
def top_folders(inv: DataFrame, run_id: str | None = None, limit: int = 20, legacy: bool = False) -> DataFrame:
    """Top-level folders by bytes (R48); ``legacy`` uses the older regex."""
    rows = for_run(inv, run_id).withColumn("top_folder", _top_folder(legacy)).where(F.col("top_folder") != "")
    g = rows.groupBy("top_folder").agg(sum_or_zero("size").alias("bytes"))
    return top_k(g, desc_then("bytes"), limit, ["top_folder"])


@inventory_report
def cold_folders(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    limit: int = 25,
    by: str = "last_accessed",
    years: int = 3,
    legacy: bool = False,
) -> DataFrame:
    """Folders with the most bytes not touched for ``years``."""
    rows = (
        for_run(inv, run_id)
        .where(stale(by, years, as_of))
        .withColumn("top_folder", _top_folder(legacy))
        .where(F.col("top_folder") != "")
    )
    g = rows.groupBy("top_folder").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    return top_k(g, desc_then("bytes"), limit, ["top_folder"])
