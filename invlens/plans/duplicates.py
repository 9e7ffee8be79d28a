"""Duplicate candidates by (filename, size) or by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import size_over
from invlens.functions.scalars import human_size
from invlens.operators.aggregates import top_k
from invlens.plans.common import desc_then, for_run, inventory_report, n_rows, sum_or_zero

DUPLICATE_FLOOR = 1048576


def _clusters(rows: DataFrame, keys: list[str], min_copies: int) -> DataFrame:
    """Groups of ``keys`` with more than ``min_copies - 1`` copies.

    Grouping is a partial + final hash aggregate, so a group holding a
    large share of all rows is reduced map side before the shuffle.
    """
    g = rows.groupBy(*keys).agg(n_rows().alias("copies"))
    g = g.where(F.col("copies") >= min_copies)
    return g.withColumn("wasted_bytes", (F.col("copies") - 1) * F.col("size"))


@inventory_report
def duplicate_clusters(
    inv: DataFrame, run_id: str | None = None, min_size: int = DUPLICATE_FLOOR, limit: int | None = 50
) -> DataFrame:
    """``(filename, size)`` clusters with more than one copy, by wasted bytes."""
    rows = for_run(inv, run_id).where(size_over(min_size)).select("filename", "size")
    g = _clusters(rows, ["filename", "size"], 2)
    return g if limit is None else top_k(g, desc_then("wasted_bytes"), limit, ["filename", "size"])


@inventory_report
def duplicate_floor(inv: DataFrame, run_id: str | None = None, min_size: int = DUPLICATE_FLOOR) -> DataFrame:
    """Summary of all duplicate clusters (R23): two-level aggregate."""
    g = duplicate_clusters(inv, run_id, min_size, limit=None)
    return g.agg(
        n_rows().alias("dup_clusters"),
        sum_or_zero("copies").alias("total_duplicate_files"),
        sum_or_zero("wasted_bytes").alias("total_wasted_bytes"),
        sum_or_zero(F.col("copies") - 1).alias("reclaimable_file_count"),
    ).select(
        "dup_clusters",
        "total_duplicate_files",
        "total_wasted_bytes",
        human_size("total_wasted_bytes").alias("total_wasted_human"),
        "reclaimable_file_count",
    )


@inventory_report
def content_duplicates(
    inv: DataFrame, run_id: str | None = None, hash_col: str = "hash", min_size: int = 0, limit: int | None = None
) -> DataFrame:
    """``(hash, size)`` clusters when the inventory carries a content hash column."""
    if hash_col not in inv.columns:
        raise ValueError(f"inventory has no {hash_col!r} column")
    rows = for_run(inv, run_id).where(size_over(min_size)).select(F.col(hash_col).alias("hash"), "size")
    g = _clusters(rows, ["hash", "size"], 2)
    return g if limit is None else top_k(g, desc_then("wasted_bytes"), limit, ["hash", "size"])
