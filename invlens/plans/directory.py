"""Folder-level and attribute breakdowns: directory usage, sources, streams, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import is_directory, is_file
from invlens.functions.scalars import path_depth, pct, source_of
from invlens.plans.common import count_if, for_run, inventory_report, n_rows, sum_if, sum_or_zero


@inventory_report
def directory_usage(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Bytes, files and directory rows under every folder, all ancestors included.

    Rows are first aggregated per ``file_path`` (the parent folder), so
    the ancestor explode runs over distinct folders x depth, not over
    files. ``file_path`` ends with '/', so ancestors are the prefixes up
    to each '/' ('/', '/S/', '/S/Shared/', ...).
    """
    per_folder = for_run(inv, run_id).groupBy("file_path").agg(
        count_if(is_file()).alias("files"),
        count_if(is_directory()).alias("dirs"),
        sum_or_zero("size").alias("bytes"),
    )
    levels = F.sequence(F.lit(1), F.greatest(path_depth("file_path") - 1, F.lit(1)))
    exploded = per_folder.select("files", "dirs", "bytes", "file_path", F.explode(levels).alias("level"))
    exploded = exploded.withColumn(
        "directory", F.concat(F.expr("substring_index(file_path, '/', level)"), F.lit("/"))
    )
    return exploded.groupBy("directory", "level").agg(
        sum_or_zero("files").alias("files"), sum_or_zero("dirs").alias("dirs"), sum_or_zero("bytes").alias("bytes")
    )


@inventory_report
def source_slice(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files and bytes per ``win://host/share`` source."""
    rows = for_run(inv, run_id).withColumn("source", source_of())
    return rows.groupBy("source").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))


@inventory_report
def ads_breakdown(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files and bytes per alternate-data-stream name list."""
    return for_run(inv, run_id).groupBy("win_ads_names").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))


@inventory_report
def migrated_share(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Migrated files and bytes with their shares."""
    m = F.col("migrated")
    return (
        for_run(inv, run_id)
        .agg(
            n_rows().alias("_n"),
            sum_or_zero("size").alias("_b"),
            count_if(m).alias("migrated_files"),
            sum_if(m).alias("migrated_bytes"),
        )
        .select(
            "migrated_files",
            "migrated_bytes",
            pct("migrated_files", "_n").alias("pct_migrated_files"),
            pct("migrated_bytes", "_b").alias("pct_migrated_bytes"),
        )
    )


@inventory_report
def storage_tiers(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files and bytes per storage class and state."""
    return (
        for_run(inv, run_id)
        .groupBy("storage_class", "storage_state")
        .agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    )
