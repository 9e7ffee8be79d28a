"""Permission hygiene from the flag string and the raw ACL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.classifiers import acl_pattern
from invlens.functions.predicates import acl_mentions, has_flag, is_directory
from invlens.functions.scalars import ace_count, human_size, parent_dir, path_prefix
from invlens.operators.aggregates import top_k, with_share
from invlens.plans.common import count_if, desc_then, for_run, inventory_report, n_rows, sum_or_zero

FOLDER_FLAGS = ("W", "B", "N", "P", "Z")


@inventory_report
def acl_flag_distribution(inv: DataFrame, run_id: str | None = None, limit: int = 25, pct: bool = False) -> DataFrame:
    """Most frequent flag strings (R10); ``pct`` adds the share of all rows."""
    g = for_run(inv, run_id).groupBy("acl_analysis").agg(n_rows().alias("files"))
    if pct:
        g = with_share(g, "files", "pct")
    return top_k(g, desc_then("files"), limit, ["acl_analysis"])


@inventory_report
def acl_pattern_classifier(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files and bytes per raw-ACL pattern."""
    rows = for_run(inv, run_id).withColumn("pattern", acl_pattern())
    g = rows.groupBy("pattern").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    return g.orderBy(*desc_then("files"), "pattern")


@inventory_report
def top_dirs_broken_inheritance(
    inv: DataFrame, run_id: str | None = None, depth: int = 6, min_files: int = 1000, limit: int = 10
) -> DataFrame:
    """Directory prefixes (first ``depth`` parts) with most broken-inheritance files."""
    rows = for_run(inv, run_id).where(has_flag("B")).withColumn("directory", path_prefix(depth))
    g = rows.groupBy("directory").agg(n_rows().alias("broken_files"), sum_or_zero("size").alias("broken_bytes"))
    g = g.where(F.col("broken_files") > min_files).withColumn("broken_human", human_size("broken_bytes"))
    return top_k(g, desc_then("broken_files"), limit, ["directory"])


@inventory_report
def ace_count_distribution(inv: DataFrame, run_id: str | None = None, cap: int = 40) -> DataFrame:
    """Files per number of ';' in the ACL, capped; key as text, numeric order."""
    g = for_run(inv, run_id).withColumn("_n", ace_count(cap)).groupBy("_n").agg(n_rows().alias("files"))
    return g.orderBy("_n").select(F.col("_n").cast("string").alias("ace_count"), "files")


@inventory_report
def everyone_paths(inv: DataFrame, run_id: str | None = None, limit: int = 50) -> DataFrame:
    """Folders with the most files whose ACL names Everyone (older ops panel, R52)."""
    rows = for_run(inv, run_id).where(acl_mentions("Everyone")).withColumn("parent_dir", parent_dir())
    g = rows.groupBy("parent_dir").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    return top_k(g, desc_then("files"), limit, ["parent_dir"])


@inventory_report
def acl_folder_summary(inv: DataFrame, run_id: str | None = None, flags=FOLDER_FLAGS) -> DataFrame:
    """Per folder: entries, directory rows and entries carrying each flag."""
    aggs = [n_rows().alias("entries"), count_if(is_directory()).alias("dirs")]
    aggs += [count_if(has_flag(f)).alias(f"flag_{f.lower()}") for f in flags]
    return for_run(inv, run_id).groupBy("file_path").agg(*aggs)
