"""Headline KPIs: the overview row and the single-number dashboard tiles.

Every tile is a one-row global aggregate over one run. ``kpis`` computes
all of them in a single pass for batch export; each tile function is the
same aggregate restricted to its own column (Catalyst prunes the rest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import (
    acl_mentions,
    has_flag,
    is_directory,
    is_encoded,
    is_file,
    is_non_ascii,
    is_orphan,
    naive_broken,
    newer_than,
    stale,
)
from invlens.functions.scalars import epoch_millis, human_size, pct
from invlens.plans.common import count_if, for_run, inventory_report, n_rows, sum_if, sum_or_zero


@inventory_report
def overview(inv: DataFrame, run_id: str | None = None, as_of=None) -> DataFrame:
    """Files, bytes, owners and four percentages in one row."""
    return (
        for_run(inv, run_id)
        .agg(
            n_rows().alias("files"),
            sum_or_zero("size").alias("logical_bytes"),
            F.count_distinct("owner_sid").alias("unique_owners"),
            count_if(stale("last_accessed", 3, as_of)).alias("_dormant"),
            count_if(is_orphan()).alias("_orphan"),
            count_if(has_flag("W")).alias("_w"),
            count_if(has_flag("B")).alias("_b"),
        )
        .select(
            "files",
            "logical_bytes",
            human_size("logical_bytes").alias("logical_human"),
            "unique_owners",
            pct("_dormant", "files").alias("pct_dormant_3y"),
            pct("_orphan", "files").alias("pct_orphan"),
            pct("_w", "files").alias("pct_widens_access"),
            pct("_b", "files").alias("pct_broken_inherit"),
        )
    )


@inventory_report
def total_files(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    return for_run(inv, run_id).agg(n_rows().alias("files"))


@inventory_report
def total_bytes(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    return for_run(inv, run_id).agg(sum_or_zero("size").alias("bytes"))


@inventory_report
def unique_owners(inv: DataFrame, run_id: str | None = None, approximate: bool = False) -> DataFrame:
    c = F.approx_count_distinct("owner_sid") if approximate else F.count_distinct("owner_sid")
    return for_run(inv, run_id).agg(c.alias("owners"))


@inventory_report
def oldest_modified(inv: DataFrame, run_id: str | None = None, epoch: bool = True) -> DataFrame:
    """Oldest ``modified``: epoch milliseconds (current tile) or the timestamp (older tile)."""
    m = F.min("modified")
    return for_run(inv, run_id).agg((epoch_millis(m) if epoch else m).alias("oldest"))


def _pct_tile(inv: DataFrame, run_id: str | None, cond) -> DataFrame:
    return for_run(inv, run_id).agg(pct(count_if(cond), n_rows(), None).alias("pct"))


@inventory_report
def pct_orphan_files(
    inv: DataFrame, run_id: str | None = None, mode: str = "current", with_status: bool = False
) -> DataFrame:
    """Unrounded % of files with an orphaned owner; ``with_status`` adds the tile colour (1 % / 5 %)."""
    out = _pct_tile(inv, run_id, is_orphan(mode))
    if with_status:
        from invlens.functions.classifiers import ORPHAN_PCT_STEPS, status

        out = out.withColumn("status", status("pct", ORPHAN_PCT_STEPS))
    return out


@inventory_report
def pct_flag_files(inv: DataFrame, run_id: str | None = None, letter: str = "W") -> DataFrame:
    return _pct_tile(inv, run_id, has_flag(letter))


@inventory_report
def pct_everyone_files(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    return _pct_tile(inv, run_id, acl_mentions("Everyone"))


@inventory_report
def orphan_count(inv: DataFrame, run_id: str | None = None, mode: str = "current") -> DataFrame:
    return for_run(inv, run_id).agg(count_if(is_orphan(mode)).alias("orphans"))


@inventory_report
def flag_count(inv: DataFrame, run_id: str | None = None, letter: str = "W", name: str = "widens") -> DataFrame:
    return for_run(inv, run_id).agg(count_if(has_flag(letter)).alias(name))


@inventory_report
def everyone_count(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    return for_run(inv, run_id).agg(count_if(acl_mentions("Everyone")).alias("every"))


@inventory_report
def naive_broken_count(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    return for_run(inv, run_id).agg(count_if(naive_broken()).alias("broken"))


@inventory_report
def modified_recently(inv: DataFrame, run_id: str | None = None, as_of=None, days: int = 1) -> DataFrame:
    return for_run(inv, run_id).agg(count_if(newer_than("modified", days, as_of)).alias("active"))


@inventory_report
def orphan_bytes(inv: DataFrame, run_id: str | None = None, mode: str = "current") -> DataFrame:
    return for_run(inv, run_id).agg(sum_if(is_orphan(mode)).alias("bytes"))


@inventory_report
def acl_protected(inv: DataFrame, run_id: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """Protected (P) and may-narrow (N) counts and shares."""
    return (
        for_run(inv, run_id)
        .agg(
            n_rows().alias("_n"),
            count_if(has_flag("P", case_sensitive)).alias("protected_dacl_files"),
            count_if(has_flag("N", case_sensitive)).alias("may_narrow_files"),
        )
        .select(
            "protected_dacl_files",
            pct("protected_dacl_files", "_n").alias("pct_protected_dacl"),
            "may_narrow_files",
            pct("may_narrow_files", "_n").alias("pct_may_narrow"),
        )
    )


@inventory_report
def ingest_facts(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Row, file and directory counts, URI length and encoding facts, time range."""
    return for_run(inv, run_id).agg(
        n_rows().alias("rows"),
        count_if(is_file()).alias("files"),
        count_if(is_directory()).alias("dirs"),
        F.max(F.length("file_uri")).alias("max_uri_length"),
        count_if(is_non_ascii()).alias("non_ascii_uris"),
        count_if(is_encoded()).alias("encoded_uris"),
        F.min("modified").alias("min_modified"),
        F.max("modified").alias("max_modified"),
    )


@inventory_report
def kpis(
    inv: DataFrame, run_id: str | None = None, as_of=None, hot_rate: float = 23.0, archive_rate: float = 4.0
) -> DataFrame:
    """Every single-number tile in one pass over the run (for batch export)."""
    from invlens.functions.scalars import tib

    return (
        for_run(inv, run_id)
        .agg(
            n_rows().alias("files"),
            sum_or_zero("size").alias("bytes"),
            F.count_distinct("owner_sid").alias("owners"),
            F.min("modified").alias("oldest_modified"),
            count_if(is_orphan()).alias("orphans"),
            count_if(has_flag("W")).alias("widens"),
            count_if(has_flag("B")).alias("broken"),
            count_if(has_flag("P")).alias("protected"),
            count_if(has_flag("N")).alias("may_narrow"),
            count_if(newer_than("modified", 1, as_of)).alias("active"),
            count_if(stale("last_accessed", 3, as_of)).alias("dormant_3y"),
            sum_if(is_orphan()).alias("orphan_bytes"),
            sum_if(stale("last_accessed", 3, as_of)).alias("frozen_bytes"),
            count_if(acl_mentions("Everyone")).alias("everyone"),
            count_if(naive_broken()).alias("naive_broken"),
        )
        .withColumn("oldest", epoch_millis("oldest_modified"))
        .withColumn("pct_orphan", pct("orphans", "files", None))
        .withColumn("pct_widens", pct("widens", "files", None))
        .withColumn("pct_broken", pct("broken", "files", None))
        .withColumn("usd_mo", tib("bytes") * F.lit(float(hot_rate)))
        .withColumn("savings", tib("frozen_bytes") * F.lit(float(hot_rate - archive_rate)))
    )
