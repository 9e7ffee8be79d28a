"""Logical-to-physical joins and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import is_file
from invlens.operators.aggregates import latest_physical

KEYS = ["run_id", "file_uri"]


def _for_run(df: DataFrame, run_id: str | None) -> DataFrame:
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def with_physical(
    inv: DataFrame,
    phys: DataFrame,
    run_id: str | None = None,
    on_missing: str = "null",
) -> DataFrame:
    """Inventory rows with the latest ``allocated`` bytes of the same file.

    A left join on ``(run_id, file_uri)`` against the latest-probe view,
    which is unique per key, so each inventory row matches at most once.
    AQE picks the strategy at run time from measured sizes: sort-merge for
    large sides, broadcast when the shuffled physical side is small.

    ``on_missing`` sets ``allocated`` for files without a probe: ``null``,
    ``zero`` or ``logical`` (the logical size). ``probed`` flags matches.
    """
    # Within one run the key is ``file_uri`` alone: the latest-probe aggregate
    # is then hash-partitioned exactly as the join needs (and a table bucketed
    # by ``file_uri`` needs no shuffle on either side).
    keys = ["file_uri"] if run_id is not None else KEYS
    latest = latest_physical(_for_run(phys, run_id), keys).select(*keys, F.col("allocated").alias("_alloc"))
    joined = _for_run(inv, run_id).join(latest, keys, "left")
    probed = F.col("_alloc").isNotNull()
    if on_missing == "null":
        alloc: Column = F.col("_alloc")
    elif on_missing == "zero":
        alloc = F.coalesce(F.col("_alloc"), F.lit(0).cast("long"))
    elif on_missing == "logical":
        alloc = F.coalesce(F.col("_alloc"), F.col("size"))
    else:
        raise ValueError(f"unknown on_missing {on_missing!r}")
    return joined.withColumn("probed", probed).withColumn("allocated", alloc).drop("_alloc")


def capacity(
    inv: DataFrame, phys: DataFrame | None, run_id: str | None = None, size_metric: str = "Logical", on_missing: str = "null"
) -> DataFrame:
    """Total capacity of the run's files by the chosen metric.

    ``Logical`` sums ``size`` and never touches the physical table;
    ``Physical`` sums latest ``allocated`` through :func:`with_physical`.
    """
    files = _for_run(inv, run_id).where(is_file())
    if size_metric == "Logical":
        return files.agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("capacity_bytes"))
    if size_metric == "Physical":
        joined = with_physical(files, phys, run_id, on_missing=on_missing)
        return joined.agg(F.coalesce(F.sum("allocated"), F.lit(0).cast("long")).alias("capacity_bytes"))
    raise ValueError(f"unknown size_metric {size_metric!r}")


def missing_probes(inv: DataFrame, phys: DataFrame, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Files of the run with no allocation row (anti join, not ``NOT IN``).

    Probe keys are made distinct first, map-side before the shuffle, so a file
    probed millions of times is one row per task.
    """
    keys = ["file_uri"] if run_id is not None else KEYS
    files = _for_run(inv, run_id).where(is_file()).select(*keys)
    probed = _for_run(phys, run_id).select(*keys).distinct()
    out = files.join(probed, keys, "left_anti").select("file_uri")
    if limit is not None:
        out = out.orderBy("file_uri").limit(limit)
    return out


def orphan_probes(inv: DataFrame, phys: DataFrame, run_id: str | None = None) -> DataFrame:
    """Allocation keys with no inventory row in the same run."""
    return _for_run(phys, run_id).select(*KEYS).distinct().join(_for_run(inv, run_id).select(*KEYS), KEYS, "left_anti")
