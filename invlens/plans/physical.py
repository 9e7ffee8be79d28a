"""Logical against physical capacity: progress, coverage, totals, ratio, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import is_file
from invlens.functions.scalars import half_even_round, human_size, pct
from invlens.operators.aggregates import latest_physical
from invlens.operators.joins import missing_probes, with_physical
from invlens.plans.common import count_if, for_run, n_rows, sum_or_zero

CLUSTER_ALLOCATION = 131072


def _alloc(phys: DataFrame, run_id: str | None, dedupe: bool) -> DataFrame:
    p = for_run(phys, run_id)
    return latest_physical(p) if dedupe else p


def probe_progress(phys: DataFrame, run_id: str | None = None) -> DataFrame:
    """Probe rows so far and the first/last probe time."""
    return for_run(phys, run_id).agg(
        n_rows().alias("probed"), F.min("probed_at").alias("started"), F.max("probed_at").alias("latest")
    )


def probe_progress_by_run(phys: DataFrame) -> DataFrame:
    """Progress per run (batch form of the probe monitor)."""
    return phys.groupBy("run_id").agg(
        n_rows().alias("probed"),
        F.count_distinct("file_uri").alias("distinct_files"),
        F.min("probed_at").alias("started"),
        F.max("probed_at").alias("latest"),
    )


def coverage(inv: DataFrame, phys: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files expected, distinct files probed, and the shortfall."""
    expected = for_run(inv, run_id).where(is_file()).agg(n_rows().alias("expected"))
    probed = for_run(phys, run_id).agg(F.count_distinct("file_uri").alias("probed")).scalar()
    return expected.select("expected", probed.alias("probed")).withColumn("missing", F.col("expected") - F.col("probed"))


def missing_files(inv: DataFrame, phys: DataFrame, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Files of the run with no probe (R57); all of them unless ``limit``."""
    return missing_probes(inv, phys, run_id, limit)


def physical_total(phys: DataFrame, run_id: str | None = None, dedupe: bool = True) -> DataFrame:
    """Allocated bytes of the run (R58); ``dedupe`` counts only each file's latest probe."""
    return (
        _alloc(phys, run_id, dedupe)
        .agg(n_rows().alias("files"), sum_or_zero("allocated").alias("physical_bytes"))
        .withColumn("physical_total", human_size("physical_bytes"))
    )


def physical_ratio(inv: DataFrame, phys: DataFrame, run_id: str | None = None, dedupe: bool = True) -> DataFrame:
    """Logical bytes of files, allocated bytes, and allocated / logical to 4 places."""
    logical = for_run(inv, run_id).where(is_file()).agg(sum_or_zero("size").alias("logical_bytes"))
    physical = _alloc(phys, run_id, dedupe).agg(sum_or_zero("allocated")).scalar()
    out = logical.select("logical_bytes", physical.alias("physical_bytes"))
    return out.select(
        "logical_bytes",
        "physical_bytes",
        human_size("logical_bytes").alias("logical"),
        human_size("physical_bytes").alias("physical"),
        half_even_round(F.try_divide(F.col("physical_bytes"), F.col("logical_bytes")), 4).alias("physical_over_logical"),
    )


def allocation_histogram(phys: DataFrame, run_id: str | None = None, dedupe: bool = True) -> DataFrame:
    """Files and bytes at each exact allocation size."""
    g = _alloc(phys, run_id, dedupe).groupBy("allocated").agg(
        n_rows().alias("files"), sum_or_zero("allocated").alias("allocated_bytes")
    )
    return g.select(
        "allocated",
        human_size("allocated").alias("bucket"),
        "files",
        human_size("allocated_bytes").alias("bytes"),
    ).orderBy("allocated")


def allocation_share(
    phys: DataFrame, run_id: str | None = None, cluster: int = CLUSTER_ALLOCATION, dedupe: bool = True
) -> DataFrame:
    """Files allocated exactly ``cluster`` bytes and below it, with shares."""
    a = F.col("allocated")
    return (
        _alloc(phys, run_id, dedupe)
        .agg(n_rows().alias("files"), count_if(a == cluster).alias("at_cluster"), count_if(a < cluster).alias("below_cluster"))
        .withColumn("pct_at_cluster", pct("at_cluster", "files"))
        .withColumn("pct_below_cluster", pct("below_cluster", "files"))
    )


def logical_physical_tiles(
    inv: DataFrame,
    phys: DataFrame,
    run_id: str | None = None,
    on_missing: str = "null",
    method: str = "join",
    dedupe: bool = True,
) -> DataFrame:
    """Logical and on-disk capacity of the run's files.

    ``join``: files left-joined to each file's latest probe. ``sums``: two
    independent totals, no join; equal to ``join`` only when no probe
    lacks an inventory row. With ``sums`` and ``dedupe=False`` the on-disk
    total is a plain sum over the probe rows (two scans, no shuffle of
    keys): exact only on a compacted table (one probe per file, see
    ``compact_physical``).
    """
    files = for_run(inv, run_id).where(is_file())
    if method == "join":
        j = with_physical(files, phys, run_id, on_missing=on_missing)
        out = j.agg(
            sum_or_zero("size").alias("logical_bytes"),
            sum_or_zero("allocated").alias("on_disk_bytes"),
            count_if(F.col("probed")).alias("probed_files"),
            n_rows().alias("files"),
        )
    elif method == "sums":
        logical = files.agg(sum_or_zero("size").alias("logical_bytes"), n_rows().alias("files"))
        probes = for_run(phys, run_id)
        latest = (latest_physical(probes) if dedupe else probes).agg(
            sum_or_zero("allocated").alias("on_disk_bytes"), n_rows().alias("probed_files")
        )
        out = logical.select(
            "logical_bytes",
            latest.select("on_disk_bytes").scalar().alias("on_disk_bytes"),
            latest.select("probed_files").scalar().alias("probed_files"),
            "files",
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("logical_capacity", human_size("logical_bytes")).withColumn(
        "on_disk_capacity", human_size("on_disk_bytes")
    )


def capacity_tile(
    inv: DataFrame, phys: DataFrame, run_id: str | None = None, size_metric: str = "Logical", on_missing: str = "null"
) -> DataFrame:
    """One capacity number by the ``size_metric`` toggle (J2): bytes and text."""
    from invlens.operators.joins import capacity

    return capacity(inv, phys, run_id, size_metric, on_missing).withColumn(
        "capacity_human", human_size("capacity_bytes")
    )


def spot_sample(inv: DataFrame, run_id: str | None = None, k: int = 20) -> DataFrame:
    """``k`` files of the run for a second probe: those of smallest MD5 of their URI, so the same on every run."""
    files = for_run(inv, run_id).where(is_file()).select("run_id", "file_uri")
    return files.orderBy(F.md5(F.col("file_uri").cast("binary")), "file_uri").limit(k)


def acceptance_check(
    inv: DataFrame,
    phys: DataFrame,
    run_id: str,
    expected_allocated: Column | int,
    probed_again: DataFrame,
    tolerance: float = 0.05,
    max_missing: float = 0.001,
    k: int = 20,
) -> DataFrame:
    """``(bar, value, expected, ok)``: the four acceptance bars of a probe load.

    ``row_count``: different files probed against files of the run.
    ``allocated_total``: latest allocated bytes against ``expected_allocated``
    (a number or a scalar subquery) within ``tolerance``. ``spot_check``: of the
    ``k`` files of :func:`spot_sample`, those whose latest ``allocated`` equals the
    second probe in ``probed_again (file_uri, allocated)``; all must. ``missing_share``:
    share of the files without a probe, under ``max_missing``.
    """
    files = for_run(inv, run_id).where(is_file()).select("file_uri")
    latest = latest_physical(for_run(phys, run_id), ["file_uri"])
    joined = files.join(latest, "file_uri", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count("allocated").alias("probed"), F.coalesce(F.sum("allocated"), F.lit(0).cast("long")).alias("total")
    )
    again = probed_again.select(F.col("file_uri").alias("_uri"), F.col("allocated").alias("_again"))
    # The sample has k rows at most, so it is sent to the tasks and neither table is shuffled for it.
    sample = F.broadcast(spot_sample(inv, run_id, k).select("file_uri"))
    probes = for_run(phys, run_id).join(sample, "file_uri", "left_semi")
    second = again.join(sample, again["_uri"] == sample["file_uri"], "left_semi")
    spot = second.join(latest_physical(probes, ["file_uri"]), F.col("_uri") == F.col("file_uri"), "left")
    matched = spot.agg(F.count_if(F.col("allocated") == F.col("_again"))).scalar()
    sampled = spot_sample(inv, run_id, k).agg(F.count(F.lit(1))).scalar()
    expected = expected_allocated if isinstance(expected_allocated, Column) else F.lit(int(expected_allocated))
    one = joined.select("*", matched.alias("matched"), sampled.alias("sampled"), expected.cast("double").alias("expected"))
    share = F.coalesce(F.try_divide((F.col("files") - F.col("probed")).cast("double"), F.col("files").cast("double")), F.lit(0.0))

    def bar(name, value, wanted, ok):
        return F.struct(F.lit(name).alias("bar"), value.cast("double").alias("value"), wanted.cast("double").alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok"))

    bars = F.array(
        bar("row_count", F.col("probed"), F.col("files"), F.col("probed") == F.col("files")),
        bar("allocated_total", F.col("total"), F.col("expected"), F.abs(F.col("total") - F.col("expected")) <= tolerance * F.col("expected")),
        bar("spot_check", F.col("matched"), F.col("sampled"), F.col("matched") == F.col("sampled")),
        bar("missing_share", share, F.lit(max_missing), share < max_missing),
    )
    return one.select(F.explode(bars).alias("b")).select("b.*")
