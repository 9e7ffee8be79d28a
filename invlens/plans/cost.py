"""Cost tiles: hot storage cost, archive savings, large-and-stale worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import large_and_stale, stale
from invlens.functions.scalars import tib
from invlens.operators.aggregates import top_k
from invlens.plans.common import desc_then, for_run, inventory_report, n_rows, sum_if, sum_or_zero

HOT_RATE = 23.0  # USD per TiB per month
ARCHIVE_RATE = 4.0  # USD per TiB per month
APPROX_PHYSICAL_FACTOR = 0.014
GIB = 1073741824


@inventory_report
def hot_cost(inv: DataFrame, run_id: str | None = None, hot_rate: float = HOT_RATE) -> DataFrame:
    """Monthly cost of all bytes at the hot rate."""
    return for_run(inv, run_id).agg((tib(sum_or_zero("size")) * F.lit(float(hot_rate))).alias("usd_mo"))


@inventory_report
def archive_savings(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    hot_rate: float = HOT_RATE,
    archive_rate: float = ARCHIVE_RATE,
    by: str = "last_accessed",
    years: int = 3,
) -> DataFrame:
    """Monthly saving from moving frozen bytes to the archive tier."""
    frozen = sum_if(stale(by, years, as_of))
    return for_run(inv, run_id).agg((tib(frozen) * F.lit(float(hot_rate - archive_rate))).alias("savings"))


@inventory_report
def frozen_by_extension(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    hot_rate: float = HOT_RATE,
    archive_rate: float = ARCHIVE_RATE,
    by: str = "last_accessed",
    limit: int = 20,
) -> DataFrame:
    """Frozen files and bytes per extension with the monthly saving."""
    g = (
        for_run(inv, run_id)
        .where(stale(by, 3, as_of))
        .groupBy("extension")
        .agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    )
    g = g.withColumn("savings_usd_mo", tib("bytes") * F.lit(float(hot_rate - archive_rate)))
    return top_k(g, desc_then("bytes"), limit, ["extension"])


@inventory_report
def quick_wins(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    min_size: int = GIB,
    years: int = 3,
    by: str = "last_accessed",
    limit: int = 200,
) -> DataFrame:
    """Largest files over ``min_size`` not touched for ``years``.

    Ties on size are ordered by the other output columns, so the k rows
    returned are the same on every engine.
    """
    rows = for_run(inv, run_id).where(large_and_stale(min_size, years, as_of, by))
    rows = rows.select("filename", "extension", F.col("size").alias("bytes"), "owner_name", "modified")
    return top_k(rows, desc_then("bytes"), limit, ["filename", "extension", "owner_name", "modified"])


@inventory_report
def cost_model(
    inv: DataFrame,
    run_id: str | None = None,
    as_of=None,
    hot_rate: float = HOT_RATE,
    archive_rate: float = ARCHIVE_RATE,
    egress_rate: float = 0.0,
    retrieval_rate: float = 0.0,
    request_rate: float = 0.0,
    recalled_share: float = 0.0,
    by: str = "last_accessed",
    years: int = 3,
) -> DataFrame:
    """Monthly cost now and with frozen data archived, fees included (R73), one row.

    With F the frozen bytes in TiB (not touched for ``years``), n their files, H the other TiB, r the ``recalled_share``
    of the frozen data read back in a month:

    * ``cost_now = hot_rate * (H + F)``
    * ``storage = hot_rate * H + archive_rate * F``
    * ``fees = r * (F * (retrieval_rate + egress_rate) + n / 1000 * request_rate)``
    * ``savings = cost_now - storage - fees``

    Rates are USD per TiB and month, per TiB read back (``retrieval_rate``), per TiB moved out
    (``egress_rate``), and per 1000 requests, one a file (``request_rate``). All fees are 0 unless given, which leaves
    the saving of R39.
    """
    frozen = stale(by, years, as_of)
    g = for_run(inv, run_id).agg(sum_or_zero("size").alias("_all"), sum_if(frozen).alias("_frozen"), F.count_if(frozen).alias("frozen_files"))
    total, cold = tib(F.col("_all")), tib(F.col("_frozen"))
    now = total * F.lit(float(hot_rate))
    storage = (total - cold) * F.lit(float(hot_rate)) + cold * F.lit(float(archive_rate))
    fees = F.lit(float(recalled_share)) * (cold * F.lit(float(retrieval_rate + egress_rate)) + F.col("frozen_files") / F.lit(1000.0) * F.lit(float(request_rate)))
    return g.select("frozen_files", now.alias("cost_now"), storage.alias("storage"), fees.alias("fees")).withColumn("savings", F.col("cost_now") - F.col("storage") - F.col("fees"))


@inventory_report
def approx_physical(inv: DataFrame, run_id: str | None = None, factor: float = APPROX_PHYSICAL_FACTOR) -> DataFrame:
    """Estimated on-disk bytes as ``logical x factor`` (an estimate, not a measurement; R76)."""
    return (
        for_run(inv, run_id)
        .agg(sum_or_zero("size").alias("logical_bytes"))
        .withColumn("approx_physical_bytes", F.col("logical_bytes") * F.lit(float(factor)))
    )
