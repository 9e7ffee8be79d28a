"""Size distribution: extensions, bands, exact quantiles, tree depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.classifiers import LOG_SIZE_BUCKETS, LOG_SIZE_REST, SIZE_BANDS, SIZE_BANDS_REST, size_band
from invlens.functions.scalars import human_size, path_depth
from invlens.operators.aggregates import exact_quantiles, top_k
from invlens.plans.common import desc_then, for_run, inventory_report, n_rows, sum_or_zero

SIZE_QUANTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
DEPTH_QUANTILES = {"p95_depth": 0.95, "p50_depth": 0.50}


@inventory_report
def extensions(
    inv: DataFrame,
    run_id: str | None = None,
    order_by: str = "bytes",
    limit: int = 15,
    human: bool = True,
    bytes_only: bool = False,
) -> DataFrame:
    """Top extensions by bytes or files."""
    rows = for_run(inv, run_id)
    if bytes_only:
        g = rows.groupBy("extension").agg(sum_or_zero("size").alias("bytes"))
    else:
        g = rows.groupBy("extension").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
        if human:
            g = g.withColumn("bytes_human", human_size("bytes"))
    return top_k(g, desc_then(order_by), limit, ["extension"])


@inventory_report
def size_buckets(inv: DataFrame, run_id: str | None = None, human: bool = False) -> DataFrame:
    """Files and bytes per log-scale size bucket, ordered by smallest size."""
    rows = for_run(inv, run_id).withColumn("bucket", size_band(LOG_SIZE_BUCKETS, LOG_SIZE_REST))
    g = rows.groupBy("bucket").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"), F.min("size").alias("_min"))
    cols = ["bucket", "files", "bytes"] + (["bytes_human"] if human else [])
    if human:
        g = g.withColumn("bytes_human", human_size("bytes"))
    return g.orderBy("_min").select(*cols)


@inventory_report
def size_bands(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files and bytes per numbered size band."""
    rows = for_run(inv, run_id).withColumn("size_band", size_band(SIZE_BANDS, SIZE_BANDS_REST))
    g = rows.groupBy("size_band").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    return g.withColumn("bytes_human", human_size("bytes")).orderBy("size_band")


@inventory_report
def size_quantiles(
    inv: DataFrame,
    run_id: str | None = None,
    quantiles: dict[str, float] = SIZE_QUANTILES,
    approximate: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """Exact size quantiles and the mean, each with its human text.

    The mean is ``sum / count`` of exact integers from the same histogram;
    its text uses the truncated integer mean. ``approximate`` uses
    ``percentile_approx`` (one pass, bounded memory, rank error about
    ``1 / accuracy``) instead of the exact plan.
    """
    rows = for_run(inv, run_id)
    if approximate:
        q = rows.agg(
            *[F.percentile_approx("size", float(v), accuracy).alias(k) for k, v in quantiles.items()],
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("sum"),
        )
    else:
        q = exact_quantiles(rows, "size", quantiles, summary=True)
    cols = []
    for name in quantiles:
        cols += [F.col(name).alias(f"{name}_bytes"), human_size(name).alias(f"{name}_human")]
    cols += [(F.col("sum") / F.col("n")).alias("avg_bytes")]
    out = q.select(*cols)
    return out.withColumn("avg_human", human_size(F.col("avg_bytes").cast("long")))


@inventory_report
def tree_depth(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """Maximum, 95th and 50th percentile of path depth over non-empty paths."""
    rows = for_run(inv, run_id).where(F.col("file_path") != "").withColumn("depth", path_depth())
    q = exact_quantiles(rows, "depth", DEPTH_QUANTILES, summary=True, levels=0)
    return q.select(F.col("max").cast("int").alias("max_depth"), "p95_depth", "p50_depth")
