"""Documents dealt into consecutive key ranges, each range sorted, in one shuffle of the texts."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.llm._store import shuffle_parts

BLOCK = "__llm_block"


def with_blocks(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``df`` with a block number that grows with ``key``, and the number of blocks.

    The limits come from approximate quantiles of the key alone (one scan of
    that column; as many numbers as shuffle partitions reach the driver), so a
    key always falls into the same block, on every attempt of every task. Rows
    without a key are block -1.
    """
    n = shuffle_parts(df.sparkSession)
    ask = [i / n for i in range(1, n)]
    cuts = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", ask, 1 / (4 * n)) if ask else []
    cuts = sorted(set(cuts or []))
    if cuts:
        as_double = f"{BLOCK}_key"
        split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=as_double, outputCol=BLOCK, handleInvalid="keep")
        out = split.transform(df.withColumn(as_double, F.col(key).cast("double"))).drop(as_double)
    else:
        out = df.withColumn(BLOCK, F.lit(0))
    return out.withColumn(BLOCK, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col(BLOCK).cast("int"))), len(cuts) + 1
