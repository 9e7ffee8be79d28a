"""Run-to-run comparison and reconciliation against expected figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_reports(
    before: DataFrame, after: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Full outer join of two report results on ``keys`` with per-measure deltas.

    For every measure ``m`` the output has ``m_before``, ``m_after`` and
    ``m_delta`` (after - before, a missing side counting as 0). NULL keys
    pair with each other.
    """
    keys = list(keys)
    b = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(m).alias(f"{m}_before") for m in measures])
    a = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(m).alias(f"{m}_after") for m in measures])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_b_{k}").eqNullSafe(F.col(f"_a_{k}"))
    out = b.join(a, same, "full_outer").select(
        *[F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keys],
        *[f"{m}_{side}" for side in ("before", "after") for m in measures],
    )
    for m in measures:
        out = out.withColumn(
            f"{m}_delta",
            F.coalesce(F.col(f"{m}_after"), F.lit(0)) - F.coalesce(F.col(f"{m}_before"), F.lit(0)),
        )
    return out


def compare_runs(
    inv: DataFrame,
    run_before: str,
    run_after: str,
    report: Callable[..., DataFrame],
    keys: Sequence[str],
    measures: Sequence[str],
    **params,
) -> DataFrame:
    """Run ``report`` on two runs of the same inventory and diff the results."""
    return compare_reports(
        report(inv, run_id=run_before, **params), report(inv, run_id=run_after, **params), keys, measures
    )


def unpivot_metrics(row_df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One-row KPI frame -> ``(metric, value)`` rows (values as double)."""
    return row_df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], list(metrics), "metric", "value"
    )


def reconcile(actual: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Join measured ``(metric, value)`` to ``(metric, expected)`` and test a relative tolerance.

    ``abs_diff = |value - expected|``, ``rel_diff = abs_diff / |expected|``
    (NULL when expected is 0), ``within`` = ``rel_diff <= tolerance``;
    a metric missing on either side is kept with ``within = false``.
    """
    j = actual.join(expected, "metric", "full_outer")
    abs_diff = F.abs(F.col("value") - F.col("expected"))
    rel = F.try_divide(abs_diff, F.abs(F.col("expected")))
    return (
        j.withColumn("abs_diff", abs_diff)
        .withColumn("rel_diff", rel)
        .withColumn("within", F.coalesce(rel <= F.lit(tolerance), (abs_diff == 0), F.lit(False)))
    )


def file_changes(inv: DataFrame, run_before: str, run_after: str) -> DataFrame:
    """One row per file of either run: ``(file_uri, dept, change, resized, reowned, bytes_before, bytes_after)``.

    ``change`` is ``added``, ``removed`` or ``kept``; ``resized`` and
    ``reowned`` compare size and owner null-safely (NULL equals NULL) for kept
    files and are false otherwise. Both runs are read in one scan and merged by
    one aggregation on ``file_uri``, which is a full outer merge with NULL
    keys paired; on a table bucketed by ``file_uri`` it needs no shuffle. The
    department is that of the later run, of the earlier one for removed files. Several
    rows of one URI in a run count as one file with their sizes added up.
    """
    from invlens.functions.scalars import dept

    after = F.col("run_id") == run_after
    rows = inv.where(F.col("run_id").isin(run_before, run_after)).select("file_uri", "size", "owner_name", dept().alias("dept"), after.alias("after"))

    def side(x: str, is_after: bool):
        mine = F.col("after") if is_after else ~F.col("after")
        return [
            F.count_if(mine).alias(f"_n_{x}"),
            F.sum(F.when(mine, F.col("size"))).alias(f"bytes_{x}"),
            F.min(F.when(mine, F.col("owner_name"))).alias(f"_owner_{x}"),
            F.min(F.when(mine, F.col("dept"))).alias(f"_dept_{x}"),
        ]

    g = rows.groupBy("file_uri").agg(*side("before", False), *side("after", True))
    kept = (F.col("_n_before") > 0) & (F.col("_n_after") > 0)
    return g.select(
        "file_uri",
        F.when(F.col("_n_after") > 0, F.col("_dept_after")).otherwise(F.col("_dept_before")).alias("dept"),
        F.when(kept, "kept").when(F.col("_n_after") > 0, "added").otherwise("removed").alias("change"),
        (kept & ~F.col("bytes_before").eqNullSafe(F.col("bytes_after"))).alias("resized"),
        (kept & ~F.col("_owner_before").eqNullSafe(F.col("_owner_after"))).alias("reowned"),
        "bytes_before",
        "bytes_after",
    )


def changes_by_dept(inv: DataFrame, run_before: str, run_after: str) -> DataFrame:
    """Per department: files added, removed, resized, re-owned and unchanged, and the growth in bytes."""
    same = (F.col("change") == "kept") & ~F.col("resized") & ~F.col("reowned")
    zero = F.lit(0).cast("long")
    growth = F.coalesce("bytes_after", zero) - F.coalesce("bytes_before", zero)
    return file_changes(inv, run_before, run_after).groupBy("dept").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed")],
        *[F.count_if(F.col(c)).alias(c) for c in ("resized", "reowned")],
        F.count_if(same).alias("unchanged"),
        F.sum(growth).alias("bytes_delta"),
    )
