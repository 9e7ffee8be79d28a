"""Small building blocks shared by the reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invlens.functions.predicates import is_file


def inventory_report(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Gives a report over the inventory (its first argument) the keyword ``files_only``.

    Directory rows count as files by default; with ``files_only=True`` they are left
    out before anything is counted. The condition is on columns of the scan,
    so it is pushed into the Parquet reader with the run filter.
    """

    @wraps(fn)
    def report(inv: DataFrame, *args, files_only: bool = False, **kw) -> DataFrame:
        return fn(inv.where(is_file()) if files_only else inv, *args, **kw)

    return report


def for_run(inv: DataFrame, run_id: str | None) -> DataFrame:
    """Rows of one run (a partition filter on ``run_id``), or all rows."""
    return inv if run_id is None else inv.where(F.col("run_id") == run_id)


def n_rows() -> Column:
    return F.count(F.lit(1))


def sum_or_zero(c) -> Column:
    """``sum`` that gives 0, not NULL, over no rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def sum_if(cond: Column, value="size") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, v).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def desc_then(order: str, *ties: str) -> list[Column]:
    return [F.col(order).desc(), *[F.col(t).asc() for t in ties]]
