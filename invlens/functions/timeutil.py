"""Literal clock arithmetic.

Reports never read the wall clock: every age test is relative to an
explicit ``as_of`` that becomes a foldable literal, so Catalyst folds
``as_of - INTERVAL n YEAR`` into one constant and the comparison can be
pushed into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F



def as_of_literal(as_of) -> Column:
    """``as_of`` (datetime, date or ISO text) as a TIMESTAMP_NTZ literal."""
    if as_of is None:
        raise ValueError("as_of is required: reports never use the wall clock")
    if isinstance(as_of, _dt.datetime):
        text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(as_of, _dt.date):
        text = as_of.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(as_of)
    return F.lit(text).cast("timestamp_ntz")


def minus(as_of, n: int, unit: str) -> Column:
    """``as_of - INTERVAL n unit`` (calendar arithmetic for YEAR/MONTH)."""
    unit = unit.upper()
    if unit not in {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"}:
        raise ValueError(f"unsupported interval unit {unit!r}")
    return as_of_literal(as_of) - F.expr(f"INTERVAL '{int(n)}' {unit}")


def years_before(as_of, n: int) -> Column:
    return minus(as_of, n, "YEAR")


def days_before(as_of, n: int) -> Column:
    return minus(as_of, n, "DAY")
