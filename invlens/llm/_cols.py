"""Column handling that all operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame, outputs: list[str], own: list[str]) -> list[str]:
    """Input columns to carry through: all but the operator's own inputs and those named like one of its outputs."""
    taken = {x.lower() for x in [*outputs, *own]}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
