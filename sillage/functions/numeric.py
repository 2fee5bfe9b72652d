"""Rounding that does not depend on binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, k: int) -> Column:
    """x at k decimals, half up, by way of a decimal with six; |x| < 1e12."""
    return F.round(x.cast("decimal(18,6)"), k).cast("double")


def share(flag: Column) -> Column:
    """Of the rows, the part where flag holds; null counts as no."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))
