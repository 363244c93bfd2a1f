"""Rounding as DuckDB's: the number times a power of ten, halves away from zero. Python's round takes the even of two, Spark's the decimal digits that are shown."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: float, digits: int) -> float:
    """x rounded to so many digits."""
    power = 10.0**digits
    y = abs(x) * power
    whole = math.floor(y)
    return math.copysign((whole + (y - whole >= 0.5)) / power, x)


def half_up_column(x: Column, digits: int) -> Column:
    """`half_up` as an expression; null gives null."""
    y = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    return F.when(x < 0, -1.0).otherwise(1.0) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
