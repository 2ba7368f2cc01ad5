"""Number helpers whose results do not depend on summation order or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int = 2) -> Column:
    """Half-up rounding of a DOUBLE, written out so that every engine agrees."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def exact_sum(value: Column, scale: int = 2) -> Column:
    """Sum of two-decimal numbers as a decimal, so that partial sums merge without error."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(value: Column, scale: int = 2) -> Column:
    return exact_sum(value, scale) / F.nullif(F.count(value), F.lit(0)).cast("double")


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole as DOUBLE; NULL when the whole is zero."""
    return part.cast("double") * 100.0 / F.nullif(whole, F.lit(0)).cast("double")
