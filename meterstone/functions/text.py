"""Text and date expressions used by several jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(value: Column) -> Column:
    return F.lower(F.trim(value))


def tidy_or(value: Column, default: str) -> Column:
    return F.coalesce(tidy(value), F.lit(default))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.trunc(day, "WEEK")


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def words(value: Column) -> Column:
    return F.split(collapse_spaces(value), " ")
