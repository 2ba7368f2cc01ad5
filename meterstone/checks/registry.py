"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.checks.ctes import with_ctes
from meterstone.plans.stored import StoredWarehouse
from meterstone.plans.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The SQL as it was given, without the shared table expressions.
TEXTS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE and small integers as BIGINT, so that both sides of a comparison share their types."""

    def column(field: T.StructField):
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return name.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return name.cast("bigint").alias(field.name)
        return name

    return df.select(*[column(f) for f in df.schema.fields])


def check(name: str, sql: str | None = None, frames: type[Warehouse] = Warehouse):
    """Register ``build(warehouse)`` under ``name``; ``sql`` may use the shared table expressions of ctes.py."""

    def wrap(build: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(frames(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name], TEXTS[name] = with_ctes(sql), sql
        return build

    return wrap


def stored_check(name: str, sql: str | None = None):
    """``check`` for a consumer of staging and marts, which reads the written layer."""
    return check(name, sql, StoredWarehouse)
