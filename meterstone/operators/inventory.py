"""What exists and how much of it: table inventory, row floors and previews."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.sources.schemas import columns

# Smallest accepted row counts.
ROW_FLOORS = {
    "raw_users": 900,
    "raw_events": 7500,
    "raw_subscriptions": 700,
    "raw_payments": 4500,
    "stg_users": 900,
    "stg_events": 7500,
    "stg_subscriptions": 700,
    "stg_payments": 4500,
}

EXPECTED_TABLES = (
    *ROW_FLOORS,
    "mart_user_metrics",
    "mart_cohort_retention",
    "mart_revenue_metrics",
    "mart_funnel_analysis",
)

PREVIEW = {
    "stg_users": ("user_id", ("email", "plan", "country")),
    "stg_events": ("event_id", ("event_type", "event_date")),
    "stg_subscriptions": ("subscription_id", ("plan", "mrr_usd", "started_at")),
    "stg_payments": ("payment_id", ("currency", "amount_usd", "payment_date")),
    "mart_user_metrics": ("metric_date", ("plan", "country", "daily_active_users")),
    "mart_cohort_retention": ("cohort_month", ("plan", "country", "retention_period", "retained_users")),
    "mart_revenue_metrics": ("metric_month", ("plan", "country", "acquisition_channel", "paying_customers")),
    "mart_funnel_analysis": ("cohort_month", ("plan", "country", "acquisition_channel", "signups")),
}


def missing_tables(spark: SparkSession, expected: tuple[str, ...] = EXPECTED_TABLES) -> DataFrame:
    """Expected tables or views that the catalog does not list."""
    listed = [(t.name,) for t in spark.catalog.listTables()]
    have = spark.createDataFrame(listed, "table_name string")
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    return want.join(have, "table_name", "left_anti")


def saved_columns(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, column_name, saved_type) that the session catalog has for a database."""
    listed = [
        (t.name, c.name, c.dataType)
        for t in spark.catalog.listTables(database)
        if t.tableType != "TEMPORARY"
        for c in spark.catalog.listColumns(f"`{database}`.`{t.name}`")
    ]
    return spark.createDataFrame(listed, "table_name string, column_name string, saved_type string")


def _filled(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, rows, filled) of a table's columns from one pass over it."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(df.columns)]
    return counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells)))


def catalog_diff(spark: SparkSession, database: str, declared: Mapping[str, str]) -> DataFrame:
    """(table_name, column_name, declared_type, saved_type, state, rows, filled) of declared and saved columns.

    ``declared`` has the columns of each expected table, as ``sources.schemas`` states them. A column is ok, missing (its table may be), of another type,
    or undeclared. Saved tables tell their rows and how many of them fill the column.
    """
    want = spark.createDataFrame(
        [(t, name, kind) for t, declaration in declared.items() for name, kind in columns(declaration)],
        "table_name string, column_name string, declared_type string",
    )
    have = saved_columns(spark, database)
    names = [t.name for t in spark.catalog.listTables(database) if t.tableType != "TEMPORARY"]
    counts = [_filled(spark.table(f"`{database}`.`{n}`"), n) for n in names]
    none = spark.createDataFrame([], "table_name string, column_name string, rows bigint, filled bigint")
    counted = have.join(reduce(DataFrame.unionByName, counts, none), ["table_name", "column_name"])
    state = (
        F.when(F.col("saved_type").isNull(), "missing")
        .when(F.col("declared_type").isNull(), "undeclared")
        .when(F.col("declared_type") != F.col("saved_type"), "type")
        .otherwise("ok")
    )
    joined = want.join(counted, ["table_name", "column_name"], "full")
    return joined.select("table_name", "column_name", "declared_type", "saved_type", state.alias("state"), "rows", "filled")


def _count_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def inventory(tables: Mapping[str, DataFrame], expected: tuple[str, ...] = EXPECTED_TABLES) -> DataFrame:
    """Every expected table with its row count, or marked as missing."""
    spark = next(iter(tables.values())).sparkSession
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    return want.join(_count_rows(tables), "table_name", "left").withColumn("missing", F.col("rows").isNull())


def row_floors(tables: Mapping[str, DataFrame], floors: Mapping[str, int] = ROW_FLOORS) -> DataFrame:
    floor: Column = F.lit(None)
    for name, low in floors.items():
        floor = F.when(F.col("table_name") == name, low).otherwise(floor)
    counted = _count_rows({n: tables[n] for n in floors})
    return counted.withColumn("floor", floor.cast("bigint")).withColumn("ok", F.col("rows") >= F.col("floor"))


def preview(tables: Mapping[str, DataFrame], rows: int = 3) -> DataFrame:
    """The first rows of each model by key. Each preview is a top-k, not a sort of the table."""
    parts = []
    for name, (key, columns) in PREVIEW.items():
        detail = F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])
        parts.append(
            tables[name]
            .select(F.lit(name).alias("model"), F.col(key).alias("key"), detail.alias("detail"))
            .orderBy(F.col("key").asc_nulls_last(), "detail")
            .limit(rows)
            .withColumn("key", F.col("key").cast("string"))
        )
    return reduce(DataFrame.unionByName, parts)
