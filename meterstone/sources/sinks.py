"""Written tables: marts, the anomaly feed and the audit log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from meterstone.session import new_scratch


def write_mart(df: DataFrame, path: str, month_column: str) -> None:
    """Full refresh, one folder per month, so that readers prune by month.

    The rebalance hint lets adaptive execution size the files and split a month that is much larger than the others.
    """
    df.hint("rebalance", month_column).write.mode("overwrite").partitionBy(month_column).parquet(path)


def read_mart(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read with the mart's own schema: partition values keep their type, nothing is inferred."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def append(df: DataFrame, path: str) -> None:
    """One distributed append instead of an insert per row."""
    df.write.mode("append").parquet(path)


def save_tables(spark: SparkSession, database: str, frames: Mapping[str, DataFrame]) -> None:
    """Written tables that the session catalog lists under ``database``, with the types they were written with."""
    spark.sql(f"create database if not exists `{database}`")
    for name, df in frames.items():
        df.write.option("path", new_scratch(spark, name)).mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
