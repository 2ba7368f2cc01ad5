"""Typed CSV scan and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from meterstone.sources.schemas import RAW_TABLES

# NULL is written as an unquoted \N, so that an empty text ("still active") stays an empty text.
_NULL_MARK = "\\N"


def read_raw_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan one raw table with its declared types; rows that do not fit raise."""
    return read_csv(spark, path, RAW_TABLES[table])


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Scan what ``write_csv`` wrote."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("nullValue", _NULL_MARK)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True)
        .option("nullValue", _NULL_MARK)
        .option("emptyValue", '""')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
