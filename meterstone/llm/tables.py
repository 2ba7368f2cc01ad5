"""Reading the tables, and helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.session import new_scratch

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns never clash with names of the table."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary array; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    array = pc.fill_null(array.cast(kind), b"")
    width = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=width, count=len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``most`` bytes each, but one row at least."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in files by hashed key, so that joins by the key move none of its rows again."""
    spark = df.sparkSession
    name, parts = f"meterstone_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).option("path", new_scratch(spark, "buckets")).saveAsTable(name)
    out = spark.table(name)
    # Only the name goes: the frame knows its files and buckets.
    spark.sql(f"drop table {name}")
    return out
