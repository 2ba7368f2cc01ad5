"""Per-request columns and reports over a query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.text import collapse_spaces
from meterstone.operators import admission

# Limits, prices and grades.
RESULT_CAP = 500
RESPONSE_CAP = 50
CACHE_TTL_SECONDS = 3600
CALLS_PER_WINDOW = 20
CALL_WINDOW_SECONDS = 3600
LARGE_RESULT = 200
INPUT_MICRO_USD = 3
OUTPUT_MICRO_USD = 15
EVAL_MICRO_USD = 5


def fingerprint(sql: Column) -> Column:
    """Hash of the statement without case and spacing."""
    return F.md5(collapse_spaces(sql))


def confidence(log_has_error: Column, row_count: Column, retries: Column) -> Column:
    rows = F.coalesce(row_count, F.lit(0))
    return (
        F.when(log_has_error | (rows == 0), "low")
        .when((F.coalesce(retries, F.lit(0)) > 0) | (rows > LARGE_RESULT), "medium")
        .otherwise("high")
    )


def has_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def with_confidence(log: DataFrame) -> DataFrame:
    return log.withColumn("confidence", confidence(has_error(), F.col("row_count"), F.col("retries")))


def cost_micro_usd() -> Column:
    """Cost of a request in millionths of a dollar: whole numbers add up exactly."""
    return F.col("input_tokens") * INPUT_MICRO_USD + F.col("output_tokens") * OUTPUT_MICRO_USD


def rounded_cost_usd() -> Column:
    """Cost rounded to five decimals."""
    return F.floor((cost_micro_usd() + 5) / F.lit(10)).cast("double") / 100_000.0


def token_cost(log: DataFrame) -> DataFrame:
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return log.select(
        "request_id",
        tokens.alias("total_tokens"),
        rounded_cost_usd().alias("estimated_cost"),
        (tokens * EVAL_MICRO_USD / F.lit(1_000_000.0)).alias("eval_cost"),
    )


def cap(df: DataFrame, order: list[Column], rows: int = RESULT_CAP) -> DataFrame:
    """The first rows of a result with its true size; a top-k next to a count, no full sort."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(rows).withColumns({"row_count": total, "truncated": total > rows})


def returned_rows(log: DataFrame) -> DataFrame:
    """What each logged request kept and what its response carried."""
    rows = F.coalesce("row_count", F.lit(0))
    return log.select(
        "request_id",
        rows.alias("row_count"),
        F.least(rows, F.lit(RESULT_CAP)).alias("kept_rows"),
        F.least(rows, F.lit(RESPONSE_CAP)).alias("response_rows"),
        (rows > RESULT_CAP).alias("truncated"),
    )


def ttl_hits(log: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Which requests a result store with a time to live would have answered.

    A run stores its result unless it failed; a hit does not prolong the stored result. A failed request did run, so it
    is never a hit.
    """
    fp = fingerprint(F.col("sql"))
    runs = admission.decide(
        log.where(~has_error()),
        key=fp,
        ts=F.col("started_at"),
        id=F.col("request_id"),
        limit=1,
        window_seconds=ttl_seconds,
    ).select("id", "key", "ts", (~F.col("admitted")).alias("hit"))
    failed = log.where(has_error()).select(
        F.col("request_id").alias("id"), fp.alias("key"), F.col("started_at").alias("ts"), F.lit(False).alias("hit")
    )
    return runs.unionByName(failed).withColumnsRenamed(
        {"id": "request_id", "key": "fingerprint", "ts": "started_at"}
    )


def throttle(
    log: DataFrame,
    key: Column,
    limit: int = CALLS_PER_WINDOW,
    window_seconds: int = CALL_WINDOW_SECONDS,
) -> DataFrame:
    """Accepted and refused calls per key; a refused call does not use up quota."""
    out = admission.decide(
        log,
        key=key,
        ts=F.col("started_at"),
        id=F.col("request_id"),
        limit=limit,
        window_seconds=window_seconds,
    )
    return out.withColumnsRenamed({"id": "request_id", "key": "throttle_key", "ts": "started_at"})
