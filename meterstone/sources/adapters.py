"""Raw tables derived from the star-schema parquet files.

Every rule is a column expression, so the raw tables stay lazy scans: filters and column pruning reach the parquet
files. The two lookups (nation, first order per customer) are left joins on unique keys, which Catalyst drops when the
looked-up column is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared types: opening a table reads no file footer and starts no job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _tag(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _every(key: Column, step: int, rest: int = 0) -> Column:
    return key % step == rest


def _pick(key: Column, values: list[str | None]) -> Column:
    """values[key mod len(values)] as a CASE expression."""
    step = len(values)
    expr = F.when(_every(key, step, 0), F.lit(values[0]))
    for rest, value in enumerate(values[1:], 1):
        expr = expr.when(_every(key, step, rest), F.lit(value))
    return expr


def _day_text(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("first_order"))
    )
    nation = (
        table(spark, sf_dir, "nation")
        .groupBy(F.col("n_nationkey").alias("c_nationkey"))
        .agg(F.min("n_name").alias("n_name"))
    )
    key = F.col("c_custkey")
    balance = F.col("c_acctbal")
    segment = F.col("c_mktsegment")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey", "left")
        .join(first_order, "c_custkey", "left")
        .select(
            F.when(_every(key, 37), F.lit(None))
            .when(_every(key, 101, 50), _tag("U", key - 1))
            .otherwise(_tag("U", key))
            .alias("user_id"),
            F.when(_every(key, 47), F.lit(None))
            .when(_every(key, 43), F.lit("not-an-email"))
            .otherwise(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com ")))
            .alias("email"),
            F.when(_every(key, 97), F.lit("2999-01-01")).otherwise(_day_text(F.col("first_order"))).alias("signup_date"),
            _pick(key, ["free", "Starter ", "PRO", "enterprise", "legacy_growth", None]).alias("plan"),
            F.when(segment == "AUTOMOBILE", "paid_search")
            .when(segment == "BUILDING", "SEO")
            .when(segment == "FURNITURE", "Referral")
            .when(segment == "HOUSEHOLD", "email")
            .alias("acquisition_channel"),
            F.when(~_every(key, 53), F.lower("n_name")).alias("country"),
            F.when(balance < 0, F.lit(None))
            .when(balance < 3000, "1-10")
            .when(balance < 7000, "11-50")
            .otherwise("51+")
            .alias("company_size"),
        )
    )


def raw_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events of both sources; ``events`` stands for some of the files of that table."""
    priority = F.substring("o_orderpriority", 1, 1)
    okey = F.col("o_orderkey")
    from_orders = table(spark, sf_dir, "orders").select(
        _tag("O", okey).alias("event_id"),
        F.when(~_every(okey, 71), _tag("U", F.col("o_custkey"))).alias("user_id"),
        F.when(priority == "1", "page_view")
        .when(priority == "2", " Feature_Used")
        .when(priority == "3", "api_call")
        .when(priority == "4", "login")
        .otherwise("legacy_click")
        .alias("event_type"),
        F.col("o_orderdate").cast("string").alias("event_timestamp"),
        _tag("S", okey % 97).alias("session_id"),
        F.lit(None).cast("string").alias("properties"),
    )
    kind = F.col("event_type")
    ekey = F.col("event_id")
    events = table(spark, sf_dir, "events") if events is None else events
    from_events = events.select(
        _tag("E", ekey).alias("event_id"),
        _tag("U", F.col("user_id")).alias("user_id"),
        F.when(kind == "view", "page_view")
        .when(kind == "click", "feature_used")
        .when(kind == "purchase", "export")
        .when(kind == "signup", "login")
        .when(kind == "error", "settings_change")
        .alias("event_type"),
        F.col("ts").cast("string").alias("event_timestamp"),
        _tag("S", ekey % 97).alias("session_id"),
        F.col("props").alias("properties"),
    )
    return from_orders.unionByName(from_events)


def raw_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    amount = F.when(_every(key, 5), 0.0).otherwise((key % 997).cast("double") / 4.0)
    return table(spark, sf_dir, "orders").select(
        _tag("S", key).alias("subscription_id"),
        _tag("U", F.col("o_custkey")).alias("user_id"),
        _pick(key, ["free", "Starter", "pro ", "Enterprise", "legacy_growth"]).alias("plan"),
        F.when(_every(key, 61, 1), -amount).otherwise(amount).alias("mrr_usd"),
        _day_text(F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("o_orderstatus") == "O", "")
        .when(_every(key, 59), "n/a")
        .when(_every(key, 67), F.lit(None))
        .otherwise(F.date_add(F.to_date("o_orderdate"), (key % 300 + 30).cast("int")).cast("string"))
        .alias("ended_at"),
        F.when(_every(key, 3), " Annual").otherwise("monthly").alias("billing_interval"),
    )


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderkey").alias("l_orderkey"))
        .agg(F.min("o_custkey").alias("o_custkey"))
    )
    line = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    price = F.col("l_extendedprice")
    negative = ((flag == "A") & _every(line, 2)) | ((flag == "R") & _every(line, 2, 1))
    return (
        table(spark, sf_dir, "lineitem")
        .join(owner, "l_orderkey", "left")
        .select(
            F.concat(F.lit("P"), F.col("l_orderkey"), F.lit("-"), line).alias("payment_id"),
            _tag("U", F.col("o_custkey")).alias("user_id"),
            _tag("S", F.col("l_orderkey")).alias("subscription_id"),
            F.when(negative, -price).otherwise(price).alias("amount_usd"),
            F.when(line == 7, "EUR").when(line == 6, " usd").otherwise("USD").alias("currency"),
            F.when(~_every(F.col("l_partkey"), 89), flag == "R").alias("refund_flag"),
            _day_text(F.col("l_shipdate")).alias("payment_date"),
            F.when(F.col("l_linestatus") == "O", " Card").otherwise("PayPal").alias("payment_method"),
        )
    )
