"""Staging: cast, normalise and flag. No row is filtered; problems are reported by the data tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.config import DEFAULTS, Settings
from meterstone.functions.text import month_start, tidy, tidy_or, week_start

MONEY = "decimal(10,2)"
# Sums of twelfths stay exact, see ``monthly_twelfths``.
TWELFTHS = "decimal(14,2)"

PLAN_TIERS = ("free", "starter", "pro", "enterprise")


def with_lineage(df: DataFrame, source: str) -> DataFrame:
    """Load stamp and source tag; left out of checked results because the stamp is the wall clock."""
    return df.withColumns({"_loaded_at": F.localtimestamp(), "_source": F.lit(source)})


def stg_users(raw: DataFrame) -> DataFrame:
    channel = tidy_or(F.col("acquisition_channel"), "unknown")
    return raw.select(
        "user_id",
        tidy(F.col("email")).alias("email"),
        F.col("signup_date").cast("date").alias("signup_date"),
        tidy_or(F.col("plan"), "unknown").alias("plan"),
        F.when(channel == "seo", "organic").otherwise(channel).alias("acquisition_channel"),
        F.upper(F.trim("country")).alias("country"),
        F.coalesce("company_size", F.lit("unknown")).alias("company_size"),
    )


def stg_events(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    kind = tidy(F.col("event_type"))
    stamp = F.col("event_timestamp").cast("timestamp_ntz")
    day = F.to_date(stamp)
    return raw.select(
        "event_id",
        "user_id",
        kind.alias("event_type"),
        stamp.alias("event_timestamp"),
        day.alias("event_date"),
        week_start(day).alias("event_week"),
        month_start(day).alias("event_month"),
        "session_id",
        kind.isin(*settings.activity_event_types).alias("is_activity_event"),
    )


def stg_subscriptions(raw: DataFrame) -> DataFrame:
    plan = tidy(F.col("plan"))
    tier = F.lit(-1)
    for rank, name in enumerate(PLAN_TIERS):
        tier = F.when(plan == name, rank).otherwise(tier)
    ended = F.col("ended_at")
    open_ended = ended.isNull() | (ended == "")
    amount = F.col("mrr_usd").cast(MONEY)
    interval = tidy(F.col("billing_interval"))
    annual = F.coalesce(interval == "annual", F.lit(False))
    twelfths = F.when(annual, amount.cast(TWELFTHS)).otherwise((amount * 12).cast(TWELFTHS))
    return raw.select(
        "subscription_id",
        "user_id",
        F.coalesce(plan, F.lit("unknown")).alias("plan"),
        tier.alias("plan_tier"),
        amount.alias("mrr_usd"),
        F.col("started_at").cast("date").alias("started_at"),
        F.when(~open_ended, ended).try_cast("date").alias("ended_at"),
        open_ended.alias("is_active"),
        interval.alias("billing_interval"),
        F.when(annual, amount.cast("double") / 12.0)
        .otherwise(amount.cast("double"))
        .alias("monthly_recurring_revenue"),
        # The same value times twelve as a decimal: sums of it are exact in any order.
        twelfths.alias("monthly_twelfths"),
    )


def stg_payments(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    amount = F.col("amount_usd").cast(MONEY)
    refund = F.col("refund_flag").cast("boolean")
    day = F.col("payment_date").cast("date")
    return raw.select(
        "payment_id",
        "user_id",
        "subscription_id",
        amount.alias("amount_usd"),
        F.upper(F.trim("currency")).alias("currency"),
        (F.col("currency") == settings.currency).alias("is_usd"),
        refund.alias("is_refund"),
        day.alias("payment_date"),
        month_start(day).alias("payment_month"),
        week_start(day).alias("payment_week"),
        tidy(F.col("payment_method")).alias("payment_method"),
        F.when(refund, -F.abs(amount)).otherwise(amount).cast(MONEY).alias("net_amount_usd"),
        ((amount < 0) & ~refund).alias("is_suspected_dirty"),
    )
