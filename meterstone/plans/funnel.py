"""Signup-to-retention funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.config import DEFAULTS, Settings
from meterstone.functions.numeric import round_to, share
from meterstone.functions.text import month_start

SLICE = ("cohort_month", "plan", "country", "acquisition_channel")
# The windows that the mart was first written with: activity on the signup day itself.
SAME_DAY = (0, 0)


def _within(days: tuple[int, int]) -> Column:
    lo, hi = days
    return F.col("event_date").between(F.date_add("signup_date", lo), F.date_add("signup_date", hi))


def _activity_after_signup(users: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct active user-days next to the user's signup dates."""
    days = (
        events.where(F.col("user_id").isNotNull() & F.col("is_activity_event"))
        .select("user_id", "event_date")
        .distinct()
    )
    signups = users.where(F.col("user_id").isNotNull()).select("user_id", "signup_date").distinct()
    return days.join(signups, "user_id")


def users_active_within(users: DataFrame, events: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Users with governed activity in a window of days after signup."""
    return _activity_after_signup(users, events).where(_within(days)).select("user_id").distinct()


def paying_users(payments: DataFrame) -> DataFrame:
    clean = (F.col("net_amount_usd") > 0) & ~F.col("is_suspected_dirty") & F.col("is_usd")
    return payments.where(clean).select("user_id").distinct()


def user_funnel(
    users: DataFrame,
    events: DataFrame,
    payments: DataFrame,
    activation: tuple[int, int] = DEFAULTS.activation_days,
    retained: tuple[int, int] = DEFAULTS.retained_days,
) -> DataFrame:
    """Stage flags per user row. Both activity windows come from one join and one pass."""
    flags = (
        _activity_after_signup(users, events)
        .groupBy("user_id")
        .agg(F.max(_within(activation)).alias("activated"), F.max(_within(retained)).alias("retained"))
    )
    paid = paying_users(payments).withColumn("paid", F.lit(True))
    no = F.lit(False)
    return (
        users.where(F.col("user_id").isNotNull())
        .join(flags, "user_id", "left")
        .join(paid, "user_id", "left")
        .select(
            "user_id",
            month_start(F.col("signup_date")).alias("cohort_month"),
            "plan",
            "country",
            "acquisition_channel",
            "signup_date",
            F.lit(True).alias("reached_signup"),
            F.coalesce("activated", no).alias("reached_activation"),
            F.coalesce("paid", no).alias("reached_conversion"),
            F.coalesce("retained", no).alias("reached_day30_retention"),
        )
    )


def funnel_analysis(
    users: DataFrame,
    events: DataFrame,
    payments: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    as_written: bool = False,
) -> DataFrame:
    activation = SAME_DAY if as_written else settings.activation_days
    retained = SAME_DAY if as_written else settings.retained_days

    def reached(stage: str) -> Column:
        return F.sum(F.when(F.col(f"reached_{stage}"), 1))  # NULL, not 0, when nobody did

    volumes = (
        user_funnel(users, events, payments, activation, retained)
        .groupBy(*SLICE)
        .agg(
            F.count("*").alias("signups"),
            reached("activation").alias("activations"),
            reached("conversion").alias("conversions"),
            reached("day30_retention").alias("day30_retained"),
        )
    )

    def rate(part: str, whole: str) -> Column:
        return round_to(share(F.col(part), F.col(whole)))

    return volumes.withColumns(
        {
            "activation_rate_pct": rate("activations", "signups"),
            "signup_to_paid_rate_pct": rate("conversions", "signups"),
            "day30_retention_rate_pct": rate("day30_retained", "signups"),
            "activation_to_paid_rate_pct": rate("conversions", "activations"),
            "paid_to_retained_rate_pct": rate("day30_retained", "conversions"),
        }
    )
