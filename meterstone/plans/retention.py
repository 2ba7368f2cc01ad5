"""Monthly cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.functions.numeric import round_to, share
from meterstone.functions.text import month_number, month_start

SLICE = ("cohort_month", "plan", "country")
HEATMAP_PERIODS = 12


def user_cohorts(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_id").isNotNull()).select(
        "user_id", month_start(F.col("signup_date")).alias("cohort_month"), "plan", "country"
    )


def user_active_months(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("user_id").isNotNull() & F.col("is_activity_event"))
        .select("user_id", F.col("event_month").alias("active_month"))
        .distinct()
    )


def cohort_sizes(users: DataFrame) -> DataFrame:
    return (
        user_cohorts(users)
        .select(*SLICE, "user_id")
        .distinct()
        .groupBy(*SLICE)
        .agg(F.count("*").alias("cohort_size"))
    )


def cohort_activity(users: DataFrame, events: DataFrame) -> DataFrame:
    """User-months on or after the signup month, numbered from it."""
    return (
        user_cohorts(users)
        .distinct()
        .join(user_active_months(events), "user_id")
        .where(F.col("active_month") >= F.col("cohort_month"))
        .withColumn(
            "retention_period", month_number(F.col("active_month")) - month_number(F.col("cohort_month"))
        )
    )


def cohort_retention(users: DataFrame, events: DataFrame) -> DataFrame:
    retained = (
        cohort_activity(users, events)
        .select(*SLICE, "retention_period", "user_id")
        .distinct()
        .groupBy(*SLICE, "retention_period")
        .agg(F.count("*").alias("retained_users"))
    )
    # Plain equality on purpose: a slice without a country has no rate.
    return retained.join(cohort_sizes(users), list(SLICE)).select(
        "cohort_month",
        "retention_period",
        "plan",
        "country",
        "cohort_size",
        "retained_users",
        round_to(share(F.col("retained_users"), F.col("cohort_size"))).alias("retention_rate_pct"),
        (F.col("cohort_size") - F.col("retained_users")).alias("churned_users"),
    )


def retention_heatmap(retention: DataFrame, periods: int = HEATMAP_PERIODS) -> DataFrame:
    """Cohort rows by period columns; the listed periods make the pivot one pass."""
    wide = (
        retention.groupBy("cohort_month")
        .pivot("retention_period", list(range(periods + 1)))
        .agg(F.sum("retained_users"))
    )
    return wide.select("cohort_month", *[F.col(str(p)).alias(f"period_{p}") for p in range(periods + 1)])
