"""Report tables. Order is applied by the reader: storage order carries no meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.functions.numeric import exact_avg, exact_sum
from meterstone.sources.csv_tables import write_csv

MAX_PERIOD = 12


def mrr_trend(revenue: DataFrame) -> DataFrame:
    """Per month and plan: summed amounts and plain averages of the slice rates."""
    return (
        revenue.where(F.col("mrr") > 0)
        .groupBy("metric_month", "plan")
        .agg(
            exact_sum(F.col("mrr")).alias("mrr"),
            exact_sum(F.col("arr")).alias("arr"),
            F.sum("paying_customers").alias("paying_customers"),
            *[exact_avg(F.col(c)).alias(c) for c in ("churn_rate_pct", "estimated_ltv", "ltv_to_cac_ratio")],
        )
    )


def cohort_retention(retention: DataFrame) -> DataFrame:
    return retention.where(F.col("retention_period") <= MAX_PERIOD).drop("churned_users")


def funnel_analysis(funnel: DataFrame) -> DataFrame:
    return funnel.where(F.col("signups") > 0).drop("activation_to_paid_rate_pct", "paid_to_retained_rate_pct")


def dau_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("metric_date", "plan", "country", "acquisition_channel").agg(
        F.sum("daily_active_users").alias("dau"), F.sum("new_user_activations").alias("new_activations")
    )


def write_exports(marts: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the four reports as CSV folders and return their paths."""
    reports = {
        "mrr_trend": mrr_trend(marts["mart_revenue_metrics"]),
        "cohort_retention": cohort_retention(marts["mart_cohort_retention"]),
        "funnel_analysis": funnel_analysis(marts["mart_funnel_analysis"]),
        "dau_trend": dau_trend(marts["mart_user_metrics"]),
    }
    paths = {}
    for name, df in reports.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        write_csv(df, paths[name])
    return paths
