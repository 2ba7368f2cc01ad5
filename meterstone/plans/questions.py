"""The question shapes that business users ask, over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.numeric import exact_avg, exact_sum, round_to, share
from meterstone.operators import governed
from meterstone.plans.warehouse import Warehouse


def last_period(w: Warehouse) -> DataFrame:
    """Revenue of the latest month in the data, not of the wall clock."""
    return governed.recurring_revenue(w, ()).orderBy(F.col("metric_month").desc()).limit(1)


def last_quarter(w: Warehouse) -> DataFrame:
    """Churn of the months in the latest quarter. The window runs over one row per month."""
    monthly = governed.churn_rate(w, ())
    quarter = F.trunc("metric_month", "quarter")
    return (
        monthly.withColumn("latest", F.max(quarter).over(W.partitionBy()))
        .where(quarter == F.col("latest"))
        .drop("latest")
    )


def filtered(w: Warehouse, plan: str, country: str, year: int) -> DataFrame:
    return (
        w.revenue_metrics.where(
            (F.col("plan") == plan) & (F.col("country") == country) & (F.year("metric_month") == year)
        )
        .groupBy("metric_month")
        .agg(exact_sum(F.col("mrr")).alias("mrr"), F.sum("paying_customers").alias("paying_customers"))
    )


def by_channel(w: Warehouse) -> DataFrame:
    """Activation and conversion by acquisition channel from summed stages."""
    return (
        w.funnel_analysis.groupBy("acquisition_channel")
        .agg(*[F.sum(c).alias(c) for c in ("signups", "activations", "conversions")])
        .withColumns(
            {
                "activation_rate_pct": round_to(share(F.col("activations"), F.col("signups"))),
                "signup_to_paid_rate_pct": round_to(share(F.col("conversions"), F.col("signups"))),
            }
        )
    )


def mrr_trend(w: Warehouse) -> DataFrame:
    """Monthly revenue with growth over the previous listed month."""
    ordered = W.orderBy("metric_month")
    before = F.lag("mrr").over(ordered)
    return (
        w.revenue_metrics.groupBy("metric_month")
        .agg(exact_sum(F.col("mrr")).alias("mrr"))
        .withColumn("previous_mrr", before)
        .withColumn("growth_pct", round_to(share(F.col("mrr") - F.col("previous_mrr"), F.col("previous_mrr"))))
    )


def compare_plans(w: Warehouse, plans: tuple[str, ...] = ("pro", "enterprise")) -> DataFrame:
    wide = (
        w.revenue_metrics.where(F.col("plan").isin(*plans))
        .groupBy("metric_month")
        .pivot("plan", list(plans))
        .agg(exact_sum(F.col("mrr")))
    )
    return wide.withColumnsRenamed({p: f"mrr_{p}" for p in plans})


def top_countries(w: Warehouse, k: int = 5) -> DataFrame:
    return (
        w.revenue_metrics.groupBy("country")
        .agg(exact_sum(F.col("mrr")).alias("mrr"))
        .orderBy(F.col("mrr").desc(), F.col("country"))
        .limit(k)
    )


def best_plan(w: Warehouse) -> DataFrame:
    return (
        w.revenue_metrics.groupBy("plan")
        .agg(exact_avg(F.col("ltv_to_cac_ratio")).alias("ltv_to_cac_ratio"))
        .orderBy(F.col("ltv_to_cac_ratio").desc_nulls_last(), F.col("plan"))
        .limit(1)
    )


def growth_health(w: Warehouse) -> DataFrame:
    """Revenue growth, LTV:CAC and signups side by side per month."""
    ratio = w.revenue_metrics.groupBy("metric_month").agg(
        exact_avg(F.col("ltv_to_cac_ratio")).alias("ltv_to_cac_ratio")
    )
    signups = w.funnel_analysis.groupBy(F.col("cohort_month").alias("metric_month")).agg(
        F.sum("signups").alias("signups")
    )
    return (
        mrr_trend(w)
        .select("metric_month", "mrr", "growth_pct")
        .join(ratio, "metric_month")
        .join(signups, "metric_month", "left")
    )


def region_retention(w: Warehouse, region: str) -> DataFrame:
    """Day-30 retention of the cohorts of one region's countries. Activity decides, so refunds do not change it."""
    countries = (
        w.table("nation")
        .join(w.table("region").where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.upper("n_name").alias("country"))
    )
    return (
        w.funnel_analysis.join(countries, "country", "left_semi")
        .groupBy("cohort_month")
        .agg(F.sum("signups").alias("signups"), F.sum("day30_retained").alias("day30_retained"))
        .withColumn("day30_retention_rate_pct", round_to(share(F.col("day30_retained"), F.col("signups"))))
    )


def last_signups(w: Warehouse) -> DataFrame:
    """Signups of the latest cohort month that is not in the future."""
    return (
        w.funnel_analysis.where(F.col("cohort_month") <= F.lit(w.settings.as_of))
        .groupBy("cohort_month")
        .agg(F.sum("signups").alias("signups"))
        .orderBy(F.col("cohort_month").desc())
        .limit(1)
    )
