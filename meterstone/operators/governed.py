"""Certified metrics behind a validated request: only listed dimensions, grains and filters reach Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.numeric import exact_avg, exact_sum, round_to, share
from meterstone.plans import user_metrics
from meterstone.plans.warehouse import Warehouse
from meterstone.sources.catalog import METRIC_NAMES, REJECTION_MESSAGE, is_protected, metric

DEFAULT_LIMIT = 100

Filter = tuple[str, str, object]


class GovernanceError(ValueError):
    """The request leaves the governed layer."""


_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
}


def _kept(mart: DataFrame, keep: Column | None) -> DataFrame:
    """Mart rows that pass the filters, before anything is grouped."""
    return mart if keep is None else mart.where(keep)


def daily_active(w: Warehouse, dims: Sequence[str], grain: str, keep: Column | None = None) -> DataFrame:
    out = user_metrics.active_users_by(w.users, w.events, grain, tuple(dims), keep)
    return out.withColumnsRenamed({"period": "metric_date", "active_users": "daily_active_users"})


def monthly_active(w: Warehouse, dims: Sequence[str], grain: str = "month", keep: Column | None = None) -> DataFrame:
    out = user_metrics.active_users_by(w.users, w.events, "month", tuple(dims), keep)
    return out.withColumnsRenamed({"period": "event_month", "active_users": "monthly_active_users"})


def monthly_active_as_written(daily: DataFrame) -> DataFrame:
    """The catalog's template: daily counts summed over the month. It counts a user once per active day."""
    return daily.groupBy("event_month", "plan", "country").agg(
        F.sum("daily_active_users").alias("monthly_active_users")
    )


def retention30(w: Warehouse, dims: Sequence[str], grain: str = "month", keep: Column | None = None) -> DataFrame:
    """Numerator and denominator are summed first, then divided."""
    keys = list(dict.fromkeys(["cohort_month", *dims]))
    return (
        _kept(w.funnel_analysis, keep).groupBy(*keys)
        .agg(F.sum("signups").alias("signups"), F.sum("day30_retained").alias("day30_retained"))
        .withColumn("day30_retention_rate_pct", round_to(share(F.col("day30_retained"), F.col("signups"))))
    )


def recurring_revenue(w: Warehouse, dims: Sequence[str], grain: str = "month", keep: Column | None = None) -> DataFrame:
    return _kept(w.revenue_metrics, keep).groupBy("metric_month", *dims).agg(
        exact_sum(F.col("mrr")).alias("mrr"),
        exact_sum(F.col("arr")).alias("arr"),
        F.sum("paying_customers").alias("paying_customers"),
    )


def lifetime_value(w: Warehouse, dims: Sequence[str], grain: str = "month", keep: Column | None = None) -> DataFrame:
    """Plain average of the mart's slice estimates, which carry no weights; slices without churn have none."""
    return _kept(w.revenue_metrics, keep).groupBy("metric_month", *dims).agg(
        *[exact_avg(F.col(c)).alias(c) for c in ("estimated_ltv", "estimated_cac", "ltv_to_cac_ratio")]
    )


def churn_rate(w: Warehouse, dims: Sequence[str], grain: str = "month", keep: Column | None = None) -> DataFrame:
    """Churn repeats over the channels of a slice in the mart, so it is taken once per month, plan and country."""
    per_slice = _kept(w.revenue_metrics, keep).groupBy("metric_month", "plan", "country").agg(
        F.max("churned_customers").alias("churned_customers"), F.sum("paying_customers").alias("paying_customers")
    )
    return (
        per_slice.groupBy("metric_month", *dims)
        .agg(F.sum("churned_customers").alias("churned_customers"), F.sum("paying_customers").alias("paying_customers"))
        .withColumn("churn_rate_pct", round_to(share(F.col("churned_customers"), F.col("paying_customers"))))
    )


_BUILDERS = {
    "daily_active_users": daily_active,
    "monthly_active_users": monthly_active,
    "thirty_day_retention_rate": retention30,
    "monthly_recurring_revenue": recurring_revenue,
    "customer_lifetime_value": lifetime_value,
    "churn_rate": churn_rate,
}


def _validate(name: str, dims: Sequence[str], grain: str | None, where: Sequence[Filter]) -> None:
    if name not in METRIC_NAMES:
        raise GovernanceError(REJECTION_MESSAGE)
    m = metric(name)
    for column in [*dims, *[c for c, _, _ in where]]:
        if column == "*":
            raise GovernanceError("name the columns: a star selection is not allowed")
        if is_protected(column):
            raise GovernanceError(f"{column} is a protected column")
    for column in dims:
        if column not in m.dimensions:
            raise GovernanceError(f"{name} has no dimension {column}")
    for column, op, _ in where:
        if column != m.time_column and column not in m.dimensions:
            raise GovernanceError(f"{name} has no filter on {column}")
        if op not in _OPERATORS:
            raise GovernanceError(f"unknown comparison {op}")
    if grain is not None and grain not in m.grains:
        raise GovernanceError(f"{name} has no grain {grain}")


def query_metric(
    w: Warehouse,
    name: str,
    dims: Sequence[str] = (),
    *,
    grain: str | None = None,
    where: Sequence[Filter] = (),
    order_by: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """One certified metric by allowed dimensions, newest period first unless ``order_by`` names a column.

    Filters on dimensions, whether or not they are among ``dims``, choose the rows that are counted; filters on the period
    choose the periods shown. A NULL dimension passes no filter.
    """
    _validate(name, dims, grain, where)
    m = metric(name)
    rows = [_OPERATORS[op](F.col(column), value) for column, op, value in where if column != m.time_column]
    out = _BUILDERS[name](w, list(dict.fromkeys(dims)), grain or m.grains[0], reduce(and_, rows) if rows else None)
    for column, op, value in where:
        if column == m.time_column:
            out = out.where(_OPERATORS[op](F.col(column), value))
    kept = list(dict.fromkeys([m.time_column, *dims]))
    if order_by is not None and order_by not in (*kept, *m.columns):
        raise GovernanceError(f"cannot order by {order_by}")
    first = F.col(order_by or m.time_column).desc_nulls_last()
    rest = [F.col(c).asc_nulls_last() for c in kept if c != (order_by or m.time_column)]
    return out.select(*kept, *m.columns).orderBy(first, *rest).limit(limit)


def ratio_vs_average(funnel: DataFrame) -> DataFrame:
    """The summed ratio next to the plain average of slice rates, per cohort month."""
    return (
        funnel.groupBy("cohort_month")
        .agg(
            F.sum("day30_retained").alias("retained"),
            F.sum("signups").alias("signups"),
            round_to(exact_avg(F.col("day30_retention_rate_pct")), 4).alias("avg_of_rates_pct"),
        )
        .select(
            "cohort_month",
            "signups",
            round_to(share(F.col("retained"), F.col("signups")), 4).alias("ratio_of_sums_pct"),
            "avg_of_rates_pct",
        )
    )
