"""The certified metrics and the rules of the governed layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SLICE_DIMENSIONS = ("plan", "country", "acquisition_channel")


@dataclass(frozen=True)
class Metric:
    name: str
    aliases: tuple[str, ...]
    source: str
    columns: tuple[str, ...]
    time_column: str
    grains: tuple[str, ...]
    dimensions: tuple[str, ...]
    examples: tuple[str, ...]


# Metric names, aliases and example questions decide which metric a question resolves to.
METRICS = (
    Metric(
        "daily_active_users",
        ("DAU", "dau", "active users", "daily actives"),
        "mart_user_metrics",
        ("daily_active_users",),
        "metric_date",
        ("day", "week", "month"),
        SLICE_DIMENSIONS,
        (
            "What was DAU last week?",
            "Show me daily active users for the US in November",
            "How has DAU trended over the past 30 days for Pro users?",
        ),
    ),
    Metric(
        "monthly_active_users",
        ("MAU", "mau", "monthly actives"),
        "mart_user_metrics",
        ("monthly_active_users",),
        "event_month",
        ("month",),
        SLICE_DIMENSIONS,
        (
            "What was MAU last month?",
            "Show monthly active users by country for Q3",
            "Compare MAU between Pro and Starter plans",
        ),
    ),
    Metric(
        "thirty_day_retention_rate",
        ("30-day retention", "retention rate", "day 30 retention", "d30 retention"),
        "mart_funnel_analysis",
        ("signups", "day30_retained", "day30_retention_rate_pct"),
        "cohort_month",
        ("month",),
        (*SLICE_DIMENSIONS, "cohort_month"),
        (
            "What's 30-day retention for the Jan 2023 cohort?",
            "Show retention rate for EU users on Pro plan",
            "How does retention differ between paid search and organic channels?",
            "What's 30-day retention for the EU cohort, adjusted for refunds?",
        ),
    ),
    Metric(
        "monthly_recurring_revenue",
        ("MRR", "mrr", "recurring revenue", "revenue"),
        "mart_revenue_metrics",
        ("mrr", "arr", "paying_customers"),
        "metric_month",
        ("month",),
        SLICE_DIMENSIONS,
        (
            "What was MRR last month?",
            "Show MRR trend for Enterprise plan",
            "What's MRR by country for Q4?",
            "How does MRR compare between monthly and annual billing?",
        ),
    ),
    Metric(
        "customer_lifetime_value",
        ("LTV", "ltv", "lifetime value", "CLV", "clv", "ltv to cac", "ltv:cac", "ltv cac ratio", "ltv cac"),
        "mart_revenue_metrics",
        ("estimated_ltv", "estimated_cac", "ltv_to_cac_ratio"),
        "metric_month",
        ("month",),
        SLICE_DIMENSIONS,
        (
            "What's the estimated LTV for Pro plan users?",
            "Show LTV by acquisition channel",
            "What's the LTV:CAC ratio for each plan?",
        ),
    ),
    Metric(
        "churn_rate",
        ("churn", "churn rate", "monthly churn", "cancellation rate"),
        "mart_revenue_metrics",
        ("churn_rate_pct", "churned_customers", "paying_customers"),
        "metric_month",
        ("month",),
        ("plan", "country"),
        (
            "What was churn rate last quarter?",
            "Show monthly churn by plan",
            "Which country has the highest churn rate?",
        ),
    ),
)
METRIC_NAMES = tuple(m.name for m in METRICS)

# Protected columns and the message of a refused question.
PII_COLUMNS = ("email", "name", "company_name", "phone", "address")
REJECTION_MESSAGE = (
    "I can only answer questions about these certified metrics: "
    + ", ".join(METRIC_NAMES)
    + ". Your question references data or metrics outside the governed layer."
)


def metric(name: str) -> Metric:
    for m in METRICS:
        if m.name == name:
            return m
    raise KeyError(name)


def aliases() -> list[tuple[str, str]]:
    """(lowercased alias, metric) in lookup order; a metric's own name comes before its aliases."""
    found: dict[str, str] = {}
    for m in METRICS:
        for alias in (m.name, *m.aliases):
            found.setdefault(alias.lower(), m.name)
    return list(found.items())


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(i, alias, name) for i, (alias, name) in enumerate(aliases())]
    return spark.createDataFrame(rows, "position bigint, alias string, metric string")


def is_protected(column: str) -> bool:
    return column.lower() in PII_COLUMNS
