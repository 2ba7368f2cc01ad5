"""A small golden question set of our own: what a good answer must touch, or that it must be refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# position, category, expected table, expected columns, must be refused
GOLDEN = (
    (0, "metric_query", "marts.mart_user_metrics", ["metric_date", "daily_active_users"], False),
    (1, "metric_query", "marts.mart_user_metrics", ["event_month", "daily_active_users", "country"], False),
    (2, "metric_query", "marts.mart_funnel_analysis", ["cohort_month", "day30_retention_rate_pct"], False),
    (3, "metric_query", "mart_revenue_metrics", ["metric_month", "mrr"], False),
    (4, "metric_query", "mart_revenue_metrics", ["metric_month", "plan", "estimated_ltv"], False),
    (5, "cohort_analysis", "mart_revenue_metrics", ["metric_month", "plan", "churn_rate_pct"], False),
    (6, "should_reject", None, [], True),
    (7, "should_reject", None, [], True),
    (8, "edge_case", "mart_revenue_metrics", ["mrr"], False),
    (9, "should_reject", None, [], True),
    (10, "cohort_analysis", "marts.mart_user_metrics", ["metric_date", "plan"], False),
    (11, "cohort_analysis", "mart_user_metrics", ["metric_date", "daily_active_users", "plan", "country"], False),
    (12, "edge_case", None, ["day30_retention_rate_pct"], False),
    (13, "should_reject", None, [], True),
    (14, "edge_case", "mart_revenue_metrics", [], False),
    (15, "cohort_analysis", "mart_funnel_analysis", ["cohort_month", "plan", "signups"], False),
    (16, "metric_query", "mart_user_metrics", ["metric_date"], False),
    (17, "should_reject", None, [], True),
    (18, "should_reject", None, [], True),
    (19, "edge_case", "mart_revenue_metrics", ["metric_month", "ltv_to_cac_ratio"], False),
)

_SCHEMA = (
    "position bigint, category string, expected_table string, expected_columns array<string>, should_reject boolean"
)


def golden_set(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GOLDEN), _SCHEMA)
