"""Declared column types of the raw tables and of the models; nothing is inferred."""

import re

# Names, types and order of the raw columns.
RAW_USERS = (
    "user_id string, email string, signup_date string, plan string, acquisition_channel string, country string, "
    "company_size string"
)
RAW_EVENTS = (
    "event_id string, user_id string, event_type string, event_timestamp string, session_id string, properties string"
)
RAW_SUBSCRIPTIONS = (
    "subscription_id string, user_id string, plan string, mrr_usd double, started_at string, ended_at string, "
    "billing_interval string"
)
RAW_PAYMENTS = (
    "payment_id string, user_id string, subscription_id string, amount_usd double, currency string, refund_flag boolean, "
    "payment_date string, payment_method string"
)

RAW_TABLES = {
    "raw_users": RAW_USERS,
    "raw_events": RAW_EVENTS,
    "raw_subscriptions": RAW_SUBSCRIPTIONS,
    "raw_payments": RAW_PAYMENTS,
}

#: Declared columns of staging and marts, as the saved tables must have them.
MODELS = {
    "stg_users": (
        "user_id string, email string, signup_date date, plan string, acquisition_channel string, country string, "
        "company_size string"
    ),
    "stg_events": (
        "event_id string, user_id string, event_type string, event_timestamp timestamp_ntz, event_date date, "
        "event_week date, event_month date, session_id string, is_activity_event boolean"
    ),
    "stg_subscriptions": (
        "subscription_id string, user_id string, plan string, plan_tier int, mrr_usd decimal(10,2), started_at date, "
        "ended_at date, is_active boolean, billing_interval string, monthly_recurring_revenue double, "
        "monthly_twelfths decimal(14,2)"
    ),
    "stg_payments": (
        "payment_id string, user_id string, subscription_id string, amount_usd decimal(10,2), currency string, "
        "is_usd boolean, is_refund boolean, payment_date date, payment_month date, payment_week date, "
        "payment_method string, net_amount_usd decimal(10,2), is_suspected_dirty boolean"
    ),
    "mart_user_metrics": (
        "metric_date date, event_week date, event_month date, plan string, country string, acquisition_channel string, "
        "daily_active_users bigint, new_user_activations bigint, total_events bigint, dau bigint"
    ),
    "mart_cohort_retention": (
        "cohort_month date, retention_period int, plan string, country string, cohort_size bigint, "
        "retained_users bigint, retention_rate_pct double, churned_users bigint"
    ),
    "mart_revenue_metrics": (
        "metric_month date, plan string, country string, acquisition_channel string, paying_customers bigint, "
        "mrr double, arr double, arpu double, churned_customers bigint, churned_mrr double, churn_rate_pct double, "
        "estimated_cac double, estimated_ltv double, ltv_to_cac_ratio double, net_revenue double, "
        "dirty_payment_rows bigint"
    ),
    "mart_funnel_analysis": (
        "cohort_month date, plan string, country string, acquisition_channel string, signups bigint, "
        "activations bigint, conversions bigint, day30_retained bigint, activation_rate_pct double, "
        "signup_to_paid_rate_pct double, day30_retention_rate_pct double, activation_to_paid_rate_pct double, "
        "paid_to_retained_rate_pct double"
    ),
}


def columns(declared: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a declaration."""
    return re.findall(r"(\w+) (\w+(?:\([^)]*\))?)", declared)
