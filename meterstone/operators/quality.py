"""Data tests: a test passes when no row violates it (or no more than its threshold)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.config import CHANNELS, DEFAULTS, EVENT_TYPES, PLANS, Settings

ERROR, WARN = "error", "warn"


@dataclass(frozen=True)
class Rule:
    test: str
    table: str
    column: str
    values: tuple[str, ...] = ()
    severity: str = ERROR
    threshold: int = 0


def _not_null(table: str, columns: str) -> list[Rule]:
    return [Rule("not_null", table, c) for c in columns.split()]


def _accepted(table: str, column: str, values: tuple[str, ...]) -> Rule:
    return Rule("accepted_values", table, column, values, WARN)


STAGING_RULES = (
    *_not_null("stg_users", "user_id email signup_date plan country"),
    *_not_null("stg_events", "event_id event_type event_timestamp is_activity_event"),
    *_not_null("stg_subscriptions", "subscription_id user_id mrr_usd is_active"),
    *_not_null("stg_payments", "payment_id user_id net_amount_usd"),
    Rule("unique", "stg_users", "user_id"),
    Rule("unique", "stg_users", "email"),
    Rule("unique", "stg_events", "event_id"),
    Rule("unique", "stg_subscriptions", "subscription_id"),
    Rule("unique", "stg_payments", "payment_id"),
    _accepted("stg_users", "plan", PLANS),
    _accepted("stg_users", "acquisition_channel", CHANNELS),
    _accepted("stg_events", "event_type", EVENT_TYPES),
    _accepted("stg_subscriptions", "plan", PLANS),
    Rule("refund_consistency", "stg_payments", "amount_usd"),
    Rule("no_future_signups", "stg_users", "signup_date"),
)
MART_RULES = (
    *_not_null("mart_user_metrics", "metric_date daily_active_users plan"),
    *_not_null("mart_cohort_retention", "cohort_month retention_period cohort_size retained_users"),
    *_not_null("mart_revenue_metrics", "metric_month mrr arr"),
    *_not_null("mart_funnel_analysis", "cohort_month signups"),
    _accepted("mart_user_metrics", "plan", PLANS),
)
RULES = (*STAGING_RULES, *MART_RULES)

# Reasons and issue labels.
REFUND_REASON = "negative_amount_without_refund_flag"
FUTURE_REASON = "signup_date_in_future"


def outside(column: str, values: Sequence[str]) -> Column:
    """NULL passes, as in SQL NOT IN."""
    return ~F.col(column).isin(*values)


def refund_violation() -> Column:
    return (F.col("amount_usd") < 0) & ~F.col("is_refund") & F.col("is_suspected_dirty")


def future_signup(settings: Settings) -> Column:
    return F.col("signup_date") > F.lit(settings.as_of)


def _row_condition(rule: Rule, settings: Settings) -> Column | None:
    """The rule as a condition on one row, or None where it needs a group."""
    if rule.test == "not_null":
        return F.col(rule.column).isNull()
    if rule.test == "accepted_values":
        return outside(rule.column, rule.values)
    if rule.test == "refund_consistency":
        return refund_violation()
    if rule.test == "no_future_signups":
        return future_signup(settings)
    return None


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, occurrences) of values that occur more than once: one grouped count for all columns of a table.

    NULLs are not counted; values are given as text.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(cells)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("occurrences"))
    return counted.where("occurrences > 1")


def _repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column occur more than once."""
    return duplicates(df, columns).agg(*[F.count_if(F.col("column_name") == c).alias(f"n{i}") for i, c in enumerate(columns)])


def _row(rule: Rule, failures: Column) -> Column:
    return F.struct(
        F.lit(rule.test).alias("test"),
        F.lit(rule.table).alias("table_name"),
        F.lit(rule.column).alias("column_name"),
        F.coalesce(failures, F.lit(0)).cast("bigint").alias("failures"),
        F.lit(rule.severity).alias("severity"),
        F.when(F.coalesce(failures, F.lit(0)) <= rule.threshold, "pass")
        .otherwise("fail" if rule.severity == ERROR else "warn")
        .alias("status"),
    )


def run_rules(
    tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per rule. All row rules of a table share one scan, all unique rules one grouped count.

    A column's accepted values count violating rows here; ``unaccepted_values`` lists the values.
    """
    parts: list[DataFrame] = []
    for table in dict.fromkeys(r.table for r in rules):
        df = tables[table]
        own = [r for r in rules if r.table == table]
        by_row = [(r, _row_condition(r, settings)) for r in own]
        by_row = [(r, c) for r, c in by_row if c is not None]
        if by_row:
            counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(by_row)])
            cells = F.array(*[_row(r, F.col(f"n{i}")) for i, (r, _) in enumerate(by_row)])
            parts.append(counts.select(F.inline(cells)))
        unique = [r for r in own if r.test == "unique"]
        if unique:
            n = _repeated(df, [r.column for r in unique])
            parts.append(n.select(F.inline(F.array(*[_row(r, F.col(f"n{i}")) for i, r in enumerate(unique)]))))
    return reduce(DataFrame.unionByName, parts)


def null_counts(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    own = [r for r in rules if r.test == "not_null"]
    return run_rules(tables, own).select("table_name", "column_name", "failures")


def unaccepted_values(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Values outside their list, with row counts."""
    parts = [
        tables[r.table]
        .where(outside(r.column, r.values))
        .groupBy(F.col(r.column).alias("value"))
        .agg(F.count("*").alias("rows"))
        .select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), "value", "rows")
        for r in rules
        if r.test == "accepted_values"
    ]
    return reduce(DataFrame.unionByName, parts)


def repeated_values(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Values of unique columns that occur more than once, from one scan and one shuffle of each table."""
    columns: dict[str, list[str]] = {}
    for r in rules:
        if r.test == "unique":
            columns.setdefault(r.table, []).append(r.column)
    parts = [duplicates(tables[t], own).select(F.lit(t).alias("table_name"), "column_name", "value", "occurrences") for t, own in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def refund_consistency(payments: DataFrame) -> DataFrame:
    return payments.where(refund_violation()).select(
        "payment_id",
        "user_id",
        "amount_usd",
        "currency",
        "is_refund",
        "payment_date",
        F.lit(REFUND_REASON).alias("failure_reason"),
    )


def future_signups(users: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return users.where(future_signup(settings)).select(
        "user_id",
        "email",
        "signup_date",
        F.lit(settings.as_of).alias("today"),
        F.lit(FUTURE_REASON).alias("failure_reason"),
    )


def negative_mrr(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where(F.col("mrr_usd") < 0).select("subscription_id", "user_id", "plan", "mrr_usd")


def dirty_data_summary(
    users: DataFrame, events: DataFrame, payments: DataFrame, subscriptions: DataFrame
) -> DataFrame:
    """Five labelled counts, one scan per table."""

    def labelled(df: DataFrame, **conditions: Column) -> DataFrame:
        counts = df.agg(*[F.count_if(c).alias(label) for label, c in conditions.items()])
        cells = [F.struct(F.lit(label).alias("issue"), F.col(label).alias("rows")) for label in conditions]
        return counts.select(F.inline(F.array(*cells)))

    parts = [
        labelled(users, null_user_ids=F.col("user_id").isNull()),
        labelled(events, legacy_event_types=outside("event_type", EVENT_TYPES)),
        labelled(payments, negative_without_refund=F.col("is_suspected_dirty"), non_usd_payments=~F.col("is_usd")),
        labelled(subscriptions, negative_mrr=F.col("mrr_usd") < 0),
    ]
    return reduce(DataFrame.unionByName, parts)


def activity_governance(events: DataFrame) -> DataFrame:
    """Which event types count as activity, governed ones first."""
    return (
        events.groupBy("event_type", "is_activity_event")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.col("is_activity_event").desc_nulls_last(), F.col("event_count").desc(), "event_type")
    )
