"""Queries for data tests, inventory and sources."""

import uuid

from pyspark.sql import functions as F

from meterstone.checks.ctes import listed, quoted
from meterstone.checks.registry import stored_check as check
from meterstone.config import DEFAULTS
from meterstone.operators import inventory, quality
from meterstone.session import new_scratch
from meterstone.sources import csv_tables, schemas, sinks

_CTE = {
    "stg_users": "{users}",
    "stg_events": "{stg_events}",
    "stg_subscriptions": "{subs}",
    "stg_payments": "{payments}",
    "mart_user_metrics": "{mart_users}",
    "mart_cohort_retention": "{mart_retention}",
    "mart_revenue_metrics": "{mart_revenue}",
    "mart_funnel_analysis": "{mart_funnel}",
    "raw_users": "{raw_users}",
    "raw_events": "{raw_events}",
    "raw_subscriptions": "{raw_subscriptions}",
    "raw_payments": "{raw_payments}",
}
_TODAY = f"date '{DEFAULTS.as_of}'"


def _all_tables(w):
    return {**w.staging_views, **w.marts}


def _failures_sql(rule) -> str:
    src, col = _CTE[rule.table], rule.column
    if rule.test == "not_null":
        return f"select count(*) - count({col}) from {src}"
    if rule.test == "unique":
        return f"select count(*) from (select {col} from {src} where {col} is not null group by {col} having count(*) > 1)"
    if rule.test == "accepted_values":
        return f"select count(*) from {src} where {col} not in ({listed(rule.values)})"
    if rule.test == "refund_consistency":
        return f"select count(*) from {src} where amount_usd < 0 and is_refund = false and is_suspected_dirty"
    return f"select count(*) from {src} where signup_date > {_TODAY}"


def _report_sql(rules) -> str:
    return "\nunion all\n".join(
        f"select {quoted(r.test)} as test, {quoted(r.table)} as table_name, {quoted(r.column)} as column_name, "
        f"({_failures_sql(r)}) as failures, {quoted(r.severity)} as severity"
        for r in rules
    )


@check(
    "dq_not_null",
    f"select table_name, column_name, failures from ({_report_sql([r for r in quality.RULES if r.test == 'not_null'])})",
)
def _(w):
    return quality.null_counts(_all_tables(w))


@check(
    "dq_unique",
    "\nunion all\n".join(
        f"select {quoted(r.table)} as table_name, {quoted(r.column)} as column_name, {r.column} as value, "
        f"count(*) as occurrences from {_CTE[r.table]} where {r.column} is not null group by {r.column} having count(*) > 1"
        for r in quality.RULES
        if r.test == "unique"
    ),
)
def _(w):
    return quality.repeated_values(w.staging_views)


@check(
    "dq_accepted_values",
    "\nunion all\n".join(
        f"select {quoted(r.table)} as table_name, {quoted(r.column)} as column_name, {r.column} as value, "
        f"count(*) as rows from {_CTE[r.table]} where {r.column} not in ({listed(r.values)}) group by {r.column}"
        for r in quality.RULES
        if r.test == "accepted_values"
    ),
)
def _(w):
    return quality.unaccepted_values(_all_tables(w))


@check(
    "dq_refund_consistency",
    "select payment_id, user_id, cast(amount_usd as double) as amount_usd, currency, is_refund, payment_date, "
    f"{quoted(quality.REFUND_REASON)} as failure_reason from {{payments}} "
    "where amount_usd < 0 and is_refund = false and is_suspected_dirty",
)
def _(w):
    return quality.refund_consistency(w.payments)


@check(
    "dq_future_signups",
    f"select user_id, email, signup_date, {_TODAY} as today, {quoted(quality.FUTURE_REASON)} as failure_reason "
    f"from {{users}} where signup_date > {_TODAY}",
)
def _(w):
    return quality.future_signups(w.users)


@check(
    "dq_negative_mrr",
    "select subscription_id, user_id, plan, cast(mrr_usd as double) as mrr_usd from {subs} where mrr_usd < 0",
)
def _(w):
    return quality.negative_mrr(w.subscriptions)


@check(
    "dq_summary",
    f"""select 'null_user_ids' as issue, (select count(*) from {{raw_users}} where user_id is null) as rows
union all select 'legacy_event_types', (select count(*) from {{stg_events}}
  where event_type not in ({listed(quality.EVENT_TYPES)}))
union all select 'negative_without_refund', (select count(*) from {{payments}} where is_suspected_dirty = true)
union all select 'non_usd_payments', (select count(*) from {{payments}} where is_usd = false)
union all select 'negative_mrr', (select count(*) from {{subs}} where mrr_usd < 0)""",
)
def _(w):
    return quality.dirty_data_summary(w.users, w.events, w.payments, w.subscriptions)


@check(
    "dq_activity_governance",
    "select event_type, is_activity_event, count(*) as event_count from {stg_events} group by all",
)
def _(w):
    return quality.activity_governance(w.events)


@check(
    "dq_report",
    "select *, case when failures = 0 then 'pass' when severity = 'error' then 'fail' else 'warn' end as status "
    f"from ({_report_sql(quality.RULES)})",
)
def _(w):
    return quality.run_rules(_all_tables(w))


def _floor_sql(name: str, low: int) -> str:
    return (
        f"select {quoted(name)} as table_name, (select count(*) from {_CTE[name]}) as rows, "
        f"cast({low} as bigint) as floor, (select count(*) from {_CTE[name]}) >= {low} as ok"
    )


_RAW = ("raw_users", "raw_events", "raw_subscriptions", "raw_payments")


def _raw_and_staging(w):
    raw = {n: w.raw(n) for n in _RAW}
    return {**raw, **w.staging_views}


@check("dq_row_floor", "\nunion all\n".join(_floor_sql(n, low) for n, low in inventory.ROW_FLOORS.items()))
def _(w):
    return inventory.row_floors(_raw_and_staging(w))


@check(
    "inventory_rows",
    "\nunion all\n".join(
        f"select {quoted(n)} as table_name, (select count(*) from {_CTE[n]}) as rows, false as missing"
        for n in inventory.EXPECTED_TABLES
    ),
)
def _(w):
    return inventory.inventory({**_raw_and_staging(w), **w.marts})


# A catalog in which two models were never saved, one lacks a column, one has a column of another type and one has a column
# that nobody declared.
_ABSENT = ("stg_payments", "mart_funnel_analysis")
_LOST, _OTHER, _NEW = ("mart_user_metrics", "dau"), ("stg_users", "signup_date"), ("mart_cohort_retention", "lost_pct")


# Where the shared table expressions name a column otherwise.
_SQL_NAMES = {"monthly_twelfths": "twelfths"}


def _diff_sql(table: str) -> str:
    parts = []
    for name, kind in schemas.columns(schemas.MODELS[table]):
        at = (table, name)
        saved = "null" if table in _ABSENT or at == _LOST else quoted("string" if at == _OTHER else kind)
        state = "missing" if saved == "null" else "type" if at == _OTHER else "ok"
        rows, filled = ("null", "null") if saved == "null" else ("count(*)", f"count({_SQL_NAMES.get(name, name)})")
        source = "" if saved == "null" else f" from {_CTE[table]}"
        parts.append(f"select {quoted(table)}, {quoted(name)}, {quoted(kind)}, {saved}, {quoted(state)}, {rows}, {filled}{source}")
    return "\nunion all\n".join(parts)


@check(
    "catalog_diff",
    "select table_name, column_name, declared_type, saved_type, state, cast(rows as bigint) as rows, cast(filled as bigint) as filled from (\n"
    + "\nunion all\n".join(_diff_sql(t) for t in schemas.MODELS)
    + f"\nunion all select {quoted(_NEW[0])}, {quoted(_NEW[1])}, null, 'double', 'undeclared', count(*), count(retention_rate_pct) from {_CTE[_NEW[0]]}\n"
    ") as t(table_name, column_name, declared_type, saved_type, state, rows, filled)",
)
def _(w):
    tables = {n: df for n, df in _all_tables(w).items() if n not in _ABSENT}
    tables[_LOST[0]] = tables[_LOST[0]].drop(_LOST[1])
    tables[_OTHER[0]] = tables[_OTHER[0]].withColumn(_OTHER[1], F.col(_OTHER[1]).cast("string"))
    tables[_NEW[0]] = tables[_NEW[0]].withColumn(_NEW[1], 100 - F.col("retention_rate_pct"))
    database = f"meterstone_{uuid.uuid4().hex}"
    sinks.save_tables(w.spark, database, tables)
    diff = inventory.catalog_diff(w.spark, database, schemas.MODELS)
    # The result has read the catalog and knows the files, so the names can go.
    diff.schema  # noqa: B018
    w.spark.sql(f"drop database `{database}` cascade")
    return diff


@check(
    "preview_rows",
    "\nunion all\n".join(
        f"select model, cast(key as varchar) as key, detail from ("
        f"select {quoted(n)} as model, {key} as key, concat_ws(' | ', {', '.join(cols)}) as detail "
        f"from {_CTE[n]} order by key nulls last, detail limit 3)"
        for n, (key, cols) in inventory.PREVIEW.items()
    ),
)
def _(w):
    return inventory.preview({**w.staging_views, **w.marts})


@check("src_csv_roundtrip", "from {raw_subscriptions}")
def _(w):
    path = new_scratch(w.spark, "raw_subscriptions_csv")
    csv_tables.write_csv(w.raw("raw_subscriptions"), path)
    return csv_tables.read_raw_csv(w.spark, path, "raw_subscriptions")


@check("src_csv_users", "from {raw_users}")
def _(w):
    path = new_scratch(w.spark, "raw_users_csv")
    csv_tables.write_csv(w.raw("raw_users"), path)
    return csv_tables.read_raw_csv(w.spark, path, "raw_users")


@check("mart_materialize", "from {mart_revenue}")
def _(w):
    path = new_scratch(w.spark, "mart_revenue_metrics")
    sinks.write_mart(w.revenue_metrics, path, "metric_month")
    return sinks.read_mart(w.spark, path, w.revenue_metrics)
