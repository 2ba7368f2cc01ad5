"""Queries for staging, marts and exports."""

from pyspark.sql import functions as F

from meterstone.checks.ctes import dsum
from meterstone.checks.registry import ORACLES, QUERIES, check, stored_check
from meterstone.plans import exports, funnel, retention, revenue, user_metrics
from meterstone.plans.monthly import MonthlyUserMetrics
from meterstone.session import new_scratch
from meterstone.sources import csv_tables

_USER_COLUMNS = "user_id, email, signup_date, plan, acquisition_channel, country, company_size"


@check("stg_users", f"select {_USER_COLUMNS} from {{users}}")
def _(w):
    return w.users


@check("stg_events", "from {stg_events}")
def _(w):
    return w.events


@check(
    "stg_subscriptions",
    "select * exclude (twelfths) replace (cast(mrr_usd as double) as mrr_usd, cast(plan_tier as bigint) as plan_tier) "
    "from {subs}",
)
def _(w):
    return w.subscriptions.drop("monthly_twelfths")


@check(
    "stg_payments",
    "select * replace (cast(amount_usd as double) as amount_usd, cast(net_amount_usd as double) as net_amount_usd) "
    "from {payments}",
)
def _(w):
    return w.payments


@check("mart_user_metrics", "from {mart_users}")
def _(w):
    return w.user_metrics


@check("mart_user_metrics_monthly", "from {mart_users}")
def _(w):
    """The mart after two arrivals of event files: the second one builds the months that it holds again, and no others."""
    events, arriving = w.table("events"), f"{new_scratch(w.spark, 'arriving')}/events.parquet"
    layer = MonthlyUserMetrics(w, arriving)
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        events.where(part).write.mode("append").parquet(arriving)
        layer.refresh()
    return layer.user_metrics


@check(
    "daily_active_spine",
    """select cast(d as date) as metric_date,
  (select count(distinct user_id) from {active} a where a.event_date = cast(d as date)) as daily_active_users
from (select unnest(generate_series(min(event_date), max(event_date), interval 1 day)) as d from {stg_events})""",
)
def _(w):
    return user_metrics.daily_active_spine(w.events)


def _rolling_sql(days: int) -> str:
    return f"""select d.metric_date, count(distinct a.user_id) as active_users
from (
  select cast(unnest(generate_series(min(event_date), max(event_date), interval 1 day)) as date) as metric_date
  from {{stg_events}}
) d left join {{active}} a on a.event_date between d.metric_date - {days - 1} and d.metric_date
group by all"""


@check("rolling_wau", _rolling_sql(7))
def _(w):
    return user_metrics.rolling_active(w.events, 7)


@check("rolling_mau", _rolling_sql(30))
def _(w):
    return user_metrics.rolling_active(w.events, 30)


@check("user_active_months", "select distinct user_id, event_month as active_month from {active}")
def _(w):
    return retention.user_active_months(w.events)


@check(
    "cohort_sizes",
    "select signup_month as cohort_month, plan, country, count(distinct user_id) as cohort_size "
    "from {users} where user_id is not null group by all",
)
def _(w):
    return retention.cohort_sizes(w.users)


@check("mart_cohort_retention", "from {mart_retention}")
def _(w):
    return w.cohort_retention


@check(
    "retention_heatmap",
    "select cohort_month, "
    + ", ".join(
        f"cast(sum(retained_users) filter (where retention_period = {p}) as bigint) as period_{p}" for p in range(13)
    )
    + " from {mart_retention} group by cohort_month",
)
def _(w):
    return retention.retention_heatmap(w.cohort_retention)


@check(
    "active_subs_monthly",
    "select metric_month, subscription_id, user_id, plan, monthly_recurring_revenue, country, acquisition_channel "
    "from {sub_months}",
)
def _(w):
    return revenue.active_subs_monthly(w.users, w.subscriptions, w.calendar)


@check("mrr_monthly", "from {mrr}")
def _(w):
    return revenue.mrr_monthly(w.plan_steps, w.calendar)


@check(
    "churned_users",
    "select metric_month, user_id, plan, country, cast(sum(twelfths) as double) / 12.0 as churned_mrr "
    "from {churned} group by all",
)
def _(w):
    return revenue.churned_users(w.plan_steps, w.calendar).drop("twelfths")


@check("churned_monthly", "from {churn}")
def _(w):
    return revenue.churned_monthly(w.plan_steps, w.calendar)


@check("payments_monthly", "from {pay_month}")
def _(w):
    return revenue.payments_monthly(w.payments)


@check("cac_by_channel", "from {cac}")
def _(w):
    return revenue.cac_by_channel(w.users)


@check("mart_revenue_metrics", "from {mart_revenue}")
def _(w):
    return w.revenue_metrics


@check("funnel_activation", "from {activated}")
def _(w):
    return funnel.users_active_within(w.users, w.events, w.settings.activation_days)


@check("funnel_conversion", "from {converted}")
def _(w):
    return funnel.paying_users(w.payments)


@check("funnel_day30", "from {retained}")
def _(w):
    return funnel.users_active_within(w.users, w.events, w.settings.retained_days)


@check("user_funnel", "from {user_funnel}")
def _(w):
    return funnel.user_funnel(w.users, w.events, w.payments)


@check("mart_funnel_analysis", "from {mart_funnel}")
def _(w):
    return w.funnel_analysis


@check("mart_funnel_as_written", "from {mart_funnel_same_day}")
def _(w):
    return funnel.funnel_analysis(w.users, w.events, w.payments, as_written=True)


def _davg(column: str) -> str:
    return f"{dsum(column)} / nullif(count({column}), 0)"


@stored_check(
    "export_mrr_trend",
    f"""select metric_month, plan, {dsum("mrr")} as mrr, {dsum("arr")} as arr,
  cast(sum(paying_customers) as bigint) as paying_customers,
  {_davg("churn_rate_pct")} as churn_rate_pct, {_davg("estimated_ltv")} as estimated_ltv,
  {_davg("ltv_to_cac_ratio")} as ltv_to_cac_ratio
from {{mart_revenue}} where mrr > 0 group by all""",
)
def _(w):
    return exports.mrr_trend(w.revenue_metrics)


@stored_check("export_cohort_retention", "select * exclude (churned_users) from {mart_retention} where retention_period <= 12")
def _(w):
    return exports.cohort_retention(w.cohort_retention)


@stored_check(
    "export_funnel",
    "select * exclude (activation_to_paid_rate_pct, paid_to_retained_rate_pct) from {mart_funnel} where signups > 0",
)
def _(w):
    return exports.funnel_analysis(w.funnel_analysis)


@stored_check(
    "export_dau_trend",
    "select metric_date, plan, country, acquisition_channel, cast(sum(daily_active_users) as bigint) as dau, "
    "cast(sum(new_user_activations) as bigint) as new_activations from {mart_users} group by all",
)
def _(w):
    return exports.dau_trend(w.user_metrics)




def _written(name: str) -> None:
    """The export once more, through the CSV files that are its real form."""

    @stored_check(f"export_csv_{name}")
    def _(w):
        report = QUERIES[f"export_{name}"](w.spark, w.sf_dir)
        path = new_scratch(w.spark, f"export-{name}")
        csv_tables.write_csv(report, path)
        return csv_tables.read_csv(w.spark, path, report.schema)

    ORACLES[f"export_csv_{name}"] = ORACLES[f"export_{name}"]


for _name in ("mrr_trend", "cohort_retention", "funnel", "dau_trend"):
    _written(_name)
