"""Queries for certified metrics, governed requests and question shapes."""

import datetime as dt

from pyspark.sql import functions as F

from meterstone.checks.ctes import dsum, r2
from meterstone.checks.registry import stored_check as check
from meterstone.operators import governed
from meterstone.plans import questions, revenue

_ACTIVE_WITH_USER = "{active} a left join {users} u on u.user_id = a.user_id"


@check(
    "metric_dau",
    "select event_date as metric_date, plan, country, acquisition_channel, "
    f"count(distinct a.user_id) as daily_active_users from {_ACTIVE_WITH_USER} group by all",
)
def _(w):
    return governed.daily_active(w, ("plan", "country", "acquisition_channel"), "day")


@check(
    "metric_dau_week",
    "select event_week as metric_date, plan, count(distinct a.user_id) as daily_active_users "
    f"from {_ACTIVE_WITH_USER} group by all",
)
def _(w):
    return governed.daily_active(w, ("plan",), "week")


@check(
    "metric_mau",
    "select event_month, plan, country, count(distinct a.user_id) as monthly_active_users "
    f"from {_ACTIVE_WITH_USER} group by all",
)
def _(w):
    return governed.monthly_active(w, ("plan", "country"))


@check(
    "metric_mau_as_written",
    "select event_month, plan, country, cast(sum(daily_active_users) as bigint) as monthly_active_users "
    "from {mart_users} group by all",
)
def _(w):
    return governed.monthly_active_as_written(w.user_metrics)


_RETENTION = f"""cast(sum(signups) as bigint) as signups, cast(sum(day30_retained) as bigint) as day30_retained,
  {r2("100.0 * sum(day30_retained) / sum(signups)")} as day30_retention_rate_pct"""


@check("metric_retention30", f"select cohort_month, plan, {_RETENTION} from {{mart_funnel}} group by all")
def _(w):
    return governed.retention30(w, ("plan",))


_MRR = f"""{dsum("mrr")} as mrr, {dsum("arr")} as arr, cast(sum(paying_customers) as bigint) as paying_customers"""


@check("metric_mrr", f"select metric_month, plan, {_MRR} from {{mart_revenue}} group by all")
def _(w):
    return governed.recurring_revenue(w, ("plan",))


@check(
    "metric_ltv",
    "select metric_month, plan, country, acquisition_channel, estimated_ltv, estimated_cac, ltv_to_cac_ratio "
    "from {mart_revenue}",
)
def _(w):
    return w.revenue_metrics.select(
        "metric_month", "plan", "country", "acquisition_channel", "estimated_ltv", "estimated_cac", "ltv_to_cac_ratio"
    )


def _churn_sql(dims: str) -> str:
    return f"""
select metric_month, {dims} cast(sum(churned) as bigint) as churned_customers,
  cast(sum(paying) as bigint) as paying_customers, {r2("100.0 * sum(churned) / sum(paying)")} as churn_rate_pct
from (
  select metric_month, plan, country, max(churned_customers) as churned, sum(paying_customers) as paying
  from {{mart_revenue}} group by all
) group by all"""


@check("metric_churn", _churn_sql("plan,"))
def _(w):
    return governed.churn_rate(w, ("plan",))


@check(
    "metric_churn_start_of_month",
    f"""select metric_month, customers_at_start, churned_customers,
  {r2("100.0 * churned_customers / customers_at_start")} as churn_rate_pct
from (
  select c.m as metric_month, count(distinct b.user_id) as customers_at_start,
    count(distinct b.user_id) filter (where b.user_id not in (
      select n.user_id from {{sub_months}} n where n.metric_month = c.m and n.user_id is not null)) as churned_customers
  from {{calendar}} c join {{sub_months}} b on b.metric_month + interval 1 month = c.m
  group by all
)""",
)
def _(w):
    return revenue.churn_start_of_month(w.subscriptions, w.calendar)


@check(
    "governed_query_dau_by_plan",
    f"""select event_week as metric_date, plan, count(distinct a.user_id) as daily_active_users
from {_ACTIVE_WITH_USER} where country = 'NATION_3' group by all
order by metric_date desc, plan limit 100""",
)
def _(w):
    return governed.query_metric(
        w, "daily_active_users", ["plan"], grain="week", where=[("country", "=", "NATION_3")]
    )


@check(
    "governed_query_mau_by_channel",
    f"""select event_month, acquisition_channel, count(distinct a.user_id) as monthly_active_users
from {_ACTIVE_WITH_USER} where event_month >= date '1999-01-01' group by all
order by event_month desc, acquisition_channel nulls last limit 100""",
)
def _(w):
    return governed.query_metric(
        w, "monthly_active_users", ["acquisition_channel"], where=[("event_month", ">=", dt.date(1999, 1, 1))]
    )


@check(
    "governed_query_mrr_by_country",
    f"""select metric_month, country, {_MRR} from {{mart_revenue}}
where metric_month between date '1998-01-01' and date '1998-03-31' group by all
order by mrr desc, metric_month, country limit 100""",
)
def _(w):
    return governed.query_metric(
        w,
        "monthly_recurring_revenue",
        ["country"],
        where=[("metric_month", ">=", dt.date(1998, 1, 1)), ("metric_month", "<=", dt.date(1998, 3, 31))],
        order_by="mrr",
    )


@check(
    "governed_query_retention_by_channel",
    f"""select cohort_month, acquisition_channel, {_RETENTION} from {{mart_funnel}}
where acquisition_channel in ('paid_search', 'organic') group by all
order by cohort_month desc nulls last, acquisition_channel limit 100""",
)
def _(w):
    return governed.query_metric(
        w,
        "thirty_day_retention_rate",
        ["acquisition_channel"],
        where=[("acquisition_channel", "in", ("paid_search", "organic"))],
    )


@check(
    "governed_filter_in",
    f"""select event_month, count(distinct a.user_id) as monthly_active_users
from {_ACTIVE_WITH_USER} where plan in ('pro', 'starter') group by all order by event_month desc limit 100""",
)
def _(w):
    """A user who is counted under two plans' rows stays one user."""
    return governed.query_metric(w, "monthly_active_users", where=[("plan", "in", ("pro", "starter"))])


@check(
    "governed_filter_not",
    f"""select metric_month, country, {_MRR} from {{mart_revenue}} where plan != 'free' group by all
order by metric_month desc, country nulls last limit 100""",
)
def _(w):
    return governed.query_metric(w, "monthly_recurring_revenue", ["country"], where=[("plan", "!=", "free")])


@check(
    "governed_filter_range",
    f"""select cohort_month, {_RETENTION} from {{mart_funnel}}
where country >= 'NATION_2' and country < 'NATION_5' and plan != 'free' group by all
order by cohort_month desc nulls last limit 100""",
)
def _(w):
    where = [("country", ">=", "NATION_2"), ("country", "<", "NATION_5"), ("plan", "!=", "free")]
    return governed.query_metric(w, "thirty_day_retention_rate", where=where)


@check("governed_query_churn_by_country", _churn_sql("country,") + " order by metric_month desc, country limit 100")
def _(w):
    return governed.query_metric(w, "churn_rate", ["country"])


def _davg(column: str) -> str:
    return f"{dsum(column)} / nullif(count({column}), 0)"


@check(
    "governed_query_ltv_by_plan",
    f"""select metric_month, plan, {_davg("estimated_ltv")} as estimated_ltv,
  {_davg("estimated_cac")} as estimated_cac, {_davg("ltv_to_cac_ratio")} as ltv_to_cac_ratio
from {{mart_revenue}} group by all order by metric_month desc, plan limit 100""",
)
def _(w):
    return governed.query_metric(w, "customer_lifetime_value", ["plan"])


@check(
    "rollup_ratio_vs_avg",
    f"""select cohort_month, cast(sum(signups) as bigint) as signups,
  {r2("100.0 * sum(day30_retained) / sum(signups)", 4)} as ratio_of_sums_pct,
  {r2(_davg("day30_retention_rate_pct"), 4)} as avg_of_rates_pct
from {{mart_funnel}} group by all""",
)
def _(w):
    return governed.ratio_vs_average(w.funnel_analysis)


@check(
    "q_last_period",
    f"""select metric_month, {_MRR} from {{mart_revenue}}
where metric_month = (select max(metric_month) from {{mart_revenue}}) group by all""",
)
def _(w):
    return questions.last_period(w)


@check(
    "q_quarter",
    f"""from ({_churn_sql("")}) where date_trunc('quarter', metric_month)
  = (select date_trunc('quarter', max(metric_month)) from {{mart_revenue}})""",
)
def _(w):
    return questions.last_quarter(w)


@check(
    "q_filter_dim",
    f"""select metric_month, {dsum("mrr")} as mrr, cast(sum(paying_customers) as bigint) as paying_customers
from {{mart_revenue}} where plan = 'starter' and country = 'NATION_7' and year(metric_month) = 1998 group by all""",
)
def _(w):
    return questions.filtered(w, "starter", "NATION_7", 1998)


@check(
    "q_by_dim",
    f"""select acquisition_channel, cast(sum(signups) as bigint) as signups,
  cast(sum(activations) as bigint) as activations, cast(sum(conversions) as bigint) as conversions,
  {r2("100.0 * sum(activations) / sum(signups)")} as activation_rate_pct,
  {r2("100.0 * sum(conversions) / sum(signups)")} as signup_to_paid_rate_pct
from {{mart_funnel}} group by all""",
)
def _(w):
    return questions.by_channel(w)


_TREND = f"""
select metric_month, mrr, lag(mrr) over (order by metric_month) as previous_mrr
from (select metric_month, {dsum("mrr")} as mrr from {{mart_revenue}} group by all)"""
_GROWTH = r2("(mrr - previous_mrr) * 100.0 / nullif(previous_mrr, 0)")


@check("q_trend", f"select *, {_GROWTH} as growth_pct from ({_TREND})")
def _(w):
    return questions.mrr_trend(w)


@check(
    "q_compare",
    f"""select metric_month,
  {dsum("case when plan = 'pro' then mrr end")} as mrr_pro,
  {dsum("case when plan = 'enterprise' then mrr end")} as mrr_enterprise
from {{mart_revenue}} where plan in ('pro', 'enterprise') group by all""",
)
def _(w):
    return questions.compare_plans(w)


@check(
    "q_topk",
    f"select country, {dsum('mrr')} as mrr from {{mart_revenue}} group by all order by mrr desc, country limit 5",
)
def _(w):
    return questions.top_countries(w)


@check(
    "q_best_plan",
    f"""select plan, {_davg("ltv_to_cac_ratio")} as ltv_to_cac_ratio from {{mart_revenue}}
group by all order by ltv_to_cac_ratio desc nulls last, plan limit 1""",
)
def _(w):
    return questions.best_plan(w)


@check(
    "q_multi_metric",
    f"""select t.metric_month, t.mrr, {_GROWTH.replace("mrr", "t.mrr").replace("previous_t.mrr", "t.previous_mrr")} as growth_pct,
  l.ltv_to_cac_ratio, s.signups
from ({_TREND}) t
join (select metric_month, {_davg("ltv_to_cac_ratio")} as ltv_to_cac_ratio from {{mart_revenue}} group by all) l
  on l.metric_month = t.metric_month
left join (select cohort_month, cast(sum(signups) as bigint) as signups from {{mart_funnel}} group by all) s
  on s.cohort_month = t.metric_month""",
)
def _(w):
    return questions.growth_health(w)


@check(
    "q_billing_interval",
    f"""select metric_month, billing_interval, count(*) as subscriptions,
  {r2("cast(sum(twelfths) as double) / 12.0")} as mrr
from (select c.m as metric_month, s.* from {{subs}} s
  join {{calendar}} c on c.m >= s.started_at and c.m < ifnull(s.ended_at, date '9999-12-31')
  where s.monthly_recurring_revenue > 0)
group by all""",
)
def _(w):
    return revenue.mrr_by_billing_interval(w.subscriptions, w.calendar).select(
        "metric_month", "billing_interval", "subscriptions", F.col("mrr")
    )


@check(
    "q_region",
    f"""select cohort_month, {_RETENTION} from {{mart_funnel}}
where country in (select upper(n_name) from nation, region where r_regionkey = n_regionkey and r_name = 'EUROPE')
group by all""",
)
def _(w):
    return questions.region_retention(w, "EUROPE")


@check(
    "q_last_signups",
    """select cohort_month, cast(sum(signups) as bigint) as signups from {mart_funnel}
where cohort_month <= date '2025-01-01' group by all order by cohort_month desc limit 1""",
)
def _(w):
    return questions.last_signups(w)
