"""Shared table expressions of the SQL side, written for DuckDB over the parquet views.

They state the results in plain relational SQL (range joins, LEFT JOIN ... IS NULL, count distinct) and are kept apart
from the DataFrame code on purpose.
"""

from __future__ import annotations

import re

from meterstone.config import ACTIVITY_EVENT_TYPES, CHANNEL_COST, DEFAULTS, OTHER_CHANNEL_COST
from meterstone.operators.guardrail import (
    INJECTION_PATTERNS,
    INJECTION_REASON,
    PII_PATTERNS,
    PII_REASON,
)
from meterstone.sources.catalog import METRICS, REJECTION_MESSAGE, aliases
from meterstone.sources.golden import GOLDEN
from meterstone.sources.query_log import INTENTS, QUESTIONS, STATEMENTS


def r2(expr: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"(floor(({expr}) * {scale}.0 + 0.5) / {scale}.0)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def dsum(expr: str) -> str:
    """Exact sum of two-decimal DOUBLE values."""
    return f"cast(sum(cast({expr} as decimal(18,2))) as double)"


def _case(key: str, values) -> str:
    arms = " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values) if v is not None)
    return f"case {key} % {len(values)} {arms} end"


_CHANNEL_COST_SQL = (
    "case acquisition_channel "
    + " ".join(f"when {quoted(k)} then {v}" for k, v in CHANNEL_COST.items())
    + f" else {OTHER_CHANNEL_COST} end"
)

CTES: dict[str, str] = {}

CTES["raw_users"] = """
select
  case when c_custkey % 37 = 0 then null
       when c_custkey % 101 = 50 then 'U' || (c_custkey - 1)
       else 'U' || c_custkey end as user_id,
  case when c_custkey % 47 = 0 then null
       when c_custkey % 43 = 0 then 'not-an-email'
       else '  ' || replace(c_name, '#', '.') || '@Example.com ' end as email,
  case when c_custkey % 97 = 0 then '2999-01-01'
       else (select cast(cast(min(o_orderdate) as date) as varchar) from orders where o_custkey = c_custkey)
  end as signup_date,
  case c_custkey % 6 when 0 then 'free' when 1 then 'Starter ' when 2 then 'PRO'
       when 3 then 'enterprise' when 4 then 'legacy_growth' end as plan,
  case c_mktsegment when 'AUTOMOBILE' then 'paid_search' when 'BUILDING' then 'SEO'
       when 'FURNITURE' then 'Referral' when 'HOUSEHOLD' then 'email' end as acquisition_channel,
  case when c_custkey % 53 <> 0 then lower(n_name) end as country,
  case when c_acctbal < 0 then null when c_acctbal < 3000 then '1-10'
       when c_acctbal < 7000 then '11-50' else '51+' end as company_size
from customer join nation on n_nationkey = c_nationkey
"""

CTES["raw_events"] = """
select 'O' || o_orderkey as event_id,
  case when o_orderkey % 71 <> 0 then 'U' || o_custkey end as user_id,
  case left(o_orderpriority, 1) when '1' then 'page_view' when '2' then ' Feature_Used' when '3' then 'api_call'
       when '4' then 'login' else 'legacy_click' end as event_type,
  cast(o_orderdate as varchar) as event_timestamp,
  'S' || (o_orderkey % 97) as session_id,
  cast(null as varchar) as properties
from orders
union all
select 'E' || event_id, 'U' || user_id,
  case event_type when 'view' then 'page_view' when 'click' then 'feature_used' when 'purchase' then 'export'
       when 'signup' then 'login' when 'error' then 'settings_change' end,
  cast(ts as varchar), 'S' || (event_id % 97), props
from events
"""

CTES["raw_subscriptions"] = """
select 'S' || o_orderkey as subscription_id, 'U' || o_custkey as user_id,
  case o_orderkey % 5 when 0 then 'free' when 1 then 'Starter' when 2 then 'pro ' when 3 then 'Enterprise'
       else 'legacy_growth' end as plan,
  (case when o_orderkey % 61 = 1 then -1.0 else 1.0 end)
    * (case when o_orderkey % 5 = 0 then 0 else (o_orderkey % 997) / 4.0 end) as mrr_usd,
  cast(cast(o_orderdate as date) as varchar) as started_at,
  case when o_orderstatus = 'O' then '' when o_orderkey % 59 = 0 then 'n/a' when o_orderkey % 67 = 0 then null
       else cast(cast(o_orderdate as date) + cast(30 + o_orderkey % 300 as integer) as varchar) end as ended_at,
  case when o_orderkey % 3 = 0 then ' Annual' else 'monthly' end as billing_interval
from orders
"""

CTES["raw_payments"] = """
select 'P' || l_orderkey || '-' || l_linenumber as payment_id, 'U' || o_custkey as user_id,
  'S' || l_orderkey as subscription_id,
  case when (l_returnflag = 'A' and l_linenumber % 2 = 0) or (l_returnflag = 'R' and l_linenumber % 2 = 1)
       then -l_extendedprice else l_extendedprice end as amount_usd,
  case l_linenumber when 7 then 'EUR' when 6 then ' usd' else 'USD' end as currency,
  case when l_partkey % 89 <> 0 then l_returnflag = 'R' end as refund_flag,
  cast(cast(l_shipdate as date) as varchar) as payment_date,
  case l_linestatus when 'O' then ' Card' else 'PayPal' end as payment_method
from lineitem join orders on o_orderkey = l_orderkey
"""

CTES["users"] = """
select user_id, lower(trim(email)) as email, cast(signup_date as date) as signup_date,
  ifnull(lower(trim(plan)), 'unknown') as plan,
  ifnull(replace(lower(trim(acquisition_channel)), 'seo', 'organic'), 'unknown') as acquisition_channel,
  upper(trim(country)) as country,
  ifnull(company_size, 'unknown') as company_size,
  cast(date_trunc('month', cast(signup_date as date)) as date) as signup_month
from {raw_users}
"""

CTES["stg_events"] = f"""
select event_id, user_id, lower(trim(event_type)) as event_type,
  cast(event_timestamp as timestamp) as event_timestamp,
  cast(cast(event_timestamp as timestamp) as date) as event_date,
  cast(date_trunc('week', cast(event_timestamp as timestamp)) as date) as event_week,
  cast(date_trunc('month', cast(event_timestamp as timestamp)) as date) as event_month,
  session_id,
  lower(trim(event_type)) in ({listed(ACTIVITY_EVENT_TYPES)}) as is_activity_event
from {{raw_events}}
"""

CTES["subs"] = """
select subscription_id, user_id, ifnull(lower(trim(plan)), 'unknown') as plan,
  ifnull(list_position(['free', 'starter', 'pro', 'enterprise'], lower(trim(plan))) - 1, -1) as plan_tier,
  cast(mrr_usd as decimal(10,2)) as mrr_usd, cast(started_at as date) as started_at,
  try_cast(nullif(ended_at, '') as date) as ended_at,
  ifnull(ended_at, '') = '' as is_active,
  lower(trim(billing_interval)) as billing_interval,
  cast(cast(mrr_usd as decimal(10,2)) as double)
    / (case lower(trim(billing_interval)) when 'annual' then 12 else 1 end) as monthly_recurring_revenue,
  cast(mrr_usd as decimal(10,2))
    * (case lower(trim(billing_interval)) when 'annual' then 1 else 12 end) as twelfths
from {raw_subscriptions}
"""

CTES["payments"] = """
select *, case when is_refund then -abs(amount_usd) else amount_usd end as net_amount_usd,
  amount_usd < 0 and not is_refund as is_suspected_dirty
from (
  select payment_id, user_id, subscription_id, cast(amount_usd as decimal(10,2)) as amount_usd,
    upper(trim(currency)) as currency, currency = 'USD' as is_usd, refund_flag as is_refund,
    cast(payment_date as date) as payment_date,
    cast(date_trunc('month', cast(payment_date as date)) as date) as payment_month,
    cast(date_trunc('week', cast(payment_date as date)) as date) as payment_week,
    lower(trim(payment_method)) as payment_method
  from {raw_payments}
)
"""

CTES["active"] = """
select user_id, event_date, event_week, event_month, count(*) as n
from {stg_events} where user_id is not null and is_activity_event group by all
"""

CTES["mart_users"] = """
select event_date as metric_date, event_week, event_month, plan, country, acquisition_channel,
  count(distinct a.user_id) as daily_active_users,
  count(distinct a.user_id) filter (where event_date - signup_date <= 7) as new_user_activations,
  cast(sum(n) as bigint) as total_events,
  count(distinct a.user_id) as dau
from {active} a left join {users} u on u.user_id = a.user_id
group by all
"""

CTES["mart_retention"] = f"""
select r.cohort_month, r.retention_period, r.plan, r.country, s.cohort_size, r.retained_users,
  {r2("100.0 * r.retained_users / nullif(s.cohort_size, 0)")} as retention_rate_pct,
  s.cohort_size - r.retained_users as churned_users
from (
  select signup_month as cohort_month,
    datediff('month', signup_month, event_month) as retention_period, plan, country,
    count(distinct u.user_id) as retained_users
  from {{users}} u join {{active}} a on a.user_id = u.user_id and a.event_month >= u.signup_month
  group by all
) r
join (
  select signup_month as cohort_month, plan, country, count(distinct user_id) as cohort_size
  from {{users}} where user_id is not null group by all
) s on s.cohort_month = r.cohort_month and s.plan = r.plan and s.country = r.country
"""

CTES["calendar"] = "select distinct payment_month as m from {payments}"

CTES["sub_months"] = """
select c.m as metric_month, s.subscription_id, s.user_id, s.plan, s.monthly_recurring_revenue, s.twelfths,
  s.billing_interval,
  ifnull(u.country, 'unknown') as country, ifnull(u.acquisition_channel, 'unknown') as acquisition_channel
from {subs} s
join {calendar} c on c.m >= s.started_at and c.m < ifnull(s.ended_at, date '9999-12-31')
left join {users} u on u.user_id = s.user_id
where s.monthly_recurring_revenue > 0
"""

CTES["mrr"] = """
select metric_month, plan, country, acquisition_channel, count(distinct user_id) as paying_customers,
  cast(sum(twelfths) as double) / 12.0 as mrr, cast(sum(twelfths) as double) as arr,
  cast(sum(twelfths) as double) / 12.0 / count(*) as arpu
from {sub_months} group by all
"""

CTES["churned"] = """
select cast(l.metric_month + interval 1 month as date) as metric_month, l.user_id, l.plan, l.country, l.twelfths
from {sub_months} l
left join (select distinct metric_month, user_id, plan, country from {sub_months}) t
  on t.metric_month = l.metric_month + interval 1 month
 and t.user_id = l.user_id and t.plan = l.plan and t.country = l.country
where t.user_id is null
"""

CTES["churn"] = """
select metric_month, plan, country, count(distinct user_id) as churned_customers,
  cast(sum(twelfths) as double) / 12.0 as churned_mrr
from {churned} group by all
"""

CTES["pay_month"] = """
select payment_month as metric_month,
  cast(sum(net_amount_usd) filter (where not is_suspected_dirty) as double) as net_revenue,
  count(*) filter (where is_suspected_dirty) as dirty_payment_rows
from {payments} where is_usd group by all
"""

CTES["cac"] = f"""
select signup_month as cohort_month, acquisition_channel, count(distinct user_id) as new_customers,
  cast(sum({_CHANNEL_COST_SQL}) as double) / count(distinct user_id) as estimated_cac
from {{users}} where user_id is not null group by all
"""

_LIFETIME = f"arpu / nullif(cast(churned_customers as double) / paying_customers, 0) * {DEFAULTS.ltv_margin}"

CTES["mart_revenue"] = f"""
select metric_month, plan, country, acquisition_channel, paying_customers,
  {r2("mrr")} as mrr, {r2("arr")} as arr, {r2("arpu")} as arpu, churned_customers,
  {r2("churned_mrr")} as churned_mrr,
  {r2("100.0 * churned_customers / paying_customers")} as churn_rate_pct,
  {r2("cac")} as estimated_cac,
  {r2(_LIFETIME)} as estimated_ltv,
  {r2(f"{_LIFETIME} / nullif(cac, 0)")} as ltv_to_cac_ratio,
  {r2("net_revenue")} as net_revenue, dirty_payment_rows
from (
  select m.*, ifnull(churned_customers, 0) as churned_customers, ifnull(churned_mrr, 0.0) as churned_mrr,
    ifnull(estimated_cac, 0.0) as cac, ifnull(net_revenue, 0.0) as net_revenue,
    ifnull(dirty_payment_rows, 0) as dirty_payment_rows
  from {{mrr}} m
  left join {{churn}} c on c.metric_month = m.metric_month and c.plan = m.plan and c.country = m.country
  left join {{cac}} k on k.cohort_month = m.metric_month and k.acquisition_channel = m.acquisition_channel
  left join {{pay_month}} p on p.metric_month = m.metric_month
)
"""


def activity_window(lo: int, hi: int) -> str:
    return (
        "select distinct u.user_id from {users} u join {active} a on a.user_id = u.user_id "
        f"and a.event_date - u.signup_date between {lo} and {hi}"
    )


CTES["activated"] = activity_window(*DEFAULTS.activation_days)
CTES["retained"] = activity_window(*DEFAULTS.retained_days)
CTES["same_day"] = activity_window(0, 0)
CTES["converted"] = (
    "select distinct user_id from {payments} where net_amount_usd > 0 and not is_suspected_dirty and is_usd"
)


def _user_funnel(activated: str, retained: str) -> str:
    return f"""
select user_id, signup_month as cohort_month, plan, country, acquisition_channel, signup_date,
  true as reached_signup,
  user_id in (select user_id from {activated}) as reached_activation,
  user_id in (select user_id from {{converted}} where user_id is not null) as reached_conversion,
  user_id in (select user_id from {retained}) as reached_day30_retention
from {{users}} where user_id is not null
"""


CTES["user_funnel"] = _user_funnel("{activated}", "{retained}")
CTES["user_funnel_same_day"] = _user_funnel("{same_day}", "{same_day}")


def _funnel(source: str) -> str:
    return f"""
select *, {r2("100.0 * activations / signups")} as activation_rate_pct,
  {r2("100.0 * conversions / signups")} as signup_to_paid_rate_pct,
  {r2("100.0 * day30_retained / signups")} as day30_retention_rate_pct,
  {r2("100.0 * conversions / activations")} as activation_to_paid_rate_pct,
  {r2("100.0 * day30_retained / conversions")} as paid_to_retained_rate_pct
from (
  select cohort_month, plan, country, acquisition_channel, count(*) as signups,
    nullif(count(*) filter (where reached_activation), 0) as activations,
    nullif(count(*) filter (where reached_conversion), 0) as conversions,
    nullif(count(*) filter (where reached_day30_retention), 0) as day30_retained
  from {source} group by all
)
"""


CTES["mart_funnel"] = _funnel("{user_funnel}")
CTES["mart_funnel_same_day"] = _funnel("{user_funnel_same_day}")

CTES["query_log"] = f"""
select event_id as request_id, 'U' || user_id as caller, ts as started_at,
  cast(floor(value * 50000 + 0.5) as bigint) as latency_us,
  case event_type {" ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in INTENTS.items())} end as intent,
  {_case("event_id", QUESTIONS)} as question, {_case("event_id", STATEMENTS)} as sql,
  case when event_id % 23 = 0 then 0 else event_id * 7 % 600 end as row_count,
  case when event_id % 11 = 0 then 1 else 0 end as retries,
  case when event_id % 29 = 0 then 'Binder Error: no such column' end as error,
  event_id % 900 + 150 as input_tokens, event_id % 200 + 10 as output_tokens,
  event_id % 10 = 3 as cache_hit
from events
"""

CTES["mart_series"] = f"""
select 'daily_active_users' as metric, metric_date as ds, cast(sum(daily_active_users) as double) as y
from {{mart_users}} group by all
union all
select 'monthly_recurring_revenue', metric_month, {dsum("mrr")} from {{mart_revenue}} group by all
"""

CTES["series"] = f"""
from {{mart_series}}
union all
select 'daily_order_value', cast(o_orderdate as date), {dsum("o_totalprice")} from orders group by all
union all
select 'monthly_order_value', cast(date_trunc('month', o_orderdate) as date), {dsum("o_totalprice")}
from orders group by all
"""


def _alerts(method: str, lower: str, upper: str, z: str, source: str) -> str:
    return f"""
select metric, ds, {r2("y")} as actual_value, {r2("expected")} as expected_value,
  {r2(lower)} as expected_lower, {r2(upper)} as expected_upper,
  {r2("case when expected = 0 then 0.0 else (y - expected) / expected * 100.0 end", 1)} as deviation_pct,
  {r2(z)} as z_score, '{method}' as method, if(y > expected, 'spike', 'drop') as direction
from {source}"""


CTES["sigma"] = (
    _alerts("3sigma", "cast(null as double)", "cast(null as double)", "(y - expected) / spread", "(")
    + """
  select metric, ds, y, avg(y) over w as expected, nullif(stddev_samp(y) over w, 0) as spread,
    count(y) over w as points, count(*) over (partition by metric) as history
  from {series} window w as (partition by metric order by ds rows between 29 preceding and current row)
) where history >= 14 and points >= 7 and abs((y - expected) / spread) > 3.0
"""
)


def _trended_sql(bends: int = 4) -> str:
    """The bending line by its normal equations, one knot after the other."""
    knots = range(bends + 1)
    hat = [f"greatest(0.0, 1 - abs(place - {k}))" for k in knots]
    sums = [f"sum({hat[k]} * {hat[k]}) + 1e-12 * count(y) as a{k}" for k in knots]
    sums += [f"sum({hat[k]} * {hat[k + 1]}) as c{k}" for k in knots[:-1]]
    sums += [f"sum({hat[k]} * (y - mean)) as b{k}" for k in knots]
    solved = f"select metric, {', '.join(sums)} from placed group by metric"
    for k in knots[1:]:
        solved = (
            f"select * replace (a{k} - c{k - 1} / a{k - 1} * c{k - 1} as a{k}, b{k} - c{k - 1} / a{k - 1} * b{k - 1} as b{k}) from ({solved})"
        )
    solved = f"select *, b{bends} / a{bends} as w{bends} from ({solved})"
    for k in reversed(knots[:-1]):
        solved = f"select *, (b{k} - c{k} * w{k + 1}) / a{k} as w{k} from ({solved})"
    height = " + ".join(f"{hat[k]} * w{k}" for k in knots)
    return f"""
with placed as (
  select s.*, mean, ifnull((s.ds - first_day) / cast(nullif(last_day - first_day, 0) as double) * {bends}, 0.0) as place
  from {{series}} s join (select metric, min(ds) as first_day, max(ds) as last_day, avg(y) as mean from {{series}} group by metric) m on m.metric = s.metric
)
select p.metric, p.ds, p.y, mean + ({height}) as trend from placed p join ({solved}) w on w.metric = p.metric
"""


CTES["trended"] = _trended_sql()

CTES["seasonal"] = (
    _alerts("seasonal", "expected - half", "expected + half", "cast(null as double)", "(")
    + """
  select *, greatest(1.96 * stddev_samp(y - expected) over (partition by metric), 1e-9 * max(abs(y)) over (partition by metric)) as half
  from (
    select metric, ds, y, trend + season
      + if(daily, avg(y - trend - season) over (partition by metric, isodow(ds)), 0.0) as expected
    from (
      select *, if(yearly, avg(y - trend) over (partition by metric, month(ds)), 0.0) as season
      from (
        select t.metric, t.ds, t.y, t.trend, yearly, daily
        from {trended} t
        join (
          select metric, max(ds) - min(ds) >= 730 as yearly, max(day(ds)) > 1 as daily
          from {series} group by metric having count(*) >= 14
        ) f on f.metric = t.metric
      )
    )
  )
) where y < expected - half or y > expected + half
"""
)

CTES["alerts"] = """
from {seasonal}
union all
select s.* from {sigma} s left join {seasonal} t on t.metric = s.metric and t.ds = s.ds where t.ds is null
"""

CTES["feed"] = """
select md5(metric || '|' || ds || '|' || method) as id, metric as metric_name, ds as anomaly_date,
  actual_value, expected_value, deviation_pct, direction, method,
  'Auto-flagged: ' || printf('%+.1f', deviation_pct) || '% deviation on ' || ds as commentary,
  true as human_review_required, false as commentary_approved,
  cast(ds as timestamp) + interval 1 day as detected_at
from {alerts}
"""

def _values(rows) -> str:
    def cell(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + listed(v) + "]::varchar[]"
        return str(v) if isinstance(v, int) else quoted(v)

    return "values " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _pattern_table(patterns, reason) -> str:
    return _values((i, p, reason.format(p)) for i, p in enumerate(patterns))


CTES["aliases"] = f"from ({_values((i, a, m) for i, (a, m) in enumerate(aliases()))}) as t(pos, alias, metric)"
CTES["examples"] = "from ({}) as t(pos, metric, words)".format(
    _values(
        (i, name, sorted(set(example.lower().split())))
        for i, (name, example) in enumerate((m.name, e) for m in METRICS for e in m.examples)
    )
)
CTES["golden"] = (
    f"from ({_values(GOLDEN)}) as t(position, category, expected_table, expected_columns, should_reject)"
)

CTES["texts"] = f"""
select q.question,
  (select arg_min(reason, pos) from ({_pattern_table(PII_PATTERNS, PII_REASON)}) as p(pos, pattern, reason)
   where regexp_matches(lower(q.question), pattern)) as pii_reason,
  (select arg_min(reason, pos) from ({_pattern_table(INJECTION_PATTERNS, INJECTION_REASON)}) as p(pos, pattern, reason)
   where regexp_matches(q.question, pattern, 'i')) as injection_reason,
  ifnull(
    (select arg_min(metric, pos) from {{aliases}} where contains(lower(q.question), alias)),
    (select arg_min(metric, pos) from {{examples}}
     where len(list_intersect(words, list_distinct(string_split_regex(trim(lower(q.question)), '\\s+')))) >= 3)
  ) as metric
from (select distinct question from {{query_log}}) q
"""

CTES["verdicts"] = f"""
select *, pii_check and injection_check and metric_check as passed,
  case when not pii_check then pii_reason when not injection_check then injection_reason
       when not metric_check then {quoted(REJECTION_MESSAGE)} end as rejection_reason
from (
  select l.*, t.metric, pii_reason, injection_reason, pii_reason is null as pii_check,
    injection_reason is null as injection_check, intent = 'out_of_scope' as out_of_scope,
    intent = 'out_of_scope' or pii_reason is not null or injection_reason is not null or metric is not null
      as metric_check
  from {{query_log}} l join {{texts}} t on t.question = l.question
)
"""

CTES["graded"] = """
select *, not passed as rejected,
  case when error is not null or row_count = 0 then 'low' when retries > 0 or row_count > 200 then 'medium'
       else 'high' end as confidence,
  input_tokens * 3 + output_tokens * 15 as micro,
  cast((input_tokens * 3 + output_tokens * 15 + 5) // 10 as double) / 100000.0 as cost_usd,
  case when passed then null
       when regexp_matches(lower(rejection_reason), 'pii|email|phone') then 'pii'
       when regexp_matches(lower(rejection_reason), 'injection|drop|delete') then 'injection'
       when contains(lower(rejection_reason), 'scope') or contains(intent, 'out_of_scope') then 'out_of_scope'
       else 'metric_allowlist' end as reason
from {verdicts}
"""

CTES["fingerprints"] = """
select *, md5(trim(regexp_replace(lower(sql), '\\s+', ' ', 'g'))) as fingerprint from {query_log}
"""

_REF = re.compile(r"\{(\w+)\}")


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the table expressions it names as {name}, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _REF.findall(sql):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)

    def plain(sql: str) -> str:
        return _REF.sub(lambda m: f"c_{m.group(1)}" if m.group(1) in CTES else m.group(0), sql).strip()

    if not order:
        return plain(body)
    recursive = "recursive " if "/*recursive*/" in body else ""
    return f"with {recursive}" + ",\n".join(f"c_{n} as (\n{plain(CTES[n])}\n)" for n in order) + "\n" + plain(body)
