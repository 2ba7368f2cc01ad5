"""Queries for query-log governance and evaluation."""

from pyspark.sql import functions as F

from meterstone.checks.ctes import listed, quoted, r2
from meterstone.checks.registry import check, stored_check
from meterstone.operators import guardrail, querylog, scoring
from meterstone.session import new_scratch
from meterstone.sources import catalog, golden, sinks

_VERDICT = "passed, metric_check, pii_check, injection_check, rejection_reason, out_of_scope"

# Columns of the four marts, in the marts' order.
_MARTS = {
    "mart_user_metrics": (
        "metric_date", "event_week", "event_month", "plan", "country", "acquisition_channel", "daily_active_users",
        "new_user_activations", "total_events", "dau",
    ),
    "mart_cohort_retention": (
        "cohort_month", "retention_period", "plan", "country", "cohort_size", "retained_users", "retention_rate_pct",
        "churned_users",
    ),
    "mart_revenue_metrics": (
        "metric_month", "plan", "country", "acquisition_channel", "paying_customers", "mrr", "arr", "arpu",
        "churned_customers", "churned_mrr", "churn_rate_pct", "estimated_cac", "estimated_ltv", "ltv_to_cac_ratio",
        "net_revenue", "dirty_payment_rows",
    ),
    "mart_funnel_analysis": (
        "cohort_month", "plan", "country", "acquisition_channel", "signups", "activations", "conversions", "day30_retained",
        "activation_rate_pct", "signup_to_paid_rate_pct", "day30_retention_rate_pct", "activation_to_paid_rate_pct",
        "paid_to_retained_rate_pct",
    ),
}
MART_COLUMNS = list(dict.fromkeys(c for columns in _MARTS.values() for c in columns))


@check("guard_pii", "select request_id, pii_check, pii_reason from {verdicts}")
def _(w):
    reason = guardrail.pii_reason(F.col("question"))
    return w.query_log.select("request_id", reason.isNull().alias("pii_check"), reason.alias("pii_reason"))


@check("guard_injection", "select request_id, injection_check, injection_reason from {verdicts}")
def _(w):
    reason = guardrail.injection_reason(F.col("question"))
    return w.query_log.select("request_id", reason.isNull().alias("injection_check"), reason.alias("injection_reason"))


@check("resolve_metric", "select request_id, question, metric from {verdicts}")
def _(w):
    return w.query_log.select(
        "request_id", "question", guardrail.resolved_metric(F.col("question")).alias("metric")
    )


@check("guard_verdict", f"select request_id, metric, {_VERDICT} from {{verdicts}}")
def _(w):
    return guardrail.with_verdict(w.query_log).select("request_id", "metric", "guardrail.*")


_AUDIT = """select md5(cast(request_id as varchar)) as id, started_at as checked_at, left(question, 500) as query_text,
  intent, passed, ifnull(rejection_reason, '') as failure_reason from {verdicts}"""


@check("audit_log_append", _AUDIT)
def _(w):
    path = new_scratch(w.spark, "audit_log")
    audit = guardrail.audit_records(guardrail.with_verdict(w.query_log))
    sinks.append(audit, path)
    return w.spark.read.schema(audit.schema).parquet(path)


@check(
    "audit_stats",
    """select count(*) as total_queries, count(*) filter (where passed) as passed_queries,
  count(*) filter (where not passed) as rejected_queries,
  count(*) filter (where passed and intent = 'out_of_scope') as passed_out_of_scope
from {verdicts}""",
)
def _(w):
    return guardrail.audit_stats(guardrail.audit_records(guardrail.with_verdict(w.query_log)))


@check(
    "catalog_aliases",
    "select pos as position, alias, metric, "
    "(select count(*) from {query_log} where contains(lower(question), alias)) as questions from {aliases}",
)
def _(w):
    return guardrail.alias_usage(w.query_log, catalog.alias_table(w.spark))


_TOKENS = "list_distinct(regexp_extract_all(lower(sql), '[a-z_][a-z0-9_]*'))"


@check(
    "pii_columns",
    f"""select column_name, count(*) as requests
from (select unnest({_TOKENS}) as column_name from {{query_log}})
where column_name in ({listed(catalog.PII_COLUMNS)}) group by all""",
)
def _(w):
    return guardrail.protected_references(w.query_log)


@check("query_fingerprint", "select request_id, fingerprint from {fingerprints}")
def _(w):
    return w.query_log.select("request_id", querylog.fingerprint(F.col("sql")).alias("fingerprint"))


def admission_sql(source: str, key: str, limit: int, seconds: int, result: str) -> str:
    """Row-by-row replay per key with the live admitted instants as a list."""
    window = seconds * 1_000_000
    return f"""/*recursive*/ , calls as (
  select request_id, {key} as k, started_at, epoch_us(started_at) as us,
    row_number() over (partition by {key} order by started_at, request_id) as rn
  from {source}
),
steps as (
  select k, cast(0 as bigint) as rn, cast(null as bigint) as request_id, cast(null as timestamp) as started_at,
    false as admitted, cast([] as bigint[]) as live
  from (select distinct k from calls)
  union all
  select k, rn, request_id, started_at, len(kept) < {limit},
    case when len(kept) < {limit} then list_append(kept, us) else kept end
  from (
    select c.*, [x for x in s.live if x > c.us - {window}] as kept
    from steps s join calls c on c.k is not distinct from s.k and c.rn = s.rn + 1
  )
)
{result}"""


@check(
    "cache_hits_ttl",
    admission_sql(
        "(from {fingerprints} where error is null)",
        "fingerprint",
        1,
        querylog.CACHE_TTL_SECONDS,
        """select f.request_id, f.fingerprint, f.started_at, ifnull(not s.admitted, false) as hit
from {fingerprints} f left join steps s on s.request_id = f.request_id""",
    ),
)
def _(w):
    return querylog.ttl_hits(w.query_log)


def throttle_sql(key: str, limit: int, seconds: int) -> str:
    return admission_sql(
        "{query_log}",
        key,
        limit,
        seconds,
        "select request_id, k as throttle_key, started_at, admitted from steps where rn > 0",
    )


@check("throttle_decisions", throttle_sql("caller", querylog.CALLS_PER_WINDOW, querylog.CALL_WINDOW_SECONDS))
def _(w):
    return querylog.throttle(w.query_log, F.col("caller"))


@check("throttle_weekly", throttle_sql("caller", 10, 7 * 86_400))
def _(w):
    """A quota that busy callers do exceed."""
    return querylog.throttle(w.query_log, F.col("caller"), limit=10, window_seconds=7 * 86_400)


@check("throttle_by_intent", throttle_sql("intent", 2, querylog.CALL_WINDOW_SECONDS))
def _(w):
    """A few very busy keys: most rows belong to keys that are over their quota."""
    return querylog.throttle(w.query_log, F.col("intent"), limit=2)


@stored_check(
    "result_cap",
    """select metric_date, plan, country, acquisition_channel, daily_active_users,
  (select count(*) from {mart_users}) as row_count, (select count(*) from {mart_users}) > 500 as truncated
from {mart_users}
order by metric_date desc, plan nulls last, country nulls last, acquisition_channel nulls last limit 500""",
)
def _(w):
    dims = ("plan", "country", "acquisition_channel")
    df = w.user_metrics.select("metric_date", *dims, "daily_active_users")
    return querylog.cap(df, [F.col("metric_date").desc(), *[F.col(c).asc_nulls_last() for c in dims]])


@check(
    "result_rows_returned",
    """select request_id, row_count, least(row_count, 500) as kept_rows, least(row_count, 50) as response_rows,
  row_count > 500 as truncated from {query_log}""",
)
def _(w):
    return querylog.returned_rows(w.query_log)


@check("confidence_grade", "select request_id, confidence from {graded}")
def _(w):
    return querylog.with_confidence(w.query_log).select("request_id", "confidence")


@check(
    "token_cost",
    """select request_id, input_tokens + output_tokens as total_tokens, cost_usd as estimated_cost,
  (input_tokens + output_tokens) * 5 / 1000000.0 as eval_cost from {graded}""",
)
def _(w):
    return querylog.token_cost(w.query_log)


@check("rejection_class", "select request_id, reason from {graded} where rejected")
def _(w):
    verdicts = guardrail.with_verdict(w.query_log).where(~F.col("guardrail.passed"))
    reason = guardrail.rejection_class(F.col("guardrail.rejection_reason"), F.col("intent"))
    return verdicts.select("request_id", reason.alias("reason"))


# Stated per statement of the log, not derived from it.
_STATEMENT_TABLES = (
    ("marts.mart_user_metrics",),
    ("marts.mart_user_metrics",),
    ("marts.mart_user_metrics",),
    ("marts.mart_funnel_analysis",),
    ("main.raw_users",),
    ("marts.mart_revenue_metrics", "marts.mart_funnel_analysis"),
    ("marts.mart_revenue_metrics",),
    ("marts.mart_user_metrics", "marts.mart_revenue_metrics"),
    ("marts.mart_revenue_metrics",),
    ("mart_funnel_analysis",),
    ("mart_user_metrics",),
    ("mart_revenue_metrics",),
    ("marts.mart_user_metrics",),
    ("marts.mart_user_metrics",),
    ("mart_revenue_metrics", "mart_user_metrics"),
)
_STATEMENT_COLUMNS = (
    ("metric_date", "daily_active_users", "plan"),
    ("metric_date", "daily_active_users", "plan"),
    ("metric_date", "daily_active_users", "plan"),
    ("cohort_month", "plan", "day30_retention_rate_pct"),
    (),
    ("metric_month", "mrr", "signups", "cohort_month"),
    ("metric_month", "plan", "churn_rate_pct", "estimated_ltv"),
    ("metric_date", "mrr", "plan"),
    ("plan", "mrr"),
    ("cohort_month", "signups"),
    ("metric_date",),
    ("mrr",),
    ("metric_date", "daily_active_users"),
    ("metric_date",),
    ("mrr", "plan"),
)


def _by_statement(lists: tuple[tuple[str, ...], ...]) -> str:
    cases = " ".join(f"when {i} then cast([{listed(names)}] as varchar[])" for i, names in enumerate(lists))
    return f"(case request_id % {len(lists)} {cases} end)"


_TABLES = _by_statement(_STATEMENT_TABLES)


@check(
    "sql_table_refs",
    f"""select distinct request_id, unnest(list_concat(t, [split_part(x, '.', -1) for x in t])) as table_name
from (select request_id, {_TABLES} as t from {{query_log}})""",
)
def _(w):
    return w.query_log.select("request_id", F.explode(scoring.table_refs(F.col("sql"))).alias("table_name"))


@check(
    "sql_column_refs",
    f"select request_id, unnest({_by_statement(_STATEMENT_COLUMNS)}) as column_name from {{query_log}}",
)
def _(w):
    refs = scoring.column_refs(F.col("sql"), MART_COLUMNS)
    return w.query_log.select("request_id", F.explode(refs).alias("column_name"))


_SCORES = f"""
select request_id, position, category, should_reject, was_rejected, should_reject = was_rejected as rejection_correct,
  should_reject or (not was_rejected and table_ok) as table_correct,
  should_reject or (not was_rejected and columns_ok) as columns_correct,
  if(should_reject, was_rejected, not was_rejected and table_ok and columns_ok) as overall_pass
from (
  select v.request_id, g.position, g.category, g.should_reject, not passed or intent = 'out_of_scope' as was_rejected,
    expected_table is null or len([x for x in list_concat({_TABLES.replace('request_id', 'v.request_id')}, [split_part(y, '.', -1) for y in {_TABLES.replace('request_id', 'v.request_id')}])
      if contains(x, lower(expected_table)) or contains(lower(expected_table), x)]) > 0 as table_ok,
    2 * len([c for c in expected_columns if contains(lower(sql), c)]) >= len(expected_columns) as columns_ok
  from {{verdicts}} v join {{golden}} g on g.position = v.request_id % 20
)"""


def _scores(w):
    answers = guardrail.with_verdict(w.query_log).withColumn("position", F.col("request_id") % len(golden.GOLDEN))
    return scoring.score(answers, golden.golden_set(w.spark))


@check("golden_score", _SCORES)
def _(w):
    return _scores(w).select(
        "request_id",
        "position",
        "category",
        "should_reject",
        "was_rejected",
        "rejection_correct",
        "table_correct",
        "columns_correct",
        "overall_pass",
    )


def _report_sql(where: str, gate: float) -> str:
    accuracy = "100.0 * count(*) filter (where overall_pass) / count(*)"
    return f"""select category, count(*) as total, count(*) filter (where overall_pass) as passed,
  {r2(accuracy)} as accuracy_pct, {accuracy} >= 80 as marked, {accuracy} >= {gate} as gate_passed
from ({_SCORES}) where {where} group by rollup (category)"""


@check("golden_report", _report_sql("true", 85))
def _(w):
    return scoring.accuracy_report(_scores(w), min_accuracy=0.85)


@check("golden_report_quick", _report_sql("position < 10", 0))
def _(w):
    return scoring.accuracy_report(_scores(w), first=scoring.QUICK_QUESTIONS)


@check("golden_report_category", _report_sql(f"category = {quoted('cohort_analysis')}", 0))
def _(w):
    return scoring.accuracy_report(_scores(w), category="cohort_analysis")
