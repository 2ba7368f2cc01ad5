"""Queries for service telemetry."""

from pyspark.sql import functions as F

from meterstone.checks.ctes import r2
from meterstone.checks.registry import check
from meterstone.operators import telemetry


def _graded(w):
    return telemetry.graded(w.query_log)


@check(
    "tel_counters",
    """select 'queries' as counter, intent as label1, confidence as label2, count(*) as value
from {graded} where not rejected group by all
union all select 'rejections', reason, null, count(*) from {graded} where rejected group by all
union all select 'cache', if(cache_hit, 'hit', 'miss'), null, count(*) from {graded} group by all
union all select 'sql_retries', null, null, cast(sum(retries) as bigint) from {graded}""",
)
def _(w):
    return telemetry.counters(_graded(w))


@check(
    "tel_hit_ratio",
    """select count(*) filter (where cache_hit) as hits, count(*) as requests,
  avg(cast(cache_hit as integer)) as hit_ratio from {graded}""",
)
def _(w):
    # The ratio needs no verdict, so it reads the plain log.
    return telemetry.hit_ratio(w.query_log)


def _buckets_sql(value: str, bounds, total: str, by: str, key: str) -> str:
    rows = ", ".join(
        f"({i}, '{'+Inf' if b is None else repr(b)}', {'null' if b is None else b})"
        for i, b in enumerate([*bounds, None])
    )
    return f"""
select {key} b.i as bucket, b.le, cast(b.bound as double) as bound,
  count(*) filter (where b.bound is null or g.v <= b.bound) as cumulative, count(*) as observations,
  {total} as total
from (select * replace (ifnull(nullif(intent, ''), 'unknown') as intent), {value} as v {by} from {{graded}} where not rejected) g
cross join (values {rows}) as b(i, le, bound)
group by all"""


_LATENCY = "cast(latency_us as double) / 1000000.0"
_LATENCY_TOTAL = "cast(sum(latency_us) as double) / 1000000.0"
_COST_TOTAL = "cast(sum(micro) as double) / 1000000.0"


@check(
    "tel_histogram",
    "select 'latency' as histogram, * from ("
    + _buckets_sql(_LATENCY, telemetry.LATENCY_BOUNDS, _LATENCY_TOTAL, "", "intent,")
    + ")\nunion all by name\nselect 'cost' as histogram, 'all' as intent, * from ("
    + _buckets_sql("cost_usd", telemetry.COST_BOUNDS, _COST_TOTAL, "", "")
    + ")",
)
def _(w):
    log = _graded(w)
    latency = telemetry.latency_histogram(log, [telemetry.intent_label()]).withColumn("histogram", F.lit("latency"))
    cost = telemetry.cost_histogram(log, [F.lit("all").alias("intent")]).withColumn("histogram", F.lit("cost"))
    return latency.unionByName(cost)


def _quantile_sql(buckets: str, by: str) -> str:
    part = f"partition by {by}" if by else ""
    lead = f"{by}," if by else ""
    return f"""
select {lead} q as quantile,
  {r2("ifnull(lower + (bound - lower) * (q * observations - below) / (cumulative - below), lower)", 6)} as value
from (
  select *, ifnull(lag(cumulative) over w, 0) as below, ifnull(lag(bound) over w, 0.0) as lower
  from ({buckets}) window w as ({part} order by bucket)
) cross join (values (0.5::double), (0.95::double), (0.99::double)) as p(q)
where cumulative >= q * observations and (below < q * observations or bucket = 0)"""


@check(
    "tel_quantiles",
    _quantile_sql(_buckets_sql(_LATENCY, telemetry.LATENCY_BOUNDS, _LATENCY_TOTAL, "", "intent,"), "intent"),
)
def _(w):
    return telemetry.quantiles(telemetry.latency_histogram(_graded(w), [telemetry.intent_label()]), ["intent"])


_WINDOW_START = "time_bucket(interval 5 minutes, started_at)"


@check(
    "tel_quantiles_5m",
    _quantile_sql(
        _buckets_sql(
            _LATENCY, telemetry.LATENCY_BOUNDS, _LATENCY_TOTAL, f", {_WINDOW_START} as window_start", "window_start,"
        ),
        "window_start",
    ),
)
def _(w):
    start = F.window("started_at", "5 minutes").getField("start").alias("window_start")
    return telemetry.quantiles(telemetry.latency_histogram(_graded(w), [start]), ["window_start"])


@check("tel_cost_quantiles", _quantile_sql(_buckets_sql("cost_usd", telemetry.COST_BOUNDS, _COST_TOTAL, "", ""), ""))
def _(w):
    return telemetry.quantiles(telemetry.cost_histogram(_graded(w), []), [])


def _sliding_sql(source: str, by: str, minutes: int, per: int) -> str:
    lead = f"{by}," if by else ""
    return f"""select window_start, {lead} count(*) as requests,
  {r2(f"count(*) * {per} / {minutes * 60}.0", 6)} as rate
from (
  select *, unnest(generate_series(
    time_bucket(interval 15 seconds, started_at) - interval {minutes * 60 - 15} seconds,
    time_bucket(interval 15 seconds, started_at), interval 15 seconds)) as window_start
  from {{graded}} where {source}
) group by all"""


@check("tel_rate_sliding", _sliding_sql("not rejected", "intent", 5, 1))
def _(w):
    return telemetry.sliding_rate(_graded(w).where(~F.col("rejected")), ["intent"])


@check("tel_rate_per_minute", _sliding_sql("not rejected", "", 1, 60))
def _(w):
    log = _graded(w).where(~F.col("rejected"))
    return telemetry.sliding_rate(log, [], seconds=60, per=60)


@check("tel_rejection_rate", _sliding_sql("rejected", "reason", 5, 1))
def _(w):
    return telemetry.sliding_rate(_graded(w).where("rejected"), ["reason"])


@check(
    "tel_mean_cost",
    f"""select {_WINDOW_START} as window_start, count(*) as requests, cast(sum(micro) as double) / 1000000.0 as cost_usd,
  {r2("cast(sum(micro) as double) / count(*) / 1000000.0", 8)} as mean_cost_usd
from {{graded}} where not rejected group by all""",
)
def _(w):
    return telemetry.mean_cost(_graded(w))


_EACH_WINDOW = """(
  select *, unnest(generate_series(
    time_bucket(interval 15 seconds, started_at) - interval 285 seconds,
    time_bucket(interval 15 seconds, started_at), interval 15 seconds)) as window_start
  from {graded} where not rejected
)"""


@check(
    "tel_mean_cost_sliding",
    f"""select window_start, count(*) as requests, cast(sum(micro) as double) / 1000000.0 as cost_usd,
  {r2("cast(sum(micro) as double) / count(*) / 1000000.0", 8)} as mean_cost_usd
from {_EACH_WINDOW} group by all""",
)
def _(w):
    return telemetry.sliding_mean_cost(_graded(w))


@check(
    "tel_quantiles_sliding",
    _quantile_sql(
        _buckets_sql(_LATENCY, telemetry.LATENCY_BOUNDS, _LATENCY_TOTAL, "", "window_start, intent,").replace(
            "{graded} where not rejected", _EACH_WINDOW
        ),
        "window_start, intent",
    ),
)
def _(w):
    return telemetry.sliding_latency_quantiles(_graded(w))


@check(
    "tel_cost_quantiles_sliding",
    _quantile_sql(
        _buckets_sql("cost_usd", telemetry.COST_BOUNDS, _COST_TOTAL, "", "window_start,").replace(
            "{graded} where not rejected", _EACH_WINDOW
        ),
        "window_start",
    ),
)
def _(w):
    return telemetry.sliding_cost_quantiles(_graded(w))


_SKETCH_DAYS = 7


@check(
    "tel_sketch_quantiles",
    f"""select window_start, intent, q as quantile, count(*) as observations, true as within
from (
  select ifnull(nullif(intent, ''), 'unknown') as intent, unnest(generate_series(
    date_trunc('day', started_at)::timestamp - interval {_SKETCH_DAYS - 1} days,
    date_trunc('day', started_at)::timestamp, interval 1 day)) as window_start
  from {{graded}} where not rejected
) cross join (values (0.5::double), (0.95::double), (0.99::double)) as p(q)
group by all""",
)
def _(w):
    """Quantiles of merged sketches, each held against the exact ranks of its window."""
    answered = _graded(w).where(~F.col("rejected"))
    steps = telemetry.sketch_steps(answered, telemetry.latency_seconds(), [telemetry.intent_label()], 86_400)
    found = telemetry.sketched_quantiles(steps, ["intent"], 86_400, _SKETCH_DAYS)
    return telemetry.sketch_ranks(found, answered, 86_400, _SKETCH_DAYS)


@check(
    "tel_cost_quantiles_5m",
    _quantile_sql(
        _buckets_sql(
            "cost_usd", telemetry.COST_BOUNDS, _COST_TOTAL, f", {_WINDOW_START} as window_start", "window_start,"
        ),
        "window_start",
    ),
)
def _(w):
    start = F.window("started_at", "5 minutes").getField("start").alias("window_start")
    return telemetry.quantiles(telemetry.cost_histogram(_graded(w), [start]), ["window_start"])


@check(
    "tel_in_flight",
    """select ts, cast(sum(sum(step)) over (order by ts) as bigint) as in_flight
from (
  select started_at as ts, 1 as step from {query_log}
  union all select started_at + to_microseconds(latency_us), -1 from {query_log}
) group by ts""",
)
def _(w):
    return telemetry.in_flight(w.query_log)
