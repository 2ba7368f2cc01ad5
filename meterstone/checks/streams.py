"""Streaming queries. Append mode shows the windows that the final watermark has closed."""

import datetime as dt

from pyspark.sql import functions as F

from meterstone.checks import telemetry as _batch  # noqa: F401  registers the batch queries first
from meterstone.checks.logs import admission_sql, throttle_sql
from meterstone.checks.registry import TEXTS, check
from meterstone.operators import querylog, telemetry
from meterstone.session import new_scratch
from meterstone.streaming import governance, windows


def _log(w):
    return windows.read_log(windows.stream_session(w.spark), w.sf_dir)


_CLOSED = "(select max(started_at) - interval 10 minutes from {query_log})"


@check(
    "stream_tumbling",
    f"""from (
  select time_bucket(interval 5 minutes, started_at) as window_start,
    time_bucket(interval 5 minutes, started_at) + interval 5 minutes as window_end,
    intent, count(*) as requests, cast(sum(latency_us) as bigint) as latency_us
  from {{query_log}} group by all
) where window_end <= {_CLOSED}""",
)
def _(w):
    return windows.run_to_table(windows.tumbling(_log(w)), w.spark, "tumbling")


@check(
    "stream_sliding",
    f"""select window_start, intent, count(*) as requests
from (
  select *, unnest(generate_series(
    time_bucket(interval 15 seconds, started_at) - interval 285 seconds,
    time_bucket(interval 15 seconds, started_at), interval 15 seconds)) as window_start
  from {{query_log}}
) where window_start + interval 5 minutes <= {_CLOSED} group by all""",
)
def _(w):
    return windows.run_to_table(windows.sliding(_log(w)), w.spark, "sliding")


@check(
    "stream_session",
    f"""from (
  select min(started_at) as session_start, max(started_at) + interval 30 minutes as session_end, caller,
    count(*) as requests
  from (
    select *, sum(cast(gap as integer)) over (partition by caller order by started_at, request_id) as nr
    from (
      select *, ifnull(started_at - lag(started_at) over (partition by caller order by started_at, request_id)
        >= interval 30 minutes, true) as gap
      from {{query_log}}
    )
  ) group by caller, nr
) where session_end <= {_CLOSED}""",
)
def _(w):
    return windows.run_to_table(windows.sessions(_log(w)), w.spark, "sessions")


@check(
    "stream_audit",
    """select md5(cast(request_id as varchar)) as id, started_at as checked_at, left(question, 500) as query_text,
  intent, passed, ifnull(rejection_reason, '') as failure_reason from {verdicts}""",
)
def _(w):
    return windows.run_to_table(governance.audit(_log(w)), w.spark, "audit")


_LATE = "event_id % 10 = 0"
_MARK = f"(select max(ts) - interval 10 minutes from events where not ({_LATE}))"


@check(
    "stream_tumbling_late",
    f"""from (
  select time_bucket(interval 5 minutes, started_at) as window_start,
    time_bucket(interval 5 minutes, started_at) + interval 5 minutes as window_end,
    intent, count(*) as requests, cast(sum(latency_us) as bigint) as latency_us
  from {{query_log}}
  where not ({_LATE.replace("event_id", "request_id")})
    or time_bucket(interval 5 minutes, started_at) + interval 5 minutes > {_MARK}
  group by all
) where window_end <= (select max(started_at) - interval 10 minutes from {{query_log}})""",
)
def _(w):
    """Files arrive one after the other: old calls, the last day, then a tenth of all calls late. Windows that the
    watermark has closed by then drop them."""
    spark = windows.stream_session(w.spark)
    events = w.table("events")
    split = events.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
    late = F.expr(_LATE)
    arriving = new_scratch(w.spark, "arriving")
    out, state = new_scratch(w.spark, "late"), new_scratch(w.spark, "late-state")
    for part in (~late & (F.col("ts") < F.lit(split)), ~late & (F.col("ts") >= F.lit(split)), late):
        events.where(part).write.mode("append").parquet(f"{arriving}/events.parquet")
        result = windows.tumbling(windows.read_log(spark, arriving))
        windows.append_available(result, out, state)
    return w.spark.read.schema(result.schema).parquet(out)


# A stream that has seen all calls agrees with the SQL of the batch query.
@check("stream_counters", TEXTS["tel_counters"])
def _(w):
    cells = telemetry.counter_cells(telemetry.graded(_log(w)))
    return telemetry.counters_of(windows.run_update(cells, list(telemetry.COUNTER_LABELS), w.spark, "counters"))


@check("stream_latency_quantiles", TEXTS["tel_quantiles"])
def _(w):
    cells = telemetry.latency_cells(telemetry.graded(_log(w)))
    return telemetry.quantiles(telemetry.latency_buckets(windows.run_update(cells, ["intent"], w.spark, "latency")), ["intent"])


@check("stream_in_flight", TEXTS["tel_in_flight"])
def _(w):
    return telemetry.in_flight_of(windows.run_update(telemetry.flight_steps(_log(w)), ["us"], w.spark, "in-flight"))


@check("stream_throttle", throttle_sql("caller", 3, 86_400))
def _(w):
    spark = windows.stream_session(w.spark)
    return governance.throttle(windows.read_log(spark, w.sf_dir), spark, "caller", 3, 86_400)


@check(
    "stream_first_runs",
    admission_sql(
        "(from {fingerprints} where error is null)",
        "fingerprint",
        1,
        querylog.CACHE_TTL_SECONDS,
        "select request_id, k as fingerprint, started_at from steps where rn > 0 and admitted",
    ),
)
def _(w):
    spark = windows.stream_session(w.spark)
    return governance.first_runs(windows.read_log(spark, w.sf_dir), spark, querylog.CACHE_TTL_SECONDS)


_FIRST_SEEN_DAYS = 5
_PART = "(epoch_us(started_at) - epoch_us(from_)) // 864000000000"


@check(
    "stream_first_seen",
    f"""/*recursive*/ , calls as (
  select *, cast({_PART} as bigint) as part
  from (select request_id, caller, fingerprint, started_at, (select min(started_at) from {{query_log}}) as from_ from {{fingerprints}})
),
firsts as (
  select caller, fingerprint, part, min_by(request_id, (started_at, request_id)) as request_id, min(started_at) as started_at
  from calls group by all
),
marks as (
  select p.part, max(c.started_at) - interval {_FIRST_SEEN_DAYS} days as mark
  from (select distinct part from calls) p join calls c on c.part < p.part group by all
),
walk as (
  select cast(-1 as bigint) as part, caller, fingerprint, cast(null as bigint) as request_id, cast(null as timestamp) as seen, false as new
  from (select distinct caller, fingerprint from calls)
  union all
  select w.part + 1, w.caller, w.fingerprint, f.request_id,
    case when f.started_at is not null and not alive then f.started_at when alive then w.seen end, f.started_at is not null and not alive
  from (
    select w.*, w.seen is not null and (m.mark is null or w.seen + interval {_FIRST_SEEN_DAYS} days > m.mark) as alive
    from walk w left join marks m on m.part = w.part + 1
  ) w left join firsts f on f.caller = w.caller and f.fingerprint = w.fingerprint and f.part = w.part + 1
  where w.part < (select max(part) from calls)
)
select request_id, caller, fingerprint from walk where new""",
)
def _(w):
    """Ten days of calls arrive at a time, in order; Spark drops what it has seen within five days."""
    spark = windows.stream_session(w.spark)
    events = w.table("events")
    start, end = events.agg(F.min("ts"), F.max("ts")).first()
    arriving = new_scratch(w.spark, "arriving")
    out, state = new_scratch(w.spark, "first-seen"), new_scratch(w.spark, "first-seen-state")
    for k in range((end - start) // dt.timedelta(days=10) + 1):
        after, before = (start + dt.timedelta(days=10 * n) for n in (k, k + 1))
        part = events.where((F.col("ts") >= F.lit(after)) & (F.col("ts") < F.lit(before)))
        part.orderBy("ts", "event_id").coalesce(1).write.mode("append").parquet(f"{arriving}/events.parquet")
        log = windows.read_log(spark, arriving).withColumn("fingerprint", querylog.fingerprint(F.col("sql")))
        result = governance.first_seen(log, ["caller", "fingerprint"], f"{_FIRST_SEEN_DAYS} days").select("request_id", "caller", "fingerprint")
        windows.append_available(result, out, state)
    return w.spark.read.schema(result.schema).parquet(out)
