import datetime as dt
import random

from pyspark.sql import functions as F

from meterstone.operators import querylog, telemetry

T0 = dt.datetime(2024, 1, 1)


def test_in_flight_equals_brute_force(spark):
    rng = random.Random(1)
    calls = [(T0 + dt.timedelta(seconds=rng.randrange(900)), rng.randrange(0, 90_000_000, 500_000)) for _ in range(120)]
    log = spark.createDataFrame(calls, "started_at timestamp_ntz, latency_us bigint")
    got = {r.ts: r.in_flight for r in telemetry.in_flight(log, cell_seconds=20).collect()}
    ends = [(s, s + dt.timedelta(microseconds=us)) for s, us in calls]
    instants = {t for pair in ends for t in pair}
    assert set(got) == instants
    for t in instants:
        assert got[t] == sum(s <= t for s, _ in ends) - sum(e <= t for _, e in ends)


def test_quantiles_interpolate_inside_the_bucket(spark):
    rows = [(0, 1.0, 2, 10), (1, 2.0, 8, 10), (2, None, 10, 10)]
    buckets = spark.createDataFrame(rows, "bucket bigint, bound double, cumulative bigint, observations bigint")
    got = {r.quantile: r.value for r in telemetry.quantiles(buckets, [], (0.1, 0.5, 0.95)).collect()}
    assert got == {0.1: 0.5, 0.5: 1.5, 0.95: 2.0}


def test_empty_log(spark):
    log = spark.createDataFrame([], "cache_hit boolean")
    row = telemetry.hit_ratio(log).first()
    assert (row.hits, row.requests, row.hit_ratio) == (0, 0, None)


def test_sliding_windows_count_every_request_in_each_window(spark):
    log = spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=s), 1) for s in (0, 14, 15, 299, 300)], "started_at timestamp_ntz, cost_micro_usd bigint"
    )
    got = {r.window_start: r.requests for r in telemetry.sliding_rate(log, []).collect()}
    assert got[T0] == 4 and got[T0 + dt.timedelta(seconds=15)] == 3 and got[T0 - dt.timedelta(seconds=285)] == 2
    assert len(got) == 40 and sum(got.values()) == 5 * 20


def test_sliding_windows_cross_blocks_of_time(spark):
    rng = random.Random(3)
    calls = [(T0 + dt.timedelta(seconds=rng.randrange(4000)), rng.choice(["a", None]), rng.randrange(9)) for _ in range(80)]
    log = spark.createDataFrame(calls, "started_at timestamp_ntz, intent string, n bigint")
    measures = [F.count("*").alias("requests"), F.sum("n").alias("n")]
    got = {(r.window_start, r.intent): (r.requests, r.n) for r in telemetry.sliding(log, [F.col("intent")], measures, 300, 21).collect()}
    want = {}
    for at, intent, n in calls:
        last = T0 + dt.timedelta(seconds=(at - T0).total_seconds() // 15 * 15)
        for k in range(20):
            key = last - dt.timedelta(seconds=15 * k), intent
            want[key] = tuple(a + b for a, b in zip(want.get(key, (0, 0)), (1, n)))
    assert got == want


def test_missing_intents_have_a_label(spark):
    log = spark.createDataFrame([(None,), ("",), ("x",)], "intent string")
    assert [r.intent for r in log.select(telemetry.intent_label()).collect()] == ["unknown", "unknown", "x"]


def test_confidence_grades(spark):
    rows = [("x", 5, 0), (None, 0, 0), (None, 5, 1), (None, 201, 0), (None, 200, 0), (None, None, 0), ("", 5, 0)]
    log = spark.createDataFrame(rows, "error string, row_count bigint, retries bigint")
    got = [r.confidence for r in querylog.with_confidence(log).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "low", "high"]


def test_fingerprint_ignores_case_and_spacing(spark):
    df = spark.createDataFrame([("SELECT  1\n",), (" select 1",), ("select 2",)], "sql string")
    got = [r[0] for r in df.select(querylog.fingerprint(F.col("sql"))).collect()]
    assert got[0] == got[1] != got[2]


def test_cap_reports_the_true_size(spark):
    rows = querylog.cap(spark.range(30), [F.col("id").desc()], rows=4).collect()
    assert [r.id for r in rows] == [29, 28, 27, 26] and {r.row_count for r in rows} == {30}
    assert all(r.truncated for r in rows)


def test_merged_sketches_stay_within_their_bound(spark):
    """Skewed latencies, many more than a sketch holds; ranks are held against the exact ones."""
    log = spark.range(120_000).select(
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id") % 6)).alias("started_at"),
        (F.pow(F.rand(3), 6) * 3e7).cast("bigint").alias("latency_us"),
        F.lit("metric_query").alias("intent"),
    )
    steps = telemetry.sketch_steps(log, telemetry.latency_seconds(), [telemetry.intent_label()], 86_400)
    assert steps.count() == 6 and steps.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    ranked = telemetry.sketch_ranks(telemetry.sketched_quantiles(steps, ["intent"], 86_400, 3), log, 86_400, 3).collect()
    assert len(ranked) == 3 * 8 and all(r.within for r in ranked)
    assert max(r.observations for r in ranked) == 60_000
    # A wrong answer is told apart.
    wrong = telemetry.sketched_quantiles(steps, ["intent"], 86_400, 3, (0.5,)).withColumn("quantile", F.lit(0.95))
    assert not any(r.within for r in telemetry.sketch_ranks(wrong, log, 86_400, 3).collect())
