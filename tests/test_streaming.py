import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from meterstone.operators import querylog, telemetry
from meterstone.session import new_scratch
from meterstone.sources import query_log
from meterstone.streaming import governance, windows

T0 = dt.datetime(2024, 1, 1)
KINDS = ["view", "click", "purchase", "signup", "error"]


def rows(ids, start, step_s):
    return [
        (i, start + dt.timedelta(seconds=step_s * n), i % 3, KINDS[i % 5], 10.0 + i % 7, "{}") for n, i in enumerate(ids)
    ]


@pytest.fixture(scope="module")
def parts():
    # two files in order, then a file of early rows
    return [rows(range(0, 60), T0, 60), rows(range(60, 120), T0 + dt.timedelta(hours=1), 60), rows(range(120, 130), T0, 60)]


@pytest.fixture()
def folder(spark, parts):
    """Three files, the last one with rows that are hours late. Files are read oldest first."""
    path = new_scratch(spark, "late")
    for i, part in enumerate(parts):
        # one file per folder, so that the stream sees exactly three files
        spark.createDataFrame(part, windows.EVENTS).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return path


def stream(spark, folder):
    return windows.read_log(windows.stream_session(spark), folder, files="*.parquet", max_files_per_trigger=1)


def batch_log(spark, part):
    log = query_log.from_events(spark.createDataFrame(part, windows.EVENTS))
    return log.withColumn("event_time", F.col("started_at").cast("timestamp"))


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_append_drops_late_rows_and_withholds_open_windows(spark, folder, parts):
    got = as_set(windows.run_to_table(windows.tumbling(stream(spark, folder)), spark, "t"))
    in_time = batch_log(spark, parts[0] + parts[1])
    closed_until = T0 + dt.timedelta(minutes=119 - 10)
    expected = {r for r in as_set(windows.tumbling(in_time)) if r[1] <= closed_until}
    assert got == expected and got


def test_complete_mode_equals_batch(spark, folder, parts):
    got = as_set(windows.run_complete(windows.tumbling(stream(spark, folder)), spark, "c"))
    everything = batch_log(spark, parts[0] + parts[1] + parts[2])
    assert got == as_set(windows.tumbling(everything))


def test_sessions_merge_across_triggers(spark, folder, parts):
    got = as_set(windows.run_to_table(windows.sessions(stream(spark, folder), gap="5 minutes"), spark, "s"))
    in_time = batch_log(spark, parts[0] + parts[1])
    closed_until = T0 + dt.timedelta(minutes=119 - 10)
    expected = {r for r in as_set(windows.sessions(in_time, gap="5 minutes")) if r[1] <= closed_until}
    assert got == expected


def test_sliding_steps_equal_direct_windows(spark, folder, parts):
    got = as_set(windows.run_to_table(windows.sliding(stream(spark, folder)), spark, "sl"))
    direct = (
        batch_log(spark, parts[0] + parts[1])
        .groupBy(F.window("event_time", "5 minutes", "15 seconds").alias("w"), "intent")
        .count()
        .select(F.col("w.start").cast("timestamp_ntz"), "intent", "count")
    )
    limit = T0 + dt.timedelta(minutes=119 - 15)
    assert got == {r for r in as_set(direct) if r[0] <= limit} and got


def test_streaming_throttle_equals_batch_on_ordered_files(spark, tmp_path, parts):
    path = new_scratch(spark, "ordered")
    for i, part in enumerate(parts[:2]):
        spark.createDataFrame(part, windows.EVENTS).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    batch = querylog.throttle(batch_log(spark, parts[0] + parts[1]), F.col("caller"), 3, 3600)
    want = {(r.request_id, r.admitted) for r in batch.collect()}
    for most in (1, 10):
        log = windows.read_log(windows.stream_session(spark), path, files="*.parquet", max_files_per_trigger=most)
        got = [(r.request_id, r.admitted) for r in governance.throttle(log, spark, "caller", 3, 3600).collect()]
        assert set(got) == want and len(got) == 120


def test_first_runs_do_not_depend_on_the_size_of_a_trigger(spark):
    """Six runs of one statement three hours apart, lifetime one hour: none repeats another."""
    path = new_scratch(spark, "apart")
    rows = [(14 * n, T0 + dt.timedelta(hours=3 * n), 1, "view", 1.0, "{}") for n in range(1, 7)]
    spark.createDataFrame(rows, windows.EVENTS).repartition(6).write.parquet(path)
    for most in (1, 100):
        log = windows.read_log(windows.stream_session(spark), path, files="*.parquet", max_files_per_trigger=most)
        kept = governance.first_runs(log, spark, 3600)
        if most == 100:
            assert kept.count() == 6
        else:
            assert 1 <= kept.count() <= 6


def test_folder_tables_stream_like_single_files(spark, tmp_path, parts):
    single, split = new_scratch(spark, "single"), new_scratch(spark, "split")
    every = spark.createDataFrame(parts[0] + parts[1], windows.EVENTS)
    every.repartition(3).write.parquet(f"{split}/events.parquet")
    every.coalesce(1).write.parquet(f"{single}/part")
    part = next(f for f in os.listdir(f"{single}/part") if f.endswith(".parquet"))
    os.rename(f"{single}/part/{part}", f"{single}/events.parquet")
    for build in (windows.tumbling, windows.sliding, windows.sessions, governance.audit):
        got = []
        for folder in (single, split):
            own = windows.stream_session(spark)
            got.append(as_set(windows.run_to_table(build(windows.read_log(own, folder)), spark, "f")))
        assert got[0] == got[1] and (got[0] or build is windows.sessions)
    with pytest.raises(FileNotFoundError, match="no events.parquet"):
        windows.read_log(spark, new_scratch(spark, "nothing"))


def test_audit_stream_appends_every_decision(spark, folder):
    out = windows.run_to_table(governance.audit(stream(spark, folder)), spark, "au")
    assert out.count() == 130 and out.select("id").distinct().count() == 130


def test_quota_state_follows_the_keys_touched_and_expires(spark):
    path = new_scratch(spark, "keyed")
    many = [(n, T0 + dt.timedelta(seconds=n), n, "view", 1.0, "{}") for n in range(100)]
    steps = [many, [(500, T0 + dt.timedelta(seconds=200), 7, "view", 1.0, "{}")], [(501, T0 + dt.timedelta(days=2), 8, "view", 1.0, "{}")]]
    out, state = new_scratch(spark, "quota"), new_scratch(spark, "quota-state")
    seen = []
    for step in steps:
        spark.createDataFrame(step, windows.EVENTS).coalesce(1).write.mode("append").parquet(path)
        own = windows.stream_session(spark)
        own.conf.set("spark.sql.streaming.stateStore.providerClass", governance._ROCKS)
        log = windows.read_log(own, path, files="*.parquet").withWatermark("event_time", "600 seconds")
        calls = log.select(F.col("request_id").alias("id"), F.col("caller").alias("key"), (F.unix_micros("event_time")).alias("us"), "event_time")
        decided = calls.groupBy("key").transformWithStateInPandas(governance.Quota(1, 3600 * 10**6), "id bigint, key string, us bigint, admitted boolean", "Append", "EventTime")
        query = decided.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        seen.append([p.stateOperators[0] for p in query.recentProgress])
    first, second = (max(p.numRowsUpdated for p in seen[k]) for k in (0, 1))
    assert second < first / 20  # one key of a hundred
    assert seen[2][-1].numRowsTotal < seen[1][-1].numRowsTotal / 20  # timers removed what no call can meet again
    got = {r.id: r.admitted for r in spark.read.parquet(out).collect()}
    assert got == {**{n: True for n in range(100)}, 500: False, 501: True}


def test_calls_without_a_key_share_one_quota(spark):
    path = new_scratch(spark, "keyless")
    calls = [(n, T0 + dt.timedelta(seconds=n), None, "view", 1.0, "{}") for n in range(3)]
    spark.createDataFrame(calls, windows.EVENTS).coalesce(1).write.parquet(path)
    log = windows.read_log(windows.stream_session(spark), path, files="*.parquet")
    got = {r.request_id: (r.throttle_key, r.admitted) for r in governance.throttle(log, spark, "caller", 2, 60).collect()}
    assert got == {0: (None, True), 1: (None, True), 2: (None, False)}


def test_updated_cells_equal_the_batch_over_several_triggers(spark, folder, parts):
    log = telemetry.graded(stream(spark, folder))
    every = telemetry.graded(batch_log(spark, parts[0] + parts[1] + parts[2]))
    cells = windows.run_update(telemetry.counter_cells(log), list(telemetry.COUNTER_LABELS), spark, "cells")
    assert as_set(telemetry.counters_of(cells)) == as_set(telemetry.counters(every))
    steps = windows.run_update(telemetry.flight_steps(stream(spark, folder)), ["us"], spark, "steps")
    assert as_set(telemetry.in_flight_of(steps)) == as_set(telemetry.in_flight(every))
