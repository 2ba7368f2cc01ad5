import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterstone.operators import admission, querylog

T0 = dt.datetime(2024, 1, 1)


def brute_force(calls, limit, window):
    """Replay every key in time order."""
    out, live = {}, defaultdict(list)
    for key, ts, i in sorted(calls, key=lambda c: (c[1], c[2])):
        live[key] = [t for t in live[key] if t > ts - dt.timedelta(seconds=window)]
        out[i] = len(live[key]) < limit
        if out[i]:
            live[key].append(ts)
    return out


def frame(spark, calls):
    return spark.createDataFrame(calls, "k string, ts timestamp_ntz, id bigint")


def rows_of(df, limit, window):
    out = admission.decide(df, key=F.col("k"), ts=F.col("ts"), id=F.col("id"), limit=limit, window_seconds=window)
    return out.collect()


def decided(df, limit, window):
    return {r.id: r.admitted for r in rows_of(df, limit, window)}


def random_calls(seed, n=400, hours=6, keys=("hot", "hot", "warm", "calm", None)):
    rng = random.Random(seed)
    return [
        (rng.choice(keys), T0 + dt.timedelta(seconds=rng.randrange(hours * 3600), microseconds=rng.choice([0, 0, 5])), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("limit", [1, 3])
@pytest.mark.parametrize("hours", [2, 60])
def test_equals_replay(spark, hours, limit):
    calls = random_calls(limit, hours=hours)
    assert decided(frame(spark, calls), limit, 3600) == brute_force(calls, limit, 3600)


def test_long_silence_and_equal_times(spark):
    at = [0, 0, 0, 3599, 3600, 3600, 50_000, 53_599, 53_600, 200_000]
    calls = [("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(at)]
    for limit in (1, 2):
        assert decided(frame(spark, calls), limit, 3600) == brute_force(calls, limit, 3600)


def test_calm_keys_are_admitted_without_replay(spark):
    calls = [(f"k{i % 50}", T0 + dt.timedelta(minutes=i), i) for i in range(200)]
    assert all(decided(frame(spark, calls), 20, 3600).values())


def test_calls_without_time_are_kept_undecided(spark):
    calls = [("a", T0, 1), ("a", None, 2)]
    assert decided(frame(spark, calls), 1, 3600) == {1: True, 2: None}


def test_repeated_and_null_ids_are_calls_of_their_own(spark):
    calls = [("a", T0, 7), ("a", T0 + dt.timedelta(seconds=1), 7), ("a", T0 + dt.timedelta(seconds=61), 7), ("b", T0, None), ("b", T0, None)]
    got = sorted((r.key, r.ts, r.admitted) for r in rows_of(frame(spark, calls), 1, 60))
    assert got == [
        ("a", T0, True), ("a", T0 + dt.timedelta(seconds=1), False), ("a", T0 + dt.timedelta(seconds=61), True), ("b", T0, False), ("b", T0, True),
    ]


def test_nothing_runs_before_an_action(spark):
    spark.sparkContext.setJobGroup("admission", "")
    admission.decide(frame(spark, random_calls(1)), key=F.col("k"), ts=F.col("ts"), id=F.col("id"), limit=1, window_seconds=60)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("admission")


def test_state_goes_on_across_batches(spark):
    calls = random_calls(5, n=300, keys=("hot",))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert decided(frame(spark, calls), 4, 3600) == brute_force(calls, 4, 3600)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments_begin_after_a_silence_of_one_window(spark):
    at = [0, 50, 99, 198, 299, 1000, 1099, 1199]
    rows = spark.createDataFrame([("a", t, t // 100) for t in at], "key string, us bigint, cell bigint")
    got = sorted((r.cell, r.segment) for r in admission.segments(rows, 100).collect())
    assert got == [(0, 0), (1, 0), (2, 2), (10, 10), (11, 11)]


def test_ttl_hits_do_not_prolong_and_failures_do_not_store(spark):
    rows = [
        (1, "select 1", T0, None),
        (2, "SELECT  1", T0 + dt.timedelta(minutes=50), None),  # hit
        (3, "select 1", T0 + dt.timedelta(minutes=61), None),  # expired: stored again
        (4, "select 2", T0, "boom"),
        (5, "select 2", T0 + dt.timedelta(minutes=1), None),  # the failed run stored nothing
        (6, "select 2", T0 + dt.timedelta(minutes=2), None),
    ]
    log = spark.createDataFrame(rows, "request_id bigint, sql string, started_at timestamp_ntz, error string")
    hits = {r.request_id: r.hit for r in querylog.ttl_hits(log).collect()}
    assert hits == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


@pytest.mark.parametrize("limit", [1, 2, 5])
@pytest.mark.parametrize("rows", [1, 9, 60])
def test_blocks_of_an_unbroken_key_equal_replay(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(admission, "BLOCK_ROWS", rows)
    calls = random_calls(7 * limit + rows, n=600, hours=12, keys=("hot", "hot", "hot", None, "calm"))
    assert decided(frame(spark, calls), limit, 1800) == brute_force(calls, limit, 1800)


def test_blocks_respect_settled_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = sorted((rng.randrange(6000), rng.random() < 0.1, i) for i in range(900))
    slim = spark.createDataFrame([(i, "a", us, settled) for us, settled, i in rows], "id bigint, key string, us bigint, settled boolean")
    for limit in (1, 3):
        whole = {r.id: r.admitted for r in admission.decide_slim(slim, limit, 100).collect()}
        monkeypatch.setattr(admission, "BLOCK_ROWS", 40)
        cut = admission.decide_slim(slim, limit, 100)
        assert {r.id: r.admitted for r in cut.collect()} == whole and all(whole[i] for _, settled, i in rows if settled)
        monkeypatch.undo()


def test_exits_of_a_block_are_those_of_a_replay():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        us = np.sort(rng.integers(1000, 4000, n))
        entries, exits = admission.single_exits(us, 250)
        assert (np.diff(entries) > 0).all()
        for t in range(int(us[0]) - 3, int(us[0]) + 251):
            last, free = None, t
            for u in us:
                if u >= free:
                    last, free = u, u + 250
            at = np.searchsorted(entries, t)
            assert (exits[at] if at < len(exits) else None) == last


def test_a_long_unbroken_key_is_decided_in_many_tasks(spark):
    """A million calls of one key, two a second: more blocks than one, each decided on its own."""
    n = 1_000_000
    calls = spark.range(n, numPartitions=8).select(F.col("id"), F.lit("hot").alias("key"), (F.col("id") * 500_000).alias("us"), F.lit(False).alias("settled"))
    for limit in (1, 20):
        out = admission.decide_slim(calls, limit, 3_600_000_000)
        got = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("id").alias("n"), F.sum(F.col("admitted").cast("int")).alias("admitted")).collect()
        # An hour is 7,200 calls, so calls are admitted in runs of `limit` at the start of each hour.
        assert sum(r.n for r in got) == n and sum(r.admitted for r in got) == limit * (-(-n // 7200))
        assert sum(1 for r in got if r.n) > 1 and max(r.n for r in got) < n // 2


def test_the_stream_reads_sorted_blocks(spark):
    """The last step relies on its input being dealt by block and sorted by time: nothing may stand between."""
    calls = frame(spark, random_calls(2))
    out = admission.decide(calls, key=F.col("k"), ts=F.col("ts"), id=F.col("id"), limit=2, window_seconds=60)
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "MapInArrow" in line and "carried" in line)
    below = []
    for line in plan[at + 1 :]:
        below.append(line.strip(" :+-*()0123456789").split(" ")[0].split("(")[0])
        if below[-1] == "Window":
            break
    assert set(below[:-1]) <= {"Project"} and below[-1] == "Window"
    ordered = plan[at + len(below)]
    assert "us#" in ordered and "settled#" in ordered and "block#" in ordered
    full = out._jdf.queryExecution().executedPlan().toString()
    part = full[full.index("Window [row_number") :]
    assert part.index("Sort [key") < part.index("Exchange")
