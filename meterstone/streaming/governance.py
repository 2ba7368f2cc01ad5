"""Streaming governance: audit append, repeats within the result store's lifetime, and the per-key throttle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterstone.functions.clock import SECOND, from_micros, micros
from meterstone.operators import guardrail, querylog
from meterstone.operators.admission import Admission
from meterstone.streaming import windows

#: Beyond one window behind the newest call, accepted calls are kept this long for late arrivals.
LATENESS_SECONDS = 600
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def audit(log: DataFrame) -> DataFrame:
    """Audit rows of a stream; a projection, so any append sink takes it."""
    return guardrail.audit_records(guardrail.with_verdict(log))


class Quota(StatefulProcessor):
    """The accepted calls of one key that can still matter, until a timer says that none does."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], na_position="first", ignore_index=True)
        held = np.array(self.live.get()[0] if self.live.exists() else [], np.int64)
        us = np.concatenate([held, calls["us"].to_numpy(np.int64)])
        order = np.argsort(us, kind="stable")  # what was accepted before stands before a new call of its instant
        flags = np.empty(len(us), bool)
        flags[order] = Admission(self.limit, self.window_us).decide(us[order], order < len(held))
        accepted = np.sort(us[flags])
        self._keep(accepted[accepted > us.max() - self.window_us - LATENESS_SECONDS * SECOND])
        calls["admitted"] = flags[len(held) :]
        yield calls[["id", "key", "us", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        return iter(())

    def _keep(self, accepted: np.ndarray) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not len(accepted):
            self.live.clear()
            return
        self.live.update((accepted.tolist(),))
        self.handle.registerTimer(int(accepted[-1] + self.window_us) // 1000 + LATENESS_SECONDS * 1000)

    def close(self) -> None:
        pass


def admitted_by_key(log: DataFrame, spark: SparkSession, key: Column, limit: int, window_seconds: int, label: str) -> DataFrame:
    """(id, key, ts, admitted) of the calls that are there, decided with one keyed state per key.

    A trigger reads and writes the state of the keys that it touches, and nothing of the others. The state is the accepted
    calls of a window and ``LATENESS_SECONDS`` more, for late ones; an event-time timer removes it when none of them can matter.
    Calls in order of time get the same decisions however they are cut into triggers; calls older than the watermark are
    dropped. A key's calls of one trigger are sorted in one task's memory, so triggers are to be bounded by
    ``max_files_per_trigger``; calls that lie there already are for the batch operator.
    """
    own = log.sparkSession
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    calls = log.where(F.col("started_at").isNotNull()).withWatermark("event_time", f"{LATENESS_SECONDS} seconds")
    calls = calls.select(F.col("request_id").alias("id"), key.cast("string").alias("key"), micros(F.col("started_at")).alias("us"), "event_time")
    decided = calls.groupBy("key").transformWithStateInPandas(
        Quota(limit, window_seconds * SECOND), "id bigint, key string, us bigint, admitted boolean", "Append", "EventTime"
    )
    out = windows.run_to_table(decided, spark, label)
    return out.select("id", "key", from_micros(F.col("us")).alias("ts"), "admitted")


def first_seen(log: DataFrame, keys: list[str], lifetime: str) -> DataFrame:
    """Stream of the calls whose keys were not seen within the lifetime, by Spark's own dropping of duplicates.

    It differs from ``first_runs``: a key is forgotten when the watermark, which trails the newest call by the lifetime and
    moves between triggers only, has passed its call by the lifetime. So a repeat may be dropped up to a lifetime and a trigger
    too long, never too short.
    """
    return log.withWatermark("event_time", lifetime).dropDuplicatesWithinWatermark(keys)


def first_runs(log: DataFrame, spark: SparkSession, ttl_seconds: int = querylog.CACHE_TTL_SECONDS) -> DataFrame:
    """(request_id, fingerprint, started_at) of the runs that no stored result answers."""
    runs = log.where(~querylog.has_error())
    fp = querylog.fingerprint(F.col("sql"))
    out = admitted_by_key(runs, spark, fp, 1, ttl_seconds, "first-runs").where("admitted").drop("admitted")
    return out.withColumnsRenamed({"id": "request_id", "key": "fingerprint", "ts": "started_at"})


def throttle(
    log: DataFrame,
    spark: SparkSession,
    key: str,
    limit: int = querylog.CALLS_PER_WINDOW,
    window_seconds: int = querylog.CALL_WINDOW_SECONDS,
) -> DataFrame:
    """Accepted and refused calls per key."""
    out = admitted_by_key(log, spark, F.col(key), limit, window_seconds, "throttle")
    return out.withColumnsRenamed({"id": "request_id", "key": "throttle_key", "ts": "started_at"})
