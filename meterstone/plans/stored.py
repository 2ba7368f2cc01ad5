"""Staging and marts written once per input and read by everything downstream.

A table lives under a stamp of the input files (path, length, modification time), the settings and the source of the rules,
so a changed input or rule gives a new table and nothing stale is read. A build goes to a folder of its own and is moved
into place when it is complete; of two sessions that build at once, one wins and the other reads its result.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession

from meterstone import config
from meterstone.functions import clock, numeric, text
from meterstone.operators import staging
from meterstone.plans import funnel, retention, revenue, user_metrics
from meterstone.plans.warehouse import Warehouse
from meterstone.session import scratch_root
from meterstone.sources import adapters
from meterstone.sources.adapters import TABLES

#: Leading sort columns inside the files, so that row groups can be skipped by date.
ORDER = {
    "stg_users": ("signup_date", "user_id"),
    "stg_events": ("event_date", "user_id"),
    "stg_subscriptions": ("started_at", "user_id"),
    "stg_payments": ("payment_date", "user_id"),
    "mart_user_metrics": ("metric_date", "plan"),
    "mart_cohort_retention": ("cohort_month", "retention_period"),
    "mart_revenue_metrics": ("metric_month", "plan"),
    "mart_funnel_analysis": ("cohort_month", "plan"),
}


#: Modules whose source decides what staging and marts hold.
_RULES = (adapters, clock, config, funnel, numeric, retention, revenue, staging, text, user_metrics)


@cache
def rules_stamp() -> str:
    """A stamp of the rules' own source: nobody has to remember to raise a version."""
    return hashlib.sha256("\n".join(inspect.getsource(m) for m in _RULES).encode()).hexdigest()[:24]


def listed_files(spark: SparkSession, place: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of a table that is one file or a folder of them, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return sorted(f for f in files if f[0].rsplit("/", 1)[-1][:1] not in ("_", "."))


class StoredWarehouse(Warehouse):
    """The same frames as ``Warehouse``, read from written tables; a table is built when it is first asked for."""

    def _path(self, name: str):
        """A path of the file system that Spark itself reads, whichever store that is."""
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @cached_property
    def stamp(self) -> str:
        parts = [rules_stamp(), repr(self.settings)]
        for name in sorted(TABLES):
            parts += map(repr, listed_files(self.spark, f"{self.sf_dir.rstrip('/')}/{name}.parquet"))
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        place = f"{scratch_root(self.spark)}/layer/{self.stamp}/{name}"
        target = self._path(place)
        files = self._files(target)
        if not files.exists(target):
            fresh = self._path(f"{scratch_root(self.spark)}/layer/{self.stamp}/.building-{name}-{uuid.uuid4().hex}")
            files.mkdirs(target.getParent())
            built = build()
            built = built.sortWithinPartitions(*ORDER[name]) if name in ORDER else built
            built.write.parquet(fresh.toString())
            if files.exists(target) or not files.rename(fresh, target):
                files.delete(fresh, True)
        return self.spark.read.parquet(place)

    @cached_property
    def users(self) -> DataFrame:
        return self.stored("stg_users", lambda: Warehouse.users.func(self))

    @cached_property
    def events(self) -> DataFrame:
        return self.stored("stg_events", lambda: Warehouse.events.func(self))

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.stored("stg_subscriptions", lambda: Warehouse.subscriptions.func(self))

    @cached_property
    def payments(self) -> DataFrame:
        return self.stored("stg_payments", lambda: Warehouse.payments.func(self))

    @cached_property
    def payment_months(self) -> DataFrame:
        return self.stored("payment_months", lambda: revenue.payments_by_month(self.payments))

    @cached_property
    def calendar(self) -> revenue.Calendar:
        return Warehouse.calendar.func(self)

    @cached_property
    def plan_steps(self) -> DataFrame:
        return self.stored("plan_steps", lambda: Warehouse.plan_steps.func(self))

    @cached_property
    def user_metrics(self) -> DataFrame:
        return self.stored("mart_user_metrics", lambda: Warehouse.user_metrics.func(self))

    @cached_property
    def cohort_retention(self) -> DataFrame:
        return self.stored("mart_cohort_retention", lambda: Warehouse.cohort_retention.func(self))

    @cached_property
    def revenue_metrics(self) -> DataFrame:
        return self.stored("mart_revenue_metrics", self._revenue)

    def _revenue(self) -> DataFrame:
        return revenue.revenue_metrics(self.users, self.subscriptions, self.payments, self.calendar, self.settings, self.payment_months, self.plan_steps)

    @cached_property
    def funnel_analysis(self) -> DataFrame:
        return self.stored("mart_funnel_analysis", lambda: Warehouse.funnel_analysis.func(self))
