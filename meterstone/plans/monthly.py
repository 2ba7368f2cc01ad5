"""Staging of events and the daily user mart, kept by month: a changed input file rebuilds the months that it holds.

The layer is two tables with one folder a month and a manifest of the event files that went into them, with the months that
each file holds. A refresh compares the manifest with the files that are there now. The months of files that came, went or
changed are staged again, from the files that hold them and no others, and replace their folders; the mart of those months
is made from the new folders. Other months are neither read nor written. A change of users, orders, settings or rules
concerns every month and begins the layer anew.

The manifest is written last. A refresh that dies before leaves the old one, and the next refresh repeats the same months.
Two refreshes at once are not guarded against each other.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.operators import staging
from meterstone.plans.stored import listed_files, rules_stamp
from meterstone.plans.user_metrics import user_metrics
from meterstone.plans.warehouse import Warehouse
from meterstone.session import scratch_root
from meterstone.sources import adapters

_MANIFEST = "path string, length bigint, modified bigint, months array<date>"
#: Tables that every month depends on.
_COMMON = ("customer", "nation", "orders")
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"

File = tuple[str, int, int]


def _within(months: list[dt.date | None]) -> Column:
    """A filter on the partition column, which prunes the months that are not listed."""
    known = [m for m in months if m is not None]
    inside = F.col("event_month").isin(known) if known else F.lit(False)
    return inside | F.col("event_month").isNull() if None in months else inside


class MonthlyUserMetrics:
    """``events_path`` is a parquet file or a folder of part files with the columns of the events table."""

    def __init__(self, warehouse: Warehouse, events_path: str):
        self.warehouse, self.spark, self.events_path = warehouse, warehouse.spark, events_path.rstrip("/")
        parts = [rules_stamp(), repr(warehouse.settings), self.events_path]
        for name in _COMMON:
            parts += map(repr, listed_files(self.spark, f"{warehouse.sf_dir.rstrip('/')}/{name}.parquet"))
        stamp = hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]
        self.root = f"{scratch_root(self.spark)}/monthly/{stamp}"
        self._version = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _recorded(self) -> dict[File, list[dt.date | None]]:
        """Event files of the newest manifest with their months: metadata, a row a file."""
        path, files = self._path("manifest")
        versions = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
        done = [v for v in versions if files.exists(self._path(f"manifest/{v}/_SUCCESS")[0])]
        self._version = int(done[-1]) + 1 if done else 0
        if not done:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{done[-1]}").collect()
        return {(r.path, r.length, r.modified): r.months for r in rows}

    def _staged(self, paths: list[str]) -> DataFrame:
        """Staged events of some event files and of the orders."""
        spark, sf_dir = self.spark, self.warehouse.sf_dir
        schema = adapters.TABLES["events"]
        events = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return staging.stg_events(adapters.raw_events(spark, sf_dir, events), self.warehouse.settings)

    def _months_of(self, paths: list[str]) -> dict[str, list[dt.date | None]]:
        """Months that event files hold, from one grouped pass over their timestamps."""
        if not paths:
            return {}
        events = self.spark.read.schema(adapters.TABLES["events"]).parquet(*paths)
        month = F.trunc(F.to_date("ts"), "MM").alias("month")
        rows = events.groupBy(F.col("_metadata.file_path").alias("path"), month).agg(F.count("*")).collect()
        out: dict[str, list[dt.date | None]] = {_plain(p): [] for p in paths}
        for row in rows:
            out[_plain(row.path)].append(row.month)
        return out

    def refresh(self) -> list[dt.date | None]:
        """Bring the layer up to date and return the months that were built, None for events without a date."""
        recorded = self._recorded()
        now = listed_files(self.spark, self.events_path)
        if self._version and set(recorded) == set(now):
            return []
        came = [f for f in now if f not in recorded]
        found = self._months_of([f[0] for f in came])
        months = {f: recorded[f] if f in recorded else found[_plain(f[0])] for f in now}
        if not self._version:
            self._write("stg_events", self._staged([f[0] for f in now]))
            self._write("mart_user_metrics", user_metrics(self.warehouse.users, self.events))
            built = [r.event_month for r in self.events.select("event_month").distinct().collect()]
        else:
            built = list({m for f in came for m in months[f]} | {m for f, held in recorded.items() if f not in months for m in held})
            # Only the files that hold a month to be built are read again.
            self._rebuild(built, [f[0] for f in now if set(built) & set(months[f])])
        rows = [(*f, held) for f, held in months.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/{self._version:012d}")
        return sorted(built, key=lambda m: (m is None, m or dt.date.min))

    def _rebuild(self, months: list[dt.date | None], sources: list[str]) -> None:
        if not months:
            return
        staged = self._staged(sources).where(_within(months))
        self._write("stg_events", staged)
        self._drop("stg_events", set(months) - _months(staged))
        events = self.events.where(_within(months))
        self._write("mart_user_metrics", user_metrics(self.warehouse.users, events))
        self._drop("mart_user_metrics", set(months) - _months(events.where("is_activity_event and user_id is not null")))

    def _drop(self, name: str, months: set[dt.date | None]) -> None:
        """A month that lost its last row has nothing that replaces its folder."""
        for month in months:
            path, files = self._path(f"{name}/event_month={month or _NULL_FOLDER}")
            files.delete(path, True)

    def _write(self, name: str, df: DataFrame) -> None:
        writer = df.hint("rebalance", "event_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("event_month").parquet(f"{self.root}/{name}")

    def _read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}").select(*like.columns)

    @property
    def events(self) -> DataFrame:
        return self._read("stg_events", self.warehouse.events)

    @property
    def user_metrics(self) -> DataFrame:
        """The mart as of the last refresh; a filter on ``event_month`` reads its months only."""
        return self._read("mart_user_metrics", self.warehouse.user_metrics)


def _months(events: DataFrame) -> set[dt.date | None]:
    return {r.event_month for r in events.select("event_month").distinct().collect()}


def _plain(path: str) -> str:
    """A path without its scheme, as listings and scans spell it differently."""
    return unquote(path.split(":", 1)[-1]).lstrip("/")
