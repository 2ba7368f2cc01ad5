"""Streaming telemetry: tumbling, sliding and session windows over the query log.

Event time is the request start. In append mode a watermark bounds the state and drops what arrives later than the delay;
a window comes out once, after the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.session import new_scratch
from meterstone.sources import query_log
from meterstone.sources.adapters import TABLES

DELAY = "10 minutes"
TUMBLING = "5 minutes"
SLIDING = ("5 minutes", "15 seconds")
SESSION_GAP = "30 minutes"

EVENTS = TABLES["events"]


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a streaming query: sessions of a busy caller are merged before the shuffle."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    for name in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        value = spark.conf.get(name, None)
        if value is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def log_source(spark: SparkSession, folder: str, files: str) -> tuple[str, str]:
    """(path, file pattern) of a stream over a table that is one file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{files}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no {files} in {folder}")
    if any(status.isDirectory() for status in found):
        return f"{folder.rstrip('/')}/{files}", "*.parquet"
    return folder, files


def read_log(
    spark: SparkSession, folder: str, *, files: str = "events.parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """The query log as a stream of event files, with event time as a zoned timestamp, which watermarks need."""
    path, pattern = log_source(spark, folder, files)
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = query_log.from_events(reader.parquet(path))
    return log.withColumn("event_time", F.col("started_at").cast("timestamp"))


def tumbling(log: DataFrame, delay: str = DELAY, window: str = TUMBLING) -> DataFrame:
    return (
        log.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("w"), "intent")
        .agg(F.count("*").alias("requests"), F.sum("latency_us").alias("latency_us"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "intent",
            "requests",
            "latency_us",
        )
    )


def sliding(log: DataFrame, delay: str = DELAY, window: str = SLIDING[0], step: str = SLIDING[1]) -> DataFrame:
    """Counts per step first, then windows over the steps: a request is never copied into each of its windows."""
    steps = (
        log.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", step).alias("step"), "intent")
        .agg(F.count("*").alias("n"))
    )
    return (
        steps.groupBy(F.window("step", window, step).alias("w"), "intent")
        .agg(F.sum("n").alias("requests"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "intent", "requests")
    )


def sessions(log: DataFrame, delay: str = DELAY, gap: str = SESSION_GAP) -> DataFrame:
    return (
        log.withWatermark("event_time", delay)
        .groupBy(F.session_window("event_time", gap).alias("w"), "caller")
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("session_start"),
            F.col("w.end").cast("timestamp_ntz").alias("session_end"),
            "caller",
            "requests",
        )
    )


def append_available(result: DataFrame, path: str, state: str) -> None:
    """Process what has arrived since the last call with the same state, append it to ``path`` and stop."""
    writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def run_to_table(result: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Process what is there, append to a fresh table in the shared folder, and read it back as a batch."""
    path = new_scratch(spark, label)
    append_available(result, path, new_scratch(spark, f"{label}-state"))
    return spark.read.schema(result.schema).parquet(path)


def run_update(cells: DataFrame, keys: list[str], spark: SparkSession, label: str) -> DataFrame:
    """Update mode: a trigger writes the cells that it changed; read back, each cell has its last value.

    The state is one row per cell, and a trigger's work follows its own calls, not all cells.
    """
    path = new_scratch(spark, label)

    def changed(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = cells.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", new_scratch(spark, f"{label}-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{cells.schema.toDDL()}, epoch int").parquet(path)
    last = F.max_by(F.struct(*[c for c in cells.columns if c not in keys]), "epoch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def run_complete(result: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Complete mode: every trigger replaces the whole result; windows still open are part of it.

    All windows stay in the state for as long as the query runs, so it suits reports over a bounded stretch of the log.
    """
    written: list[str] = []

    def replace(batch: DataFrame, epoch: int) -> None:
        path = new_scratch(spark, f"{label}-{epoch}")
        batch.write.parquet(path)
        written.append(path)

    query = (
        result.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", new_scratch(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(written[-1])
