"""Queries for metric series and anomalies."""

from pyspark.sql import functions as F

from meterstone.checks.registry import stored_check as check
from meterstone.operators import anomaly
from meterstone.session import new_scratch, through_table
from meterstone.sources import sinks


def _series(w):
    return anomaly.union(
        anomaly.metric_series(w.user_metrics, w.revenue_metrics), anomaly.order_value_series(w.table("orders"))
    )


def _alerts(w):
    # Both detectors read the series, so it is written once instead of computing the marts twice.
    return anomaly.detect(through_table(_series(w), "series"))


def _feed(w):
    # The scan is dated to the day after each point so that results do not depend on the wall clock.
    detected = F.date_add("ds", 1).cast("timestamp_ntz")
    return anomaly.feed_records(_alerts(w), detected)


@check("metric_series", "from {series}")
def _(w):
    return _series(w)


@check("anomaly_sigma", "from {sigma}")
def _(w):
    return anomaly.sigma(_series(w))


@check("anomaly_seasonal", "from {seasonal}")
def _(w):
    return anomaly.seasonal(through_table(_series(w), "series"))


@check("anomaly_combined", "from {alerts}")
def _(w):
    return _alerts(w)


@check(
    "anomaly_commentary",
    """select metric, ds, 'Auto-flagged: ' || printf('%+.1f', deviation_pct) || '% deviation on ' || ds as commentary,
  'Anomaly detected: ' || metric || ' was ' || printf('%+.1f', deviation_pct) || '% from expected on ' || ds || '.'
    as fallback
from {alerts}""",
)
def _(w):
    return anomaly.with_commentary(_alerts(w)).select("metric", "ds", "commentary", "fallback")


@check("anomaly_feed_append", "from {feed}")
def _(w):
    """Two scans append the same findings to one table; readers drop the repeats by their hash id."""
    path = new_scratch(w.spark, "anomaly_feed")
    feed = _feed(w)
    for _ in range(2):
        sinks.append(feed, path)
    return w.spark.read.schema(feed.schema).parquet(path).dropDuplicates(["id"])


@check(
    "anomaly_approved",
    "select * replace (direction = 'spike' as commentary_approved) from {feed}",
)
def _(w):
    feed = _feed(w)
    approvals = feed.where(F.col("direction") == "spike").select("id")
    return anomaly.apply_approvals(feed, approvals)


@check("anomaly_latest", "from {feed} order by detected_at desc, anomaly_date desc, id limit 20")
def _(w):
    return anomaly.latest(_feed(w))
