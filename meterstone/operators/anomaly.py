"""Anomalies in metric series (metric, ds, y): rolling sigma, seasonal band, feed and approvals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.numeric import exact_sum, round_to

# Thresholds.
SIGMA_THRESHOLD = 3.0
MIN_HISTORY = 14
WINDOW_ROWS = 30
MIN_POINTS = 7
# A yearly effect needs two years.
YEARLY_DAYS = 730
#: Pieces of equal length that the trend line is made of.
BENDS = 4
#: Added to the diagonal of the trend's equations per point, and the least half width of a band as a share of its largest value.
RIDGE, ROUNDING = 1e-12, 1e-9
BAND_Z = 1.96
FEED_SIZE = 20

FLAG_COLUMNS = (
    "metric",
    "ds",
    "actual_value",
    "expected_value",
    "expected_lower",
    "expected_upper",
    "deviation_pct",
    "z_score",
    "method",
    "direction",
)


def as_series(df: DataFrame, metric: str, ds: Column, y: Column) -> DataFrame:
    """Aggregate to one point per date. Callers pass tables, so points per metric are bounded by the calendar."""
    return df.where(ds.isNotNull()).groupBy(ds.alias("ds")).agg(y.alias("y")).select(
        F.lit(metric).alias("metric"), "ds", "y"
    )


def metric_series(user_metrics: DataFrame, revenue_metrics: DataFrame) -> DataFrame:
    """The two scanned series of the marts: daily active users and monthly recurring revenue."""
    dau = as_series(
        user_metrics, "daily_active_users", F.col("metric_date"), F.sum("daily_active_users").cast("double")
    )
    mrr = as_series(revenue_metrics, "monthly_recurring_revenue", F.col("metric_month"), exact_sum(F.col("mrr")))
    return dau.unionByName(mrr)


def order_value_series(orders: DataFrame) -> DataFrame:
    """Daily and monthly order value, two longer series from the same scan shape."""
    day = F.to_date("o_orderdate")
    daily = as_series(orders, "daily_order_value", day, exact_sum(F.col("o_totalprice")))
    monthly = as_series(orders, "monthly_order_value", F.trunc(day, "MM"), exact_sum(F.col("o_totalprice")))
    return daily.unionByName(monthly)


def _flagged(df: DataFrame, method: str) -> DataFrame:
    """Common alert columns from y and ``expected``; the deviation is 0 where nothing was expected."""
    y, expected = F.col("y"), F.col("expected")
    deviation = F.when(expected == 0, 0.0).otherwise((y - expected) / expected * 100.0)
    return df.select(
        "metric",
        "ds",
        round_to(y).alias("actual_value"),
        round_to(expected).alias("expected_value"),
        round_to(F.col("lower")).alias("expected_lower"),
        round_to(F.col("upper")).alias("expected_upper"),
        round_to(deviation, 1).alias("deviation_pct"),
        round_to(F.col("z")).alias("z_score"),
        F.lit(method).alias("method"),
        F.when(y > expected, "spike").otherwise("drop").alias("direction"),
    )


def sigma(
    series: DataFrame,
    window: int = WINDOW_ROWS,
    min_points: int = MIN_POINTS,
    min_history: int = MIN_HISTORY,
    k: float = SIGMA_THRESHOLD,
) -> DataFrame:
    """Points more than ``k`` sample deviations from the mean of the trailing rows, the point itself included."""
    by_metric = W.partitionBy("metric")
    trailing = by_metric.orderBy("ds").rowsBetween(1 - window, 0)
    enough = F.count("y").over(trailing) >= min_points
    scored = (
        series.withColumn("history", F.count("*").over(by_metric))
        .where(F.col("history") >= min_history)
        .withColumns(
            {
                "expected": F.when(enough, F.avg("y").over(trailing)),
                "spread": F.when(enough, F.nullif(F.stddev_samp("y").over(trailing), F.lit(0.0))),
            }
        )
        .withColumn("z", (F.col("y") - F.col("expected")) / F.col("spread"))
    )
    none = F.lit(None).cast("double")
    return _flagged(scored.where(F.abs("z") > k).withColumns({"lower": none, "upper": none}), "3sigma")


def _hat(k: int) -> Column:
    """Weight of knot ``k`` at a point's place: 1 there, falling to 0 at the neighbouring knots."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.col("place") - k))


def _trend(series: DataFrame, bends: int) -> DataFrame:
    """``series`` with ``trend``: the least-squares line that may bend at ``bends`` - 1 equal steps of each metric's time.

    Such a line is a sum of one hat function per knot. Only neighbouring hats overlap, so the normal equations have three
    diagonals; their sums come from one grouped aggregate and are solved in one row per metric, first downwards, then up.
    """
    span = series.groupBy("metric").agg(F.min("ds").alias("first"), F.nullif(F.datediff(F.max("ds"), F.min("ds")), F.lit(0)).alias("days"), F.avg("y").alias("mean"))
    place = F.coalesce(F.datediff("ds", F.col("first")) / F.col("days") * bends, F.lit(0.0))
    placed = series.join(span, "metric").withColumn("place", place).withColumn("from_mean", F.col("y") - F.col("mean"))
    knots = range(bends + 1)
    sums = [F.sum(_hat(k) * _hat(k)).alias(f"a{k}") for k in knots]
    sums += [F.sum(_hat(k) * _hat(k + 1)).alias(f"c{k}") for k in knots[:-1]]
    sums += [F.sum(_hat(k) * F.col("from_mean")).alias(f"b{k}") for k in knots]
    solved = placed.groupBy("metric").agg(*sums, F.count("y").alias("n"))
    # A knot without points near it has no equation of its own; the ridge keeps its weight finite.
    solved = solved.withColumns({f"a{k}": F.col(f"a{k}") + RIDGE * F.col("n") for k in knots})
    for k in knots[1:]:
        share = F.col(f"c{k - 1}") / F.col(f"a{k - 1}")
        solved = solved.withColumns({f"a{k}": F.col(f"a{k}") - share * F.col(f"c{k - 1}"), f"b{k}": F.col(f"b{k}") - share * F.col(f"b{k - 1}")})
    solved = solved.withColumn(f"w{bends}", F.col(f"b{bends}") / F.col(f"a{bends}"))
    for k in reversed(knots[:-1]):
        solved = solved.withColumn(f"w{k}", (F.col(f"b{k}") - F.col(f"c{k}") * F.col(f"w{k + 1}")) / F.col(f"a{k}"))
    height = sum((_hat(k) * F.col(f"w{k}") for k in knots[1:]), _hat(0) * F.col("w0"))
    weights = solved.select("metric", *[f"w{k}" for k in knots])
    return placed.join(weights, "metric").select(*series.columns, (F.col("mean") + height).alias("trend"))


def seasonal(series: DataFrame, z: float = BAND_Z, min_history: int = MIN_HISTORY, bends: int = BENDS) -> DataFrame:
    """Points outside a band around a trend that may bend plus yearly and weekly effects.

    The yearly effect is the mean residual of a month of the year, for series of at least ``YEARLY_DAYS``; the weekly one
    is the mean of what is left by weekday, for series with points on other days than the first of a month. The band is z
    residual deviations wide on each side, and never narrower than what rounding may do.
    """
    facts = (
        series.groupBy("metric")
        .agg(
            F.count("*").alias("history"),
            (F.datediff(F.max("ds"), F.min("ds")) >= YEARLY_DAYS).alias("yearly"),
            (F.max(F.dayofmonth("ds")) > 1).alias("daily"),
        )
        .where(F.col("history") >= min_history)
    )
    detrended = (
        _trend(series, bends)
        .join(facts, "metric")
        .withColumn("weekday", F.weekday("ds"))
        .withColumn("residual", F.col("y") - F.col("trend"))
    )
    by_month = F.avg("residual").over(W.partitionBy("metric", F.month("ds")))
    left = detrended.withColumn("season", F.when(F.col("yearly"), by_month).otherwise(0.0)).withColumn(
        "rest", F.col("residual") - F.col("season")
    )
    by_weekday = F.avg("rest").over(W.partitionBy("metric", "weekday"))
    fitted = left.withColumn(
        "expected", F.col("trend") + F.col("season") + F.when(F.col("daily"), by_weekday).otherwise(0.0)
    )
    spread = F.stddev_samp(F.col("y") - F.col("expected")).over(W.partitionBy("metric"))
    rounding = ROUNDING * F.max(F.abs("y")).over(W.partitionBy("metric"))
    banded = fitted.withColumn("half", F.greatest(F.lit(z) * spread, rounding)).withColumns(
        {"lower": F.col("expected") - F.col("half"), "upper": F.col("expected") + F.col("half")}
    )
    outside = (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))
    return _flagged(banded.where(outside).withColumn("z", F.lit(None).cast("double")), "seasonal")


def combine(sigma_flags: DataFrame, seasonal_flags: DataFrame) -> DataFrame:
    """One alert per metric and date; the seasonal one wins."""
    preferred = F.when(F.col("method") == "seasonal", 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("metric", "ds").orderBy(preferred))
    return (
        sigma_flags.unionByName(seasonal_flags)
        .withColumn("rank", rank)
        .where(F.col("rank") == 1)
        .select(*FLAG_COLUMNS)
    )


def _signed_pct() -> Column:
    return F.format_string("%+.1f%%", F.col("deviation_pct"))


# The wording of the two sentences.
def with_commentary(flags: DataFrame) -> DataFrame:
    """The template sentence of an alert that nobody has commented on yet."""
    day = F.col("ds").cast("string")
    return flags.withColumns(
        {
            "commentary": F.concat(F.lit("Auto-flagged: "), _signed_pct(), F.lit(" deviation on "), day),
            "fallback": F.concat(
                F.lit("Anomaly detected: "),
                F.col("metric"),
                F.lit(" was "),
                _signed_pct(),
                F.lit(" from expected on "),
                day,
                F.lit("."),
            ),
        }
    )


def feed_records(flags: DataFrame, detected_at: Column) -> DataFrame:
    """Feed rows under review. The id is a hash of the alert, so a second scan gives the same id."""
    return with_commentary(flags).select(
        F.md5(F.concat_ws("|", "metric", F.col("ds").cast("string"), "method")).alias("id"),
        F.col("metric").alias("metric_name"),
        F.col("ds").alias("anomaly_date"),
        "actual_value",
        "expected_value",
        "deviation_pct",
        "direction",
        "method",
        "commentary",
        F.lit(True).alias("human_review_required"),
        F.lit(False).alias("commentary_approved"),
        detected_at.alias("detected_at"),
    )


def apply_approvals(feed: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals live in their own append-only table; the feed is never rewritten."""
    approved = approvals.select("id").distinct().withColumn("_approved", F.lit(True))
    return (
        feed.join(approved, "id", "left")
        .withColumn("commentary_approved", F.coalesce("_approved", "commentary_approved"))
        .drop("_approved")
    )


def latest(feed: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    return feed.orderBy(F.col("detected_at").desc(), F.col("anomaly_date").desc(), "id").limit(n)


def detect(series: DataFrame) -> DataFrame:
    return combine(sigma(series), seasonal(series))


def union(*series: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, series)
