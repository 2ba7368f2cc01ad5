"""Daily activity: the daily mart, the date spine and exact rolling active users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.text import month_start, week_start

DIMENSIONS = ("plan", "country", "acquisition_channel")
NEW_USER_DAYS = 7


def active_user_days(events: DataFrame) -> DataFrame:
    """One row per user and day of governed activity. A hot user shrinks to one row per day before any join."""
    return (
        events.where(F.col("user_id").isNotNull() & F.col("is_activity_event"))
        .groupBy("user_id", "event_date")
        .agg(F.count("*").alias("event_count"))
    )


def profiles(users: DataFrame, *columns: str) -> DataFrame:
    """Distinct user rows with the number of their copies.

    A join with the user table fans out once per copy. Copies are counted map-side first and multiply the joined values
    instead, so a user with many copies is a few rows in every join.
    """
    known = users.where(F.col("user_id").isNotNull())
    return known.groupBy("user_id", *columns).agg(F.count("*").alias("copies"))


def user_daily_activity(users: DataFrame, events: DataFrame) -> DataFrame:
    """User-days with the user's attributes; a duplicated user fans out, an unknown one keeps NULLs.

    ``copies`` says how many equal user rows a line stands for.
    """
    since = F.datediff("event_date", "signup_date")
    return (
        active_user_days(events)
        .join(profiles(users, "signup_date", *DIMENSIONS), "user_id", "left")
        .withColumns(
            {
                "copies": F.coalesce("copies", F.lit(1)),
                "event_week": week_start(F.col("event_date")),
                "event_month": month_start(F.col("event_date")),
                "days_since_signup": since,
                "is_new_user_activity": since <= NEW_USER_DAYS,
            }
        )
    )


def user_metrics(users: DataFrame, events: DataFrame) -> DataFrame:
    """Daily active users by plan, country and channel.

    Grouping by user first makes the distinct counts plain counts: no Expand, and both levels combine map-side.
    """
    per_user = (
        user_daily_activity(users, events)
        .groupBy("event_date", *DIMENSIONS, "user_id")
        .agg(F.max("is_new_user_activity").alias("is_new"), F.sum(F.col("event_count") * F.col("copies")).alias("n"))
    )
    return (
        per_user.groupBy("event_date", *DIMENSIONS)
        .agg(
            F.count("*").alias("daily_active_users"),
            F.count_if("is_new").alias("new_user_activations"),
            F.sum("n").alias("total_events"),
        )
        .select(
            F.col("event_date").alias("metric_date"),
            week_start(F.col("event_date")).alias("event_week"),
            month_start(F.col("event_date")).alias("event_month"),
            *DIMENSIONS,
            "daily_active_users",
            "new_user_activations",
            "total_events",
            F.col("daily_active_users").alias("dau"),
        )
    )


def active_users_by(
    users: DataFrame, events: DataFrame, grain: str, dims: tuple[str, ...] = (), keep: Column | None = None
) -> DataFrame:
    """Distinct active users per day, week or month: a true regroup of user-days, never a sum of daily counts.

    ``keep`` is a condition on user columns; users it is not true for are not counted.
    """
    start = {
        "day": F.col("event_date"),
        "week": week_start(F.col("event_date")),
        "month": month_start(F.col("event_date")),
    }[grain]
    if dims or keep is not None:
        base = user_daily_activity(users, events)
    else:
        base = active_user_days(events)
    if keep is not None:
        base = base.where(keep)
    return (
        base.select(start.alias("period"), *dims, "user_id")
        .distinct()
        .groupBy("period", *dims)
        .agg(F.count("*").alias("active_users"))
    )


def day_spine(events: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last event."""
    return events.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("metric_date")
    )


def daily_active_spine(events: DataFrame) -> DataFrame:
    daily = active_user_days(events).groupBy(F.col("event_date").alias("metric_date")).agg(F.count("*").alias("n"))
    return (
        day_spine(events)
        .join(daily, "metric_date", "left")
        .select("metric_date", F.coalesce("n", F.lit(0)).cast("bigint").alias("daily_active_users"))
    )


def rolling_active(events: DataFrame, days: int) -> DataFrame:
    """Exact distinct users over the trailing ``days`` days, for every calendar day.

    A user-day counts from its own date until the user's next active day or the end of its window, whichever comes
    first. These spans do not overlap, so +1 at the start and -1 after the end add up to the distinct count: no user-day
    is copied ``days`` times. The running sum goes over one row per calendar day.
    """
    by_user = W.partitionBy("user_id").orderBy("event_date")
    spans = active_user_days(events).select(
        F.col("event_date").alias("opens"),
        F.least(F.date_add("event_date", days), F.lead("event_date").over(by_user)).alias("closes"),
    )
    steps = spans.select(
        F.explode(
            F.array(
                F.struct(F.col("opens").alias("metric_date"), F.lit(1).alias("step")),
                F.struct(F.col("closes").alias("metric_date"), F.lit(-1).alias("step")),
            )
        ).alias("s")
    ).select("s.metric_date", "s.step")
    per_day = steps.groupBy("metric_date").agg(F.sum("step").alias("step"))
    running = W.orderBy("metric_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        day_spine(events)
        .join(per_day, "metric_date", "left")
        .select("metric_date", F.sum(F.coalesce("step", F.lit(0))).over(running).cast("bigint").alias("active_users"))
    )


def rolling_active_sketch(events: DataFrame, days: int, lg_k: int = 12) -> DataFrame:
    """The mergeable form: one HLL sketch per day, unioned over each trailing window. Approximate."""
    daily = active_user_days(events).groupBy("event_date").agg(F.hll_sketch_agg("user_id", lg_k).alias("sketch"))
    return (
        daily.select(F.explode(F.sequence("event_date", F.date_add("event_date", days - 1))).alias("metric_date"), "sketch")
        .groupBy("metric_date")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("active_users"))
        .join(day_spine(events), "metric_date", "left_semi")
    )
