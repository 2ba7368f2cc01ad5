"""Recurring revenue, churn, acquisition cost and lifetime value."""

from __future__ import annotations

import bisect
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.config import CHANNEL_COST, DEFAULTS, OTHER_CHANNEL_COST, Settings
from meterstone.functions.numeric import round_to, share
from meterstone.functions.text import month_number, month_start
from meterstone.plans.user_metrics import profiles

SLICE = ("metric_month", "plan", "country", "acquisition_channel")


def payment_months(payments: DataFrame) -> DataFrame:
    """The calendar: a month exists only if some payment fell into it."""
    return payments.select(F.col("payment_month").alias("metric_month")).distinct()


@dataclass(frozen=True)
class Calendar:
    """The sorted payment months. A month exists only if some payment fell into it."""

    months: tuple[dt.date, ...]

    @classmethod
    def read(cls, payments: DataFrame) -> Calendar:
        """One small job: a distinct over the payment dates, one row per month of history to the driver.

        Known months become literals of the plans, so no plan repeats the scan of the payments for its calendar.
        """
        return cls.of(payment_months(payments))

    @classmethod
    def of(cls, months: DataFrame) -> Calendar:
        """From a table with one row per payment month."""
        rows = months.where(F.col("metric_month").isNotNull()).select("metric_month").collect()
        return cls(tuple(sorted(r.metric_month for r in rows)))

    @property
    def size(self) -> int:
        return len(self.months)

    @property
    def numbers(self) -> list[int]:
        return [m.year * 12 + m.month for m in self.months]

    @property
    def breaks(self) -> list[int]:
        """Positions whose following month is not in the calendar; the last position is always one of them."""
        known = set(self.numbers)
        return [i for i, n in enumerate(self.numbers) if n + 1 not in known]

    def position(self, day: Column) -> Column:
        """Position of the first month that starts on or after ``day``; NULL without a day."""
        if not self.months:
            return F.when(day.isNotNull(), 0)
        numbers = self.numbers
        before = [bisect.bisect_left(numbers, n) for n in range(numbers[0], numbers[-1] + 2)]
        steps = month_number(F.date_sub(day, 1)) + 1 - numbers[0]
        last = len(before) - 1
        return F.get(F.lit(before), F.when(steps < 0, 0).when(steps > last, last).otherwise(steps))

    def month_at(self, position: Column) -> Column:
        return F.get(self._dates(), position)

    def slice(self, first: Column, stop: Column) -> Column:
        return F.when(first < stop, F.slice(self._dates(), first + 1, stop - first))

    def _dates(self) -> Column:
        return F.lit(list(self.months)) if self.months else F.array().cast("array<date>")


def _spans(subs: DataFrame, calendar: Calendar) -> DataFrame:
    """Subscriptions with the calendar positions [first, stop) of the months they are active in.

    A month counts when started_at <= month < ended_at, so a mid-month start counts from the next month on. Two lookups
    per subscription replace the range join with the calendar.
    """
    stop = F.coalesce(calendar.position(F.col("ended_at")), F.lit(calendar.size))
    # An empty span is dropped where it is exploded. A filter here would be pushed into the scan together with the
    # parsing of both dates, which would then run once more for every use of a date.
    return subs.where(F.col("mrr_usd") > 0).withColumns(
        {"first": calendar.position(F.col("started_at")), "stop": stop}
    )


def _known(column: str) -> Column:
    return F.coalesce(column, F.lit("unknown")).alias(column)


def _with_user_dims(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with their user's slice and the number of equal user rows they stand for."""
    dims = profiles(users, "country", "acquisition_channel")
    kept = [c for c in df.columns if c != "user_id"]
    return df.join(dims, "user_id", "left").select(
        "user_id", *kept, _known("country"), _known("acquisition_channel"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def active_subs_monthly(users: DataFrame, subs: DataFrame, calendar: Calendar) -> DataFrame:
    """Subscription-months with their user's attributes: the one result whose size is subscriptions times months."""
    months = calendar.slice(F.col("first"), F.col("stop"))
    spans = _spans(subs, calendar).select(
        "subscription_id", "user_id", "plan", "monthly_recurring_revenue", "first", "stop"
    )
    dims = users.where(F.col("user_id").isNotNull()).select("user_id", "country", "acquisition_channel")
    return (
        spans.join(dims, "user_id", "left")
        .withColumn("metric_month", F.explode(months))
        .select(
            "metric_month",
            "subscription_id",
            "user_id",
            "plan",
            "monthly_recurring_revenue",
            _known("country"),
            _known("acquisition_channel"),
        )
    )


def _steps(df: DataFrame) -> DataFrame:
    """Each span as +value at its first position and -value at its stop."""
    cells = F.array(
        F.struct(F.col("first").alias("at"), F.col("twelfths").alias("twelfths"), F.col("held").alias("held")),
        F.struct(F.col("stop").alias("at"), (-F.col("twelfths")).alias("twelfths"), (-F.col("held")).alias("held")),
    )
    return df.withColumn("step", F.explode(F.when(F.col("first") < F.col("stop"), cells))).select(
        *[c for c in df.columns if c not in ("first", "stop", "twelfths", "held")], "step.*"
    )


def plan_steps(users: DataFrame, subs: DataFrame, calendar: Calendar) -> DataFrame:
    """Changes of revenue and of held subscriptions per user, plan and slice: the input of MRR and churn.

    Nothing is copied once per active month: a span is two steps, and months come back from running sums.
    Subscriptions with the same user, plan and span are summed first (map-side), so a user who holds a large share of
    all subscriptions is a group bounded by the calendar in the join and in the windows after it. The one shuffle by
    (user, plan, country) serves every later window on these keys.
    """
    spans = (
        _spans(subs, calendar)
        .groupBy("user_id", "plan", "first", "stop")
        .agg(F.sum("monthly_twelfths").alias("twelfths"), F.count("*").alias("held"))
    )
    sliced = _with_user_dims(spans, users)
    weighted = {c: F.col(c) * F.col("copies") for c in ("twelfths", "held")}
    weighted["twelfths"] = weighted["twelfths"].cast("decimal(28,2)")
    return (
        _steps(sliced.withColumns(weighted).drop("copies"))
        .repartition("user_id", "plan", "country")
        .groupBy("user_id", "plan", "country", "acquisition_channel", "at")
        .agg(F.sum("twelfths").alias("twelfths"), F.sum("held").alias("held"))
    )


def _until(*keys: str) -> W:
    """Everything up to the current position, peers included."""
    return W.partitionBy(*keys).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)


def mrr_monthly(steps: DataFrame, calendar: Calendar) -> DataFrame:
    """Paying customers and revenue per month and slice, from running sums of steps.

    A user's step counts as a customer gained or lost where the number of held subscriptions leaves or reaches zero.
    """
    dims = SLICE[1:]
    held = F.sum("held").over(_until("user_id", *dims))
    gained = (held > 0).cast("int") - (held - F.col("held") > 0).cast("int")
    changes = (
        steps.withColumn("customers", F.when(F.col("user_id").isNotNull(), gained).otherwise(0))
        .groupBy(*dims, "at")
        .agg(*[F.sum(c).alias(c) for c in ("customers", "twelfths", "held")])
    )
    following = F.lead("at").over(W.partitionBy(*dims).orderBy("at"))
    levels = changes.select(
        *dims,
        "at",
        following.alias("stop"),
        *[F.sum(c).over(_until(*dims)).alias(c) for c in ("customers", "twelfths", "held")],
    ).where((F.col("held") > 0) & (F.col("at") < F.col("stop")))
    revenue = F.col("twelfths").cast("double")
    return levels.withColumn("position", F.explode(F.sequence("at", F.col("stop") - 1))).select(
        calendar.month_at(F.col("position")).alias("metric_month"),
        *dims,
        F.col("customers").alias("paying_customers"),
        (revenue / 12.0).alias("mrr"),
        revenue.alias("arr"),
        (revenue / 12.0 / F.col("held")).alias("arpu"),
    )


def churned_users(steps: DataFrame, calendar: Calendar) -> DataFrame:
    """Users of one month who hold no such plan in the next, with their lost revenue, dated to that next month.

    The anti-join of the shifted month on (month, user, plan, country), read off the levels between steps: a level is
    lost at its end if nothing is held after it, and at every position whose next month is not in the calendar. As in
    an equality join, a NULL user never matches and is lost every month.
    """
    keys = ("user_id", "plan", "country")
    by_key = W.partitionBy(*keys).orderBy("at")
    # The steps of a key's channels at one position are peers; one row of them carries the level of all.
    peer = F.row_number().over(W.partitionBy(*keys, "at").orderBy("acquisition_channel"))
    levels = (
        steps.select(
            *keys,
            "at",
            F.sum("held").over(_until(*keys)).alias("held"),
            F.sum("twelfths").over(_until(*keys)).alias("twelfths"),
            peer.alias("peer"),
        )
        .where(F.col("peer") == 1)
        .select(
            *keys,
            "at",
            "held",
            "twelfths",
            F.lead("at").over(by_key).alias("stop"),
            F.lead("held").over(by_key).alias("then_held"),
        )
        .where((F.col("held") > 0) & (F.col("at") < F.col("stop")))
    )
    span = F.sequence("at", F.col("stop") - 1)
    breaks = F.array_intersect(F.lit(calendar.breaks).cast("array<int>"), span)
    ends = F.when(F.col("then_held") == 0, F.array(F.col("stop") - 1)).otherwise(F.array().cast("array<int>"))
    lost_at = F.when(F.col("user_id").isNull(), span).otherwise(F.array_union(breaks, ends))
    return levels.withColumn("position", F.explode(lost_at)).select(
        F.add_months(calendar.month_at(F.col("position")), 1).alias("metric_month"),
        *keys,
        (F.col("twelfths").cast("double") / 12.0).alias("churned_mrr"),
        "twelfths",
    )


def churned_monthly(steps: DataFrame, calendar: Calendar) -> DataFrame:
    return (
        churned_users(steps, calendar)
        .groupBy("metric_month", "plan", "country")
        .agg(F.count("user_id").alias("churned_customers"), F.sum("twelfths").alias("twelfths"))
        .select(
            "metric_month",
            "plan",
            "country",
            "churned_customers",
            (F.col("twelfths").cast("double") / 12.0).alias("churned_mrr"),
        )
    )


def payments_by_month(payments: DataFrame) -> DataFrame:
    """One row per payment month, whatever the currency, from one pass: the calendar and the revenue both come from it."""
    usd, dirty = F.col("is_usd"), F.col("is_suspected_dirty")
    return payments.groupBy(F.col("payment_month").alias("metric_month")).agg(
        F.count_if(usd).alias("usd_rows"),
        F.sum(F.when(usd & ~dirty, F.col("net_amount_usd"))).cast("double").alias("net_revenue"),
        F.count_if(usd & dirty).alias("dirty_payment_rows"),
    )


def payments_monthly(payments: DataFrame) -> DataFrame:
    return _with_usd(payments_by_month(payments))


def _with_usd(months: DataFrame) -> DataFrame:
    return months.where("usd_rows > 0").drop("usd_rows")


def channel_cost(channel: Column) -> Column:
    cost = F.lit(OTHER_CHANNEL_COST)
    for name, usd in CHANNEL_COST.items():
        cost = F.when(channel == name, usd).otherwise(cost)
    return cost


def cac_by_channel(users: DataFrame) -> DataFrame:
    """Acquisition cost per distinct new customer; a duplicated user costs twice."""
    keys = ("cohort_month", "acquisition_channel")
    per_user = (
        users.where(F.col("user_id").isNotNull())
        .groupBy(month_start(F.col("signup_date")).alias(keys[0]), keys[1], "user_id")
        .agg(F.count("*").alias("rows"))
    )
    return (
        per_user.groupBy(*keys)
        .agg(F.count("*").alias("new_customers"), F.sum("rows").alias("rows"))
        .select(
            *keys,
            "new_customers",
            ((channel_cost(F.col(keys[1])) * F.col("rows")).cast("double") / F.col("new_customers")).alias(
                "estimated_cac"
            ),
        )
    )


def revenue_metrics(
    users: DataFrame,
    subs: DataFrame,
    payments: DataFrame,
    calendar: Calendar | None = None,
    settings: Settings = DEFAULTS,
    months: DataFrame | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """The revenue mart. Churn repeats over channels and net revenue over all slices of a month, by definition.

    ``months`` of ``payments_by_month`` and ``steps`` of ``plan_steps`` save their passes where they are written already.
    """
    calendar = calendar or (Calendar.read(payments) if months is None else Calendar.of(months))
    steps = plan_steps(users, subs, calendar) if steps is None else steps
    monthly = payments_monthly(payments) if months is None else _with_usd(months)
    churn = churned_monthly(steps, calendar)
    cac = cac_by_channel(users).select(
        F.col("cohort_month").alias("metric_month"), "acquisition_channel", "estimated_cac"
    )
    joined = (
        mrr_monthly(steps, calendar)
        .join(churn, ["metric_month", "plan", "country"], "left")
        .join(cac, ["metric_month", "acquisition_channel"], "left")
        .join(monthly, "metric_month", "left")
    )
    lost = F.coalesce("churned_customers", F.lit(0))
    paying = F.nullif(F.col("paying_customers"), F.lit(0)).cast("double")
    cac_usd = F.coalesce("estimated_cac", F.lit(0.0))
    lifetime = F.col("arpu") / F.nullif(lost.cast("double") / paying, F.lit(0.0)) * F.lit(settings.ltv_margin)
    return joined.select(
        *SLICE,
        "paying_customers",
        round_to(F.col("mrr")).alias("mrr"),
        round_to(F.col("arr")).alias("arr"),
        round_to(F.col("arpu")).alias("arpu"),
        lost.alias("churned_customers"),
        round_to(F.coalesce("churned_mrr", F.lit(0.0))).alias("churned_mrr"),
        round_to(share(lost, F.col("paying_customers"))).alias("churn_rate_pct"),
        round_to(cac_usd).alias("estimated_cac"),
        round_to(lifetime).alias("estimated_ltv"),
        round_to(lifetime / F.nullif(cac_usd, F.lit(0.0))).alias("ltv_to_cac_ratio"),
        round_to(F.coalesce("net_revenue", F.lit(0.0))).alias("net_revenue"),
        F.coalesce("dirty_payment_rows", F.lit(0)).alias("dirty_payment_rows"),
    )


def churn_start_of_month(subs: DataFrame, calendar: Calendar) -> DataFrame:
    """The documented churn rate: a plan change is not churn, the base is the customers of the month before.

    Customers gained and lost are counted per position; the running sum goes over one row per calendar month.
    """
    steps = (
        _steps(
            _spans(subs, calendar)
            .where(F.col("user_id").isNotNull())
            .groupBy("user_id", "first", "stop")
            .agg(F.count("*").alias("held"), F.lit(0).alias("twelfths"))
        )
        .groupBy("user_id", "at")
        .agg(F.sum("held").alias("held"))
    )
    held = F.sum("held").over(_until("user_id"))
    before = held - F.col("held")
    changes = (
        steps.select(
            "at",
            ((held > 0) & (before == 0)).cast("int").alias("gained"),
            ((held == 0) & (before > 0)).cast("int").alias("lost"),
        )
        .groupBy("at")
        .agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"))
    )
    follows = [(i, m, i > 0 and i - 1 not in calendar.breaks) for i, m in enumerate(calendar.months)]
    positions = steps.sparkSession.createDataFrame(follows, "at int, metric_month date, follows boolean")
    earlier = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    net = F.coalesce("gained", F.lit(0)) - F.coalesce("lost", F.lit(0))
    return (
        positions.join(changes, "at", "left")
        .withColumn("customers_at_start", F.sum(net).over(earlier))
        .where(F.col("follows") & (F.col("customers_at_start") > 0))
        .select(
            "metric_month",
            "customers_at_start",
            F.coalesce("lost", F.lit(0)).alias("churned_customers"),
            round_to(share(F.coalesce("lost", F.lit(0)), F.col("customers_at_start"))).alias("churn_rate_pct"),
        )
    )


def mrr_by_billing_interval(subs: DataFrame, calendar: Calendar) -> DataFrame:
    """Active subscriptions and revenue per month and billing interval, which the mart does not carry."""
    changes = (
        _steps(
            _spans(subs, calendar)
            .groupBy("billing_interval", "first", "stop")
            .agg(F.sum("monthly_twelfths").alias("twelfths"), F.count("*").alias("held"))
        )
        .groupBy("billing_interval", "at")
        .agg(F.sum("twelfths").alias("twelfths"), F.sum("held").alias("held"))
    )
    following = F.lead("at").over(W.partitionBy("billing_interval").orderBy("at"))
    return (
        changes.select(
            "billing_interval",
            "at",
            following.alias("stop"),
            F.sum("twelfths").over(_until("billing_interval")).alias("twelfths"),
            F.sum("held").over(_until("billing_interval")).alias("held"),
        )
        .where((F.col("held") > 0) & (F.col("at") < F.col("stop")))
        .withColumn("position", F.explode(F.sequence("at", F.col("stop") - 1)))
        .select(
            calendar.month_at(F.col("position")).alias("metric_month"),
            "billing_interval",
            F.col("held").alias("subscriptions"),
            round_to(F.col("twelfths").cast("double") / 12.0).alias("mrr"),
        )
    )
