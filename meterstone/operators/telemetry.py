"""Service telemetry over a graded query log.

Counters, histograms and rates are additive, so every job first sums into small cells (labels, bounds or seconds) and
works on the cells after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.clock import SECOND, from_micros, micros
from meterstone.functions.numeric import round_to
from meterstone.operators import guardrail, querylog

# Histogram bounds (seconds, dollars) and reported quantiles.
LATENCY_BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0)
COST_BOUNDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
QUANTILES = (0.5, 0.95, 0.99)
RATE_SECONDS = 300
STEP_SECONDS = 15
# Steps of one day; running sums start anew in each block with the balance that earlier blocks leave.
BLOCK_STEPS = 5760
UNKNOWN = "unknown"


def graded(log: DataFrame) -> DataFrame:
    """Log rows with verdict, confidence, rejection class and cost."""
    rejected = ~F.col("guardrail.passed")
    return (
        querylog.with_confidence(guardrail.with_verdict(log))
        .withColumn("rejected", rejected)
        .withColumn(
            "reason",
            F.when(
                F.col("rejected"),
                guardrail.rejection_class(F.col("guardrail.rejection_reason"), F.col("intent")),
            ),
        )
        .withColumns({"cost_micro_usd": querylog.cost_micro_usd(), "cost_usd": querylog.rounded_cost_usd()})
    )


COUNTER_LABELS = ("rejected", "intent", "confidence", "reason", "cache_hit")


def counter_cells(log: DataFrame) -> DataFrame:
    """Requests and retries per combination of labels: additive, so a stream can keep them."""
    return log.groupBy(*COUNTER_LABELS).agg(F.count("*").alias("n"), F.sum("retries").alias("retries"))


def counters(log: DataFrame) -> DataFrame:
    """The four labelled counters from one grouped scan."""
    return counters_of(counter_cells(log))


def counters_of(cells: DataFrame) -> DataFrame:

    def counter(name: str, label1: Column, label2: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("counter"),
            label1.cast("string").alias("label1"),
            label2.cast("string").alias("label2"),
            value.cast("bigint").alias("value"),
        )

    none = F.lit(None)
    answered = F.when(~F.col("rejected"), F.col("n"))
    entries = F.array(
        counter("queries", intent_label(), F.col("confidence"), answered),
        counter("rejections", F.col("reason"), none, F.when(F.col("rejected"), F.col("n"))),
        counter("cache", F.when(F.col("cache_hit"), "hit").otherwise("miss"), none, F.col("n")),
        counter("sql_retries", none, none, F.col("retries")),
    )
    return (
        cells.select(F.inline(entries))
        .where(F.col("value").isNotNull())
        .groupBy("counter", "label1", "label2")
        .agg(F.sum("value").alias("value"))
    )


def hit_ratio(log: DataFrame) -> DataFrame:
    hits = F.count_if("cache_hit")
    return log.agg(
        hits.alias("hits"),
        F.count("*").alias("requests"),
        (hits.cast("double") / F.nullif(F.count("*"), F.lit(0)).cast("double")).alias("hit_ratio"),
    )


def _label(bound: float | None) -> str:
    return "+Inf" if bound is None else repr(bound)


def histogram(
    log: DataFrame, value: Column, bounds: tuple[float, ...], by: list[str | Column], total: Column
) -> DataFrame:
    """Cumulative bucket counts with the sum and count of a histogram, one pass over the log."""
    return _buckets(log.groupBy(*by).agg(*_bucket_sums(value, bounds), total.alias("total")), bounds)


def _bucket_sums(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    return [*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("observations")]


def latency_cells(log: DataFrame) -> DataFrame:
    """Latency counts below each bound and their sum by intent, one row an intent."""
    answered = log.where(~F.col("rejected"))
    return answered.groupBy(intent_label()).agg(*_bucket_sums(latency_seconds(), LATENCY_BOUNDS), F.sum("latency_us").alias("latency_us"))


def latency_buckets(cells: DataFrame) -> DataFrame:
    total = (F.col("latency_us").cast("double") / float(SECOND)).alias("total")
    return _buckets(cells.withColumn("total", total).drop("latency_us"), LATENCY_BOUNDS)


def _buckets(wide: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """One row per bucket instead of one column."""
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("bucket"),
            F.lit(_label(b)).alias("le"),
            F.lit(b).cast("double").alias("bound"),
            F.col(f"b{i}" if b is not None else "observations").alias("cumulative"),
        )
        for i, b in enumerate([*bounds, None])
    ]
    keys = [c for c in wide.columns if not (c[0] == "b" and c[1:].isdigit())]
    return wide.select(*keys, F.inline(F.array(*cells)))


def intent_label() -> Column:
    """The intent, or a label of its own where it is missing or empty."""
    return F.coalesce(F.nullif("intent", F.lit("")), F.lit(UNKNOWN)).alias("intent")


def latency_seconds() -> Column:
    return F.col("latency_us").cast("double") / float(SECOND)


def latency_histogram(log: DataFrame, by: list[str | Column]) -> DataFrame:
    return histogram(
        log.where(~F.col("rejected")),
        latency_seconds(),
        LATENCY_BOUNDS,
        by,
        F.sum("latency_us").cast("double") / float(SECOND),
    )


def cost_histogram(log: DataFrame, by: list[str | Column]) -> DataFrame:
    return histogram(
        log.where(~F.col("rejected")),
        F.col("cost_usd"),
        COST_BOUNDS,
        by,
        F.sum("cost_micro_usd").cast("double") / 1e6,
    )


def quantiles(buckets: DataFrame, by: list[str], wanted: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket that holds the rank.

    A rank in the last, open bucket gives the highest bound. Works on bucket rows only.
    """
    order = W.partitionBy(*by).orderBy("bucket")
    steps = buckets.withColumns(
        {
            "below": F.coalesce(F.lag("cumulative").over(order), F.lit(0)),
            "lower": F.coalesce(F.lag("bound").over(order), F.lit(0.0)),
        }
    ).where(F.col("observations") > 0)
    probes = steps.withColumn("q", F.explode(F.array(*[F.lit(q) for q in wanted])))
    rank = F.col("q") * F.col("observations")
    holds = (F.col("cumulative") >= rank) & ((F.col("below") < rank) | (F.col("bucket") == 0))
    inside = F.col("lower") + (F.col("bound") - F.col("lower")) * (rank - F.col("below")) / (
        F.col("cumulative") - F.col("below")
    )
    return probes.where(holds).select(
        *by, F.col("q").alias("quantile"), round_to(F.coalesce(inside, F.col("lower")), 6).alias("value")
    )


def sliding(
    log: DataFrame, by: list[Column], measures: list[Column], seconds: int, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """(window_start, labels, measures) of every sliding window, one per step, that holds any request.

    ``measures`` are additive and the first one counts requests. Requests are summed into steps; a step's sums enter at
    the first window that covers it and leave after the last, so each cell makes two rows and not one per window. Running
    sums go over the changes of one label and block of time, with the block's opening balance as its first row; windows
    between two changes are alike and are listed at the end.
    """
    width = seconds // STEP_SECONDS
    block_steps = max(block_steps, width)  # what enters in one block leaves in the next one at the latest
    labels, names = log.select(*by).columns, log.groupBy().agg(*measures).columns
    step = F.floor(micros(F.col("started_at")) / F.lit(STEP_SECONDS * SECOND)).cast("bigint")
    cells = log.groupBy(step.alias("step"), *by).agg(*measures)
    change = F.explode(F.array(*[
        F.struct((F.col("step") + at).alias("at"), F.lit(sign).alias("sign")) for at, sign in ((1 - width, 1), (1, -1))
    ])).alias("change")
    changes = cells.select(*labels, *names, change).groupBy(*labels, F.col("change.at").alias("at"))
    changes = changes.agg(*[F.sum(F.col(n) * F.col("change.sign")).alias(n) for n in names])
    changes = changes.withColumn("block", F.floor(F.col("at") / block_steps).cast("bigint"))
    earlier = W.partitionBy(*labels).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opening = changes.groupBy(*labels, "block").agg(*[F.sum(n).alias(n) for n in names])
    opening = opening.select(
        *labels,
        "block",
        (F.col("block") * block_steps).alias("at"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names],
    )
    inside = W.partitionBy(*labels, "block").orderBy("at")
    rows = changes.unionByName(opening).select(
        *labels,
        "at",
        *[F.sum(n).over(inside.rangeBetween(W.unboundedPreceding, W.currentRow)).alias(n) for n in names],
        F.coalesce(F.lead("at").over(inside), (F.col("block") + 1) * block_steps).alias("next"),
    )
    alike = F.explode(F.sequence("at", F.col("next") - 1))
    held = rows.where((F.col(names[0]) > 0) & (F.col("next") > F.col("at")))
    return held.select(alike.alias("at"), *labels, *names).select(
        from_micros(F.col("at") * (STEP_SECONDS * SECOND)).alias("window_start"), *labels, *names
    )


def _requests() -> Column:
    return F.count("*").alias("requests")


def sliding_rate(log: DataFrame, by: list[str], seconds: int = RATE_SECONDS, per: int = 1) -> DataFrame:
    """Requests per second (times ``per``) in every sliding window that holds any."""
    rate = round_to(F.col("requests").cast("double") * per / float(seconds), 6).alias("rate")
    return sliding(log, [F.col(c) for c in by], [_requests()], seconds).select("*", rate)


def sliding_latency_quantiles(log: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """Latency quantiles by intent over sliding windows."""
    answered = log.where(~F.col("rejected"))
    measures = [_requests(), *_bucket_sums(latency_seconds(), LATENCY_BOUNDS)]
    wide = sliding(answered, [intent_label()], measures, seconds).drop("requests")
    return quantiles(_buckets(wide, LATENCY_BOUNDS), ["window_start", "intent"])


def sliding_cost_quantiles(log: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """Quantiles of the cost of a request over sliding windows."""
    measures = [_requests(), *_bucket_sums(F.col("cost_usd"), COST_BOUNDS)]
    wide = sliding(log.where(~F.col("rejected")), [], measures, seconds).drop("requests")
    return quantiles(_buckets(wide, COST_BOUNDS), ["window_start"])


#: Size of a quantile sketch, and how far the rank of its answers may be off: three times what is typical of the size.
SKETCH_K, SKETCH_RANK_ERROR = 200, 0.04


def sketch_steps(log: DataFrame, value: Column, by: list[Column], step_seconds: int) -> DataFrame:
    """(step, labels, sketch): one mergeable sketch per step of time and labels, of bounded size whatever it has seen."""
    step = F.floor(micros(F.col("started_at")) / F.lit(step_seconds * SECOND)).cast("bigint").alias("step")
    return log.groupBy(step, *by).agg(F.kll_sketch_agg_double(value.cast("double"), SKETCH_K).alias("sketch"))


def sketched_quantiles(steps: DataFrame, by: list[str], step_seconds: int, width: int, wanted: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(window_start, labels, quantile, value) over windows of ``width`` steps, one window per step, from merged sketches.

    Values need no bounds fixed beforehand. Sketches travel into the windows that cover them, requests never do.
    """
    covered = F.explode(F.sequence(F.col("step") - (width - 1), F.col("step"))).alias("at")
    merged = steps.select(covered, *by, "sketch").groupBy("at", *by).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    start = from_micros(F.col("at") * (step_seconds * SECOND)).alias("window_start")
    answers = [F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in wanted]
    return merged.select(start, *by, F.inline(F.array(*answers)))


def sketch_ranks(found: DataFrame, log: DataFrame, step_seconds: int, width: int) -> DataFrame:
    """(window_start, intent, quantile, observations, within): whether each latency quantile's exact rank is near enough."""
    at = F.floor(micros(F.col("started_at")) / F.lit(step_seconds * SECOND)).cast("bigint")
    windows = F.explode(F.sequence(F.col("step") - (width - 1), F.col("step"))).alias("at")
    # Requests are summed per step and value before they enter windows.
    values = log.groupBy(at.alias("step"), "latency_us", intent_label()).agg(F.count("*").alias("n"))
    seen = values.select(windows, "intent", latency_seconds().alias("v"), "n")
    seen = seen.select(from_micros(F.col("at") * (step_seconds * SECOND)).alias("window_start"), "intent", "v", "n")
    below, upto = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("v") < F.col("value"), F.col("v") <= F.col("value")))
    ranked = found.join(seen, ["window_start", "intent"]).groupBy("window_start", "intent", "quantile")
    ranked = ranked.agg(F.sum("n").alias("observations"), below.alias("below"), upto.alias("upto"))
    lowest, highest = F.col("below") / F.col("observations"), F.col("upto") / F.col("observations")
    within = (lowest <= F.col("quantile") + SKETCH_RANK_ERROR) & (highest >= F.col("quantile") - SKETCH_RANK_ERROR)
    return ranked.select("window_start", "intent", "quantile", "observations", within.alias("within"))


def _cost_columns() -> list[Column]:
    micro, requests = F.col("micro").cast("double"), F.col("requests").cast("double")
    return [(micro / 1e6).alias("cost_usd"), round_to(micro / requests / 1e6, 8).alias("mean_cost_usd")]


def mean_cost(log: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Mean cost per answered request in tumbling windows."""
    return (
        log.where(~F.col("rejected"))
        .groupBy(F.window("started_at", window).alias("w"))
        .agg(F.sum("cost_micro_usd").alias("micro"), _requests())
        .select(F.col("w.start").alias("window_start"), "requests", *_cost_columns())
    )


def sliding_mean_cost(log: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """Mean cost per answered request in sliding windows."""
    measures = [_requests(), F.sum("cost_micro_usd").alias("micro")]
    rows = sliding(log.where(~F.col("rejected")), [], measures, seconds)
    return rows.select("window_start", "requests", *_cost_columns())


def flight_steps(log: DataFrame) -> DataFrame:
    """(us, step): requests that start less those that end, per instant."""
    ends = F.array(
        F.struct(micros(F.col("started_at")).alias("us"), F.lit(1).alias("step")),
        F.struct((micros(F.col("started_at")) + F.col("latency_us")).alias("us"), F.lit(-1).alias("step")),
    )
    return log.select(F.explode(ends).alias("s")).select("s.us", "s.step").groupBy("us").agg(F.sum("step").alias("step"))


def in_flight(log: DataFrame, cell_seconds: int = 60) -> DataFrame:
    """Open requests after every instant at which a request starts or ends."""
    return in_flight_of(flight_steps(log), cell_seconds)


def in_flight_of(steps: DataFrame, cell_seconds: int = 60) -> DataFrame:
    """The gauge from the steps of instants.

    A running sum over all time would be one task. Minutes get their opening balance from a running sum over one row per
    minute, and instants are summed inside their minute only.
    """
    us = F.col("us")
    steps = steps.withColumn("minute", F.floor(us / F.lit(cell_seconds * SECOND)).cast("bigint"))
    earlier = W.orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    opening = (
        steps.groupBy("minute")
        .agg(F.sum("step").alias("net"))
        .select("minute", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("open"))
    )
    inside = W.partitionBy("minute").orderBy("us").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        steps.withColumn("inside", F.sum("step").over(inside))
        .join(opening, "minute")
        .select(from_micros(us).alias("ts"), (F.col("open") + F.col("inside")).cast("bigint").alias("in_flight"))
    )
