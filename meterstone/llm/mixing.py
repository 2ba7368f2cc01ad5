"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed into cells of (source, language, topic). Raking multiplies the cells by target over current margin, one
dimension after the other, until all margins agree. A document's probability is its cell's factor (raked tokens per
token) over the largest factor, so expected margins of the sample are the targets. Only DataFrame functions are used; the
fitting runs on cells, whose number depends on the labels and not on the documents.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.tables import NOT_BLANKS, packed, text_of
from meterstone.session import through_table

# Literal marks of each topic; the topic with most marks wins, the earlier one on ties.
TOPICS = {
    "licence": ("icense", "opyright"),
    "contact": ("@", "http"),
    "tabular": (" | ",),
    "emphatic": ("!!", "***", "###", "$$$", "%%%", "&&&"),
}
NO_TOPIC = "general"

#: Targets by dimension: a power of the current token share (1 keeps it, 0 is uniform), or weights by label. Labels
#: without a weight get none.
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.7, "lang": 0.9, "topic": 0.95}
#: Raking ends when no cell's factor moves by more than this share of the largest, or after this many sweeps.
TOLERANCE, SWEEPS = 1e-10, 60
#: A share of tokens this far from its target is reported.
MARGIN_GAP = 1e-6
#: Cells that one task takes during fitting; up to as many need no shuffle.
CELLS_PER_TASK = 1 << 17
SEED = "mix-1"


def topic_of(text: str | Column) -> Column:
    whole = text_of(text)
    counts = []
    for place, (name, marks) in enumerate(TOPICS.items()):
        n = sum(((F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit(m), F.lit("")))) / len(m) for m in marks), F.lit(0.0))
        counts.append(F.struct(n.alias("n"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"]).otherwise(NO_TOPIC)


def labels(text: str = "text") -> list[Column]:
    """Cell labels and token count; a null or empty label is one label, the empty string."""
    return [
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text_of(text), F.lit(NOT_BLANKS)).cast("long").alias("n_tokens"),
    ]


def _target(margin: DataFrame, name: str, wish: float | Mapping[str, float]) -> DataFrame:
    """(label, wanted) of one dimension; a power of the tokens or the stated weight, not yet scaled."""
    if isinstance(wish, Mapping):
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in wish.items() for x in pair])[F.col(name)], F.lit(0.0))
    else:
        weight = F.pow(F.col("tokens"), F.lit(float(wish)))
    return margin.withColumn("wanted", F.when(F.col("tokens") > 0, weight.cast("double")).otherwise(0.0))


def _per_token(value: Column) -> Column:
    return value / F.when(F.col("tokens") > 0, F.col("tokens"))


def _one_step(cells: DataFrame, name: str) -> DataFrame:
    """Weights that meet the margin of one dimension."""
    joined = cells.join(cells.groupBy(name).agg(F.sum("weight").alias("_now")), name)
    met = F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_{name}") / F.col("_now")).otherwise(0.0)
    return joined.withColumn("weight", met).select(cells.columns)


def _fitted(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """``cells`` with ``weight``, the raked tokens as shares, and the wanted share of each label as _dimension."""
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name, wish in targets.items():
        margin = through_table(_target(cells.groupBy(name).agg(F.sum("tokens").alias("tokens")), name, wish), "margin")
        whole = margin.agg(F.sum("wanted")).first()[0]
        if not whole and margin.filter("tokens > 0").take(1):
            raise ValueError(f"the targets of {name} give no weight to any of its labels")
        share = margin.select(name, (F.col("wanted") / F.lit(whole or 1.0)).alias(f"_{name}"))
        fitted = fitted.join(share, name)
    fitted = through_table(fitted, "cells")
    tasks = 1 + fitted.count() // CELLS_PER_TASK
    for _ in range(SWEEPS):
        fitted = fitted.withColumn("_before", F.col("weight"))
        for name in targets:
            fitted = through_table(_one_step(fitted.coalesce(tasks), name), "cells")
        moved, largest = fitted.agg(F.max(_per_token(F.abs(F.col("weight") - F.col("_before")))), F.max(_per_token(F.col("weight")))).first()
        fitted = fitted.drop("_before")
        if moved is None or moved <= TOLERANCE * largest:
            break
    return fitted


def _margins(fitted: DataFrame, names: Iterable[str]) -> DataFrame:
    parts = [
        fitted.groupBy(F.col(name).cast("string").alias("label"))
        .agg(F.first(f"_{name}").alias("target"), F.sum("weight").alias("reached"))
        .select(F.lit(name).alias("dimension"), "label", "target", "reached")
        for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def margins(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]] | None = None) -> DataFrame:
    """(dimension, label, target, reached): the share of tokens wanted for each label and the one that raking arrives at."""
    targets = targets or TARGETS
    return _margins(_fitted(cells, targets), targets)


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]] | None = None) -> DataFrame:
    """``cells`` of (dimensions.., tokens) with ``factor``, the raked tokens per token, the largest being 1.

    A cell without tokens has factor 0. Targets that no cell can reach are left aside. Where cells that are absent make the
    targets contradict each other, the last dimension is met and the others as far as they go; a warning names the widest
    gap, and ``margins`` tells each label's.
    """
    targets = targets or TARGETS
    fitted = _fitted(cells, targets)
    gap = F.max_by(F.struct("dimension", "label", "target", "reached"), F.abs(F.col("reached") - F.col("target")))
    worst = _margins(fitted, targets).agg(gap).first()[0]
    if worst is not None and abs(worst.reached - worst.target) > MARGIN_GAP:
        warnings.warn(f"raking can't meet all targets: {worst.dimension} {worst.label!r} has {worst.reached:.4g} of the tokens, wanted {worst.target:.4g}", stacklevel=2)
    factor = _per_token(F.col("weight"))
    top = fitted.agg(F.max(factor)).first()[0] or 1.0
    return fitted.select(*targets, "tokens", F.coalesce(factor / F.lit(top), F.lit(0.0)).alias("factor"))


def _draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id alone, or on the text where the id is null."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.sha2(text_of(text), 256)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, factor) of the cells of ``docs``."""
    cells = docs.select(*labels()).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    return rake(through_table(cells, "cells"))


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, sampled), one row per row of ``docs``.

    Documents without tokens carry no weight and share their cell's probability; a cell without tokens has probability 0.
    Null text is empty, null labels are the empty label, rows that repeat a doc_id are drawn alike. An empty table gives
    no rows; further columns are ignored.
    """
    rows = docs.select("doc_id", *labels(), _draw(F.col("doc_id"), F.col("text")).alias("draw"))
    rows = through_table(rows, "labelled")
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    factors = through_table(rake(through_table(cells, "cells")).drop("tokens"), "factors")
    joined = rows.join(factors, ["source", "lang", "topic"])
    columns = ["doc_id", "source", "lang", "topic", "n_tokens"]
    return joined.select(*columns, F.round("factor", 6).alias("probability"), (F.col("draw") < F.col("factor")).alias("sampled"))


def sample(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    factors = through_table(calibrated(docs).drop("tokens"), "factors")
    full = docs.select(packed(docs).alias("doc"), *labels()[:3], _draw(F.col("doc_id"), F.col("text")).alias("draw"))
    return full.join(factors, ["source", "lang", "topic"]).filter("draw < factor").select("doc.*")
