"""Scoring of logged answers against the golden set, and references in SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.numeric import round_to, share
from meterstone.functions.sqltext import bound, references
from meterstone.functions.text import words
from meterstone.operators.guardrail import OUT_OF_SCOPE

MARKED_ACCURACY = 80.0
QUICK_QUESTIONS = 10


def table_refs(sql: Column) -> Column:
    """Tables that a statement reads or writes, each with and without its schema; names that WITH defines are left out.

    Of a text that can't be read as a statement, the words that look like a mart.
    """
    marts = F.filter(words(sql), lambda t: F.contains(t, F.lit("mart_")))
    fallback = F.array_distinct(F.transform(marts, lambda t: F.btrim(t, F.lit("(),;"))))

    def named(tables: Column) -> Column:
        return F.array_union(tables, F.transform(tables, lambda t: F.substring_index(t, ".", -1)))

    return bound(references(sql), lambda found: F.when(found["readable"], named(found["tables"])).otherwise(fallback))


def column_refs(sql: Column, known: list[str]) -> Column:
    """Which of the known columns a statement names as columns; none of a text that can't be read."""
    wanted, none = F.array(*[F.lit(c) for c in known]), F.array().cast("array<string>")
    return bound(references(sql), lambda found: F.when(found["readable"], F.array_intersect(found["columns"], wanted)).otherwise(none))


def score(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Checks per answer: refused when it should be, right table, at least half of the expected columns.

    ``answers`` carries ``position``, ``sql``, ``intent`` and ``guardrail``. The golden set is a short literal table; the
    size of either side decides the join strategy.
    """
    sql = F.coalesce("sql", F.lit(""))
    refused = ~F.coalesce("guardrail.passed", F.lit(True)) | (F.col("intent") == OUT_OF_SCOPE) | (sql == "")
    wanted = F.lower("expected_table")
    refs = table_refs(sql)
    table_ok = F.coalesce(wanted, F.lit("")).eqNullSafe("") | F.exists(
        refs, lambda t: F.contains(t, wanted) | F.contains(wanted, t)
    )
    text = F.lower(sql)
    found = F.size(F.filter("expected_columns", lambda c: F.contains(text, F.lower(c))))
    columns_ok = found * 2 >= F.size("expected_columns")
    scored = answers.join(golden, "position").withColumn("was_rejected", refused)
    reject_wanted, rejected = F.col("should_reject"), F.col("was_rejected")
    return scored.withColumns(
        {
            "rejection_correct": reject_wanted == rejected,
            "table_correct": reject_wanted | (~rejected & table_ok),
            "columns_correct": reject_wanted | (~rejected & columns_ok),
        }
    ).withColumn(
        "overall_pass",
        F.when(reject_wanted, rejected).otherwise(F.col("table_correct") & F.col("columns_correct")),
    )


def accuracy_report(
    scores: DataFrame, *, category: str | None = None, first: int | None = None, min_accuracy: float = 0.0
) -> DataFrame:
    """Accuracy per category and overall (category NULL), with the 80 % mark and the gate.

    Counts are grouped by category before the rollup, so the rollup expands a handful of rows.
    """
    if category is not None:
        scores = scores.where(F.col("category") == category)
    if first is not None:
        scores = scores.where(F.col("position") < first)
    accuracy = share(F.col("passed"), F.col("total"))
    return (
        scores.groupBy("category")
        .agg(F.count("*").alias("total"), F.count_if("overall_pass").alias("passed"))
        .rollup("category")
        .agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
        .withColumns(
            {
                "accuracy_pct": round_to(accuracy),
                "marked": accuracy >= MARKED_ACCURACY,
                "gate_passed": accuracy >= min_accuracy * 100.0,
            }
        )
    )
