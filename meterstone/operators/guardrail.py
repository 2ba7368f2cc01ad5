"""Guardrail checks as columns over a query log: protected data, injection, metric resolution, verdict, audit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.text import words
from meterstone.sources.catalog import METRICS, PII_COLUMNS, REJECTION_MESSAGE, aliases

# Patterns in the order they are tried, and the reasons they give.
PII_PATTERNS = (
    r"\bemail\b",
    r"\bphone\b",
    r"\baddress\b",
    r"\bfull.?name\b",
    r"\bssn\b",
    r"\bpassword\b",
    r"\bcredit.?card\b",
    r"\bip.?address\b",
)
INJECTION_PATTERNS = (
    r"\bDROP\b",
    r"\bDELETE\b",
    r"\bTRUNCATE\b",
    r"\bALTER\b",
    r"\bINSERT\b",
    r"\bUPDATE\b",
    r"\bEXEC\b",
    r"\bEXECUTE\b",
    r"--",
    r"/\*",
    r"\bUNION\b.*\bSELECT\b",
    r";\s*SELECT",
    r"'\s*OR\s*'",
    r"1\s*=\s*1",
)
PII_REASON = "Query references PII data: matched pattern '{}'"
INJECTION_REASON = "Potential SQL injection detected: '{}'"

# Unicode word boundaries and case, and a dot that stops at line feeds only.
_REGEX_FLAGS = "(?iUd)"
MIN_SHARED_WORDS = 3
AUDIT_TEXT_CHARS = 500
OUT_OF_SCOPE = "out_of_scope"


def _first_match(text: Column, patterns: tuple[str, ...], reason: str) -> Column:
    """Reason of the first matching pattern, or NULL. Clean texts cost one search for any of the patterns."""
    arms = [(text.rlike(_REGEX_FLAGS + p), F.lit(reason.format(p))) for p in patterns]
    first, *rest = arms
    by_order = reduce(lambda case, arm: case.when(*arm), rest, F.when(*first))
    return F.when(text.rlike(_REGEX_FLAGS + "(?:" + "|".join(patterns) + ")"), by_order)


def pii_reason(question: Column) -> Column:
    return _first_match(F.lower(question), PII_PATTERNS, PII_REASON)


def injection_reason(question: Column) -> Column:
    return _first_match(question, INJECTION_PATTERNS, INJECTION_REASON)


def resolved_metric(question: Column) -> Column:
    """The first alias contained in the question names the metric; else the first metric with an example question
    that shares at least three words; else NULL.

    Aliases are listed metric by metric, so the first metric with any alias in the text is the one of the first alias:
    one search per metric.
    """
    text = F.lower(question)
    named = [[a for a, name in aliases() if name == m.name] for m in METRICS]
    arms = [(text.rlike("|".join(map(re.escape, own))), m.name) for own, m in zip(named, METRICS)]
    by_alias = reduce(lambda case, arm: case.when(*arm), arms[1:], F.when(*arms[0]))
    examples = F.array(
        *[
            F.struct(F.lit(m.name).alias("metric"), F.lit(sorted(set(e.lower().split()))).alias("words"))
            for m in METRICS
            for e in m.examples
        ]
    )

    def close_to(asked: Column) -> Column:
        return F.filter(examples, lambda e: F.size(F.array_intersect(asked, e["words"])) >= MIN_SHARED_WORDS)

    # The outer transform binds the words of the question once for all examples.
    close = F.get(F.transform(F.array(words(question)), close_to), F.lit(0))
    return F.coalesce(by_alias, F.get(close, F.lit(0)).getField("metric"))


def with_verdict(log: DataFrame) -> DataFrame:
    """Adds ``metric`` and the ``guardrail`` struct.

    Questions that are out of scope, or that failed an earlier check, skip the metric check and count as having passed
    it; ``out_of_scope`` says which ones never had a metric to check.
    """
    scope = F.coalesce(F.col("intent"), F.lit(OUT_OF_SCOPE)) == OUT_OF_SCOPE
    question = F.col("question")
    # One generated struct per row: the text is searched once, however often later columns and filters use the result.
    found = F.struct(
        pii_reason(question).alias("_pii"),
        injection_reason(question).alias("_injection"),
        resolved_metric(question).alias("metric"),
    )
    checked = log.select("*", F.inline(F.array(found)))
    clean = F.col("_pii").isNull() & F.col("_injection").isNull()
    metric_ok = scope | ~clean | F.col("metric").isNotNull()
    reason = F.coalesce("_pii", "_injection", F.when(~metric_ok, REJECTION_MESSAGE))
    verdict = F.struct(
        (clean & metric_ok).alias("passed"),
        metric_ok.alias("metric_check"),
        F.col("_pii").isNull().alias("pii_check"),
        F.col("_injection").isNull().alias("injection_check"),
        reason.alias("rejection_reason"),
        scope.alias("out_of_scope"),
    )
    return checked.withColumn("guardrail", verdict).drop("_pii", "_injection")


def rejection_class(reason: Column, intent: Column, *, few_words: bool = False) -> Column:
    """Coarse label of a rejection by the words in its reason; ``few_words`` is the shorter keyword list."""
    text = F.lower(F.coalesce(reason, F.lit("")))

    def has(*needles: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])

    return (
        F.when(has("pii", "email") if few_words else has("pii", "email", "phone"), "pii")
        .when(has("injection") if few_words else has("injection", "drop", "delete"), "injection")
        .when(has("scope") | F.contains(F.coalesce(intent, F.lit("")), F.lit(OUT_OF_SCOPE)), OUT_OF_SCOPE)
        .otherwise("metric_allowlist")
    )


def audit_records(verdicts: DataFrame) -> DataFrame:
    """Audit rows; works on a batch and on a streaming frame."""
    return verdicts.select(
        F.md5(F.col("request_id").cast("string")).alias("id"),
        F.col("started_at").alias("checked_at"),
        F.substring("question", 1, AUDIT_TEXT_CHARS).alias("query_text"),
        "intent",
        F.col("guardrail.passed").alias("passed"),
        F.coalesce("guardrail.rejection_reason", F.lit("")).alias("failure_reason"),
    )


def audit_stats(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("total_queries"),
        F.count_if("passed").alias("passed_queries"),
        F.count_if(~F.col("passed")).alias("rejected_queries"),
        F.count_if(F.col("passed") & (F.col("intent") == OUT_OF_SCOPE)).alias("passed_out_of_scope"),
    )


def alias_usage(log: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Every catalog alias with the number of questions that contain it.

    Equal questions are counted first; each text then lists its own aliases, so nothing is paired up.
    """
    text = F.lower("question")
    known = F.array(*[F.lit(a) for a, _ in aliases()])
    used = (
        log.where(F.col("question").isNotNull())
        .groupBy("question")
        .agg(F.count("*").alias("n"))
        .select(F.explode(F.filter(known, lambda a: F.contains(text, a))).alias("alias"), "n")
        .groupBy("alias")
        .agg(F.sum("n").alias("questions"))
    )
    return alias_table.join(used, "alias", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


def protected_references(log: DataFrame) -> DataFrame:
    """Requests whose SQL names a protected column, per column."""
    tokens = sql_tokens(F.col("sql"))
    hits = F.array_intersect(tokens, F.array(*[F.lit(c) for c in PII_COLUMNS]))
    return (
        log.select(F.explode(hits).alias("column_name")).groupBy("column_name").agg(F.count("*").alias("requests"))
    )


def sql_tokens(sql: Column) -> Column:
    """Distinct lowercased identifiers of a statement."""
    return F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))
