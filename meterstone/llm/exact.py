"""Exact duplicates with a split for heavy hitters.

A frequent-items summary of the Misra-Gries family (``approx_top_k``: counters that are decremented together, merged
across tasks) names the digests that may hold ``HEAVY_SHARE`` of all rows. Their exact counts are verified; at most
``1 / HEAVY_SHARE`` winners are broadcast and decide their copies map-side. All other digests, none of them heavy, go
through an ordinary shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterstone.llm.tables import BLANKS, packed, text_of
from meterstone.session import through_table

#: A digest with this share of the rows is decided by broadcast; so there are at most 1 / HEAVY_SHARE winners.
HEAVY_SHARE = 1 / 1024
#: Counters of the summary; its error is below 3.5 / TRACKED of the rows, well under HEAVY_SHARE.
TRACKED = 16384


def digest(text: str | Column) -> Column:
    """SHA-256 (hex) of the text with every run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_of(text), BLANKS, " "), 256)


def heavy_digests(rows: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that hold at least ``share`` of ``rows(digest, doc_id)``.

    The smallest doc_id stays; null ids count only where a group has no other. At most 1 / share rows.
    """
    most = int(1 / share) + 1
    found = rows.agg(F.expr(f"approx_top_k(digest, {most}, {max(TRACKED, 16 * most)})").alias("top"), F.count(F.lit(1)).alias("n_rows"))
    found = found.select(F.explode("top.item").alias("digest"), "n_rows")
    counted = rows.join(F.broadcast(found), "digest").groupBy("digest", "n_rows")
    counted = counted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.filter(F.col("group_size") >= F.col("n_rows") * F.lit(share)).drop("n_rows")


def _one_of_each(winners: DataFrame) -> DataFrame:
    """Of heavy rows that carry the id that stays, one per digest gets ``first``; split by task before it is chosen."""
    winners = winners.withColumn("task", F.spark_partition_id())
    by_task = Window.partitionBy("digest", "task").orderBy(F.lit(1))
    return winners.withColumn("again", F.row_number().over(by_task) > 1).drop("task")


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs(doc_id, text)``.

    Null and empty texts are equal to each other. Of rows that repeat the doc_id that stays, exactly one is kept. A null
    doc_id stays only in a group without any other id. An empty table gives no rows; further columns are ignored.
    """
    rows = through_table(docs.select("doc_id", digest("text").alias("digest")), "digests")
    heavy = through_table(heavy_digests(rows), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    copies = marked.filter(F.col("group_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    copies = copies.withColumn("kept", F.lit(False))

    winners = _one_of_each(marked.filter(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    again = winners.filter("again").drop("again").withColumn("kept", F.lit(False))
    once = winners.filter("not again").drop("again")
    rest = marked.filter(F.col("group_size").isNull())
    ordered = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = once.unionByName(rest).select(
        "digest",
        "doc_id",
        F.first("doc_id").over(whole).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(whole)).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"),
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    return copies.select(columns).unionByName(again.select(columns)).unionByName(ranked.select(columns))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest doc_id.

    Heavy copies are removed before the shuffle, so no group of copies reaches one task whole. Rows alike in doc_id and
    text leave one, the one with the smallest hash over all columns.
    """
    rows = through_table(docs.select("doc_id", digest("text").alias("digest")), "digests")
    heavy = through_table(heavy_digests(rows), "heavy").select("digest", "keep_id", F.lit(True).alias("heavy"))
    full = docs.select(packed(docs).alias("doc"), F.col("doc_id").alias("id"), digest("text").alias("digest"))
    marked = full.join(F.broadcast(heavy), "digest", "left")
    stays = marked.filter(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    once = _one_of_each(stays.filter("heavy")).filter("not again").drop("again")
    maps = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]
    tie = F.xxhash64(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in maps])
    ordered = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last(), tie)
    ranked = once.unionByName(stays.filter(F.col("heavy").isNull())).withColumn("place", F.row_number().over(ordered))
    return ranked.filter("place = 1").select("doc.*")
