"""Connected components by alternating large and small stars.

Each round links every node to the smallest node it knows of. Groups only ever meet as map-side minima and joins, which
Spark splits where a key is hot; rounds grow with the logarithm of the longest chain. Rounds are written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.session import through_table


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("u"), F.bit_xor(hashed), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Edges may repeat, point either way or join a node to itself; a null end is dropped.
    """
    clean = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = through_table(clean, "edges")
    before = _mark(edges)
    while before[0]:
        edges = through_table(_round(edges), "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
