"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, so copies can't cut the graph into pieces. A first graph comes from several orders of the nodes by
signs of random projections, each cut into blocks that are compared inside. NN-descent then improves it: every node is a
pivot that introduces its neighbours and those that name it to each other; whoever is nearer than the kth neighbour so far
replaces it, and pairs that met before are not compared again. A pivot that very many nodes name is split into parts, each with
the pivot's own neighbours, so no list is cut short and no group grows. Pivots meet in groups of bounded size that receive
each vector once.

A query walks the graph: it keeps the POOL best nodes seen and expands the nearest unexpanded ones, a join with the graph a
round, until none is left. Vectors travel as 16-bit numbers scaled per vector; the pool is ranked again by the original
vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.tables import bucketed
from meterstone.session import through_table

NEAREST, EVERY = 10, 100
#: Neighbours of a node, orders of the first graph and nodes of their blocks, rounds of descent.
NEIGHBOURS, ORDERS, BLOCK, ROUNDS = 24, 8, 1024, 2
#: Best introductions that a pivot passes on to each of its members in a round.
PASSED = 4
#: Nodes a query keeps, expands at once, and starts from: the nearest of a bounded sample of the index.
POOL, EXPANDED, STARTS, SAMPLE = 384, 48, 4, 1024
#: Signs of projections in a node's place in an order.
SIGNS = 24
#: Numbers that a group of pivots holds. Groups are small, so that the vectors sent to them grow with the edges at any size.
GROUP = 1 << 19
SEED = 11

_EDGE = "array<struct<dist:float,near:bigint,fresh:boolean>>"


def _decoded(codes: list[bytes], units: np.ndarray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    return np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1) * np.asarray(units, np.float32)[:, None]


def _matrix(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    return _decoded(table.column("code").to_pylist(), table.column("unit").to_numpy())


def _by_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield batch.filter(pa.array(dims == dim))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of y."""
    out = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.maximum(out, 0, out=out)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) in double precision of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(node, dim, vec, code, unit, members) per different vector.

    ``members`` are its k + 1 smallest ids: of equal vectors no others can be among the k nearest of anything. ``code`` holds
    the vector in 16-bit numbers that are worth ``unit`` each, after division by the largest number of the table.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, units = [], []
            for vec in batch.column("small"):
                x = vec.values.to_numpy()
                unit = np.abs(x).max() / np.float32(32767)
                codes.append(np.rint(x / (unit or 1)).astype(np.int16).tobytes())
                units.append(unit)
            columns = [batch.column("node"), batch.column("vec"), batch.column("members"), pa.array(codes, pa.binary()), pa.array(units, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "vec", "members", "code", "unit"])

    order = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    grouped = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    grouped = through_table(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    largest = grouped.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    small = F.transform("vec", lambda x: (x / F.lit(largest)).cast("float"))
    kinds = "node long, vec array<double>, members array<bigint>, code binary, unit float"
    coded_rows = grouped.select("node", "vec", "members", small.alias("small")).mapInArrow(coded, kinds)
    return coded_rows.select("node", F.size("vec").alias("dim"), "vec", "code", "unit", "members")


def _first_pairs(nodes: DataFrame, count: int) -> DataFrame:
    """(node, near, dist) within blocks of nodes that lie together in one of the orders."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch):
                x = _matrix(part)
                for order in range(ORDERS):
                    planes = np.random.default_rng((SEED, order, x.shape[1])).standard_normal((x.shape[1], SIGNS), dtype=np.float32)
                    sides = ((x @ planes > 0) @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])).astype(np.int64)
                    columns = [pa.array(np.full(len(x), order, np.int32)), part.column("dim"), pa.array(sides), *(part.column(c) for c in ("node", "code", "unit"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["order", "dim", "sides", "node", "code", "unit"])

    def compared(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        d = _squares(x, x)
        np.fill_diagonal(d, np.inf)
        k = min(NEIGHBOURS, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
        columns = [np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel().astype(np.float32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "near", "dist"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ids, x = None, np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        for batch in batches:
            which = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(which)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(which)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if which[a] != run:
                    for half in np.array_split(np.arange(len(ids)), -(-len(ids) // BLOCK) or 1):
                        yield compared(ids[half], x[half])
                    run, ids, x = which[a], np.zeros(0, np.int64), np.zeros((0, int(which[a] & 0xFFFFFFFF)), np.float32)
                ids, x = np.concatenate([ids, part.column(3).to_numpy()]), np.concatenate([x, _matrix(part)])
                while len(ids) >= 2 * BLOCK:
                    yield compared(ids[:BLOCK], x[:BLOCK])
                    ids, x = ids[BLOCK:], x[BLOCK:]
        for half in np.array_split(np.arange(len(ids)), -(-len(ids) // BLOCK) or 1):
            yield compared(ids[half], x[half])

    placed = nodes.select("node", "dim", "code", "unit").mapInArrow(places, "order int, dim int, sides long, node long, code binary, unit float")
    keys = ["order", "dim", "sides", "node"]
    placed = placed.repartitionByRange(max(1, count * ORDERS // (8 * BLOCK)), *keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(blocks, "node long, near long, dist float")


def _merged(pairs: DataFrame) -> DataFrame:
    """(node, edges): the nearest NEIGHBOURS of each node among ``pairs(node, near, dist, fresh)``; a known edge is not fresh."""
    pairs = pairs.repartition("node")  # serves all three steps
    once = pairs.groupBy("node", "near").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    best = once.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("dist", "near"))).filter(F.col("place") <= NEIGHBOURS)
    return best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dist", "near", "fresh"))).cast(_EDGE).alias("edges"))


_PAIR = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("dist", pa.float32())])


def introduced(members: pa.Table, vectors: pa.Table) -> pa.Table:
    """What the pivots of one group pass on: members(pivot, part, member, fresh), vectors(member, code, unit, kth)."""
    ids = vectors.column("member").to_numpy()
    order = np.argsort(ids)
    ids, x, kth = ids[order], _matrix(vectors)[order], vectors.column("kth").to_numpy()[order]
    pivot, part, member = (members.column(c).to_numpy() for c in ("pivot", "part", "member"))
    fresh = members.column("fresh").to_numpy()
    at = np.searchsorted(ids, member)
    order = np.lexsort((at, part, pivot))
    pivot, part, at, fresh = pivot[order], part[order], at[order], fresh[order]
    ends = np.append(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(part) != 0)) + 1, len(pivot))
    found = []
    start = 0
    for end in ends:
        near, first = np.unique(at[start:end], return_index=True)
        new = np.logical_or.reduceat(fresh[start:end], first)
        start = end
        if not new.any() or len(near) < 2:
            continue
        y = x[near]
        d = np.full((len(near), len(near)), np.inf, np.float32)
        d[new] = _squares(y[new], y)
        d[:, new] = d[new].T
        np.fill_diagonal(d, np.inf)
        k = min(PASSED, len(near) - 1)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, best, 1)
        row, column = np.nonzero(dist < kth[near][:, None])
        found.append((ids[near[row]], ids[near[best[row, column]]], dist[row, column]))
    if not found:
        return _PAIR.empty_table()
    return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=_PAIR)


def _round(nodes: DataFrame, graph: DataFrame, groups: int) -> DataFrame:
    """One round of NN-descent over ``graph(node, dim, edges)``."""
    edges = graph.select("node", "dim", F.explode("edges").alias("e")).select("node", "dim", F.col("e.near").alias("near"), F.col("e.fresh").alias("fresh"))
    named = edges.groupBy(F.col("near").alias("pivot")).agg(F.ceil(F.count("node") / NEIGHBOURS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    naming = edges.withColumnRenamed("near", "pivot").join(named, "pivot").select("pivot", part.alias("part"), "dim", F.col("node").alias("member"), "fresh")
    own = graph.withColumnRenamed("node", "pivot").join(named, "pivot", "left")
    own = own.select("pivot", "dim", "edges", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    own = own.select("pivot", "part", "dim", F.explode("edges").alias("e")).select("pivot", "part", "dim", F.col("e.near").alias("member"), F.col("e.fresh").alias("fresh"))
    group = F.pmod(F.xxhash64("pivot", "part"), F.lit(groups)).cast("int")
    members = through_table(naming.unionByName(own).withColumn("g", group), "members")
    kth = F.when(F.size("edges") == NEIGHBOURS, F.element_at("edges", -1)["dist"]).otherwise(float("inf")).cast("float")
    vectors = nodes.select("node", "code", "unit").join(graph.select("node", kth.alias("kth")), "node").withColumnRenamed("node", "member")
    vectors = members.select("dim", "g", "member").distinct().join(vectors, "member")
    vectors = vectors.select(F.col("dim").alias("of"), F.col("g").alias("to"), F.col("member").alias("member"), "code", "unit", "kth")
    met = members.groupBy("dim", "g").cogroup(vectors.groupBy("of", "to")).applyInArrow(introduced, "node long, near long, dist float")
    return _edges(graph, F.lit(False)).unionByName(met.withColumn("fresh", F.lit(True)))


def _edges(graph: DataFrame, fresh: Column) -> DataFrame:
    return graph.select("node", F.explode("edges").alias("e")).select("node", F.col("e.near").alias("near"), F.col("e.dist").alias("dist"), fresh.alias("fresh"))


def build(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, dim, edges): the neighbour graph of written ``nodes``. A node whose dimension no other has is left out."""
    size = nodes.agg(F.count("node").alias("n"), F.sum("dim").alias("numbers")).first()
    groups = max(1, -(-2 * NEIGHBOURS * (size.numbers or 0) // GROUP))
    pairs = _first_pairs(nodes, size.n).withColumn("fresh", F.lit(True))
    dims = nodes.select("node", "dim")
    graph = through_table(_merged(pairs).join(dims, "node").select("node", "dim", "edges"), "graph")
    for _ in range(rounds):
        graph = through_table(_merged(_round(nodes, graph, groups)).join(dims, "node").select("node", "dim", "edges"), "graph")
    return graph


def walkable(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, near, codes, units) with the neighbours' vectors beside their ids, laid out by node."""
    pairs = graph.select("node", F.explode("edges.near").alias("near")).join(nodes.select(F.col("node").alias("near"), "code", "unit"), "near")
    lists = pairs.groupBy("node").agg(F.collect_list(F.struct("near", "code", "unit")).alias("all"))
    return bucketed(lists.select("node", F.col("all.near").alias("near"), F.col("all.code").alias("codes"), F.col("all.unit").alias("units")), "node")


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, near, dist) of the neighbours of expanded nodes that beat the query's bound."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            d = _squares(_decoded([row["code"]], [row["unit"]]), _decoded(row["codes"], row["units"]))[0]
            better = np.flatnonzero(d < row["bound"])
            out.append((np.full(len(better), row["query"], np.int64), np.array(row["near"], np.int64)[better], d[better]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "near", "dist"])


def _started(sample: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The first pool of each query: its own node if it has one, and the nearest nodes of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                x = _decoded([row["code"]], [row["unit"]])
                ids, y = sample.value.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.float32)))
                d = _squares(x, y)[0]
                near = np.argsort(d, kind="stable")[:STARTS]
                pool = [] if row["own"] is None else [(-1.0, row["own"], False)]
                pool += [(float(d[j]), int(ids[j]), False) for j in near if ids[j] != row["own"]]
                rows.append({"query": row["query"], "code": row["code"], "unit": row["unit"], "pool": [dict(zip(("dist", "node", "done"), p, strict=True)) for p in pool]})
            yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

    return run


_STATE = pa.schema([
    ("query", pa.int64()), ("code", pa.binary()), ("unit", pa.float32()),
    ("pool", pa.list_(pa.struct([("dist", pa.float32()), ("node", pa.int64()), ("done", pa.bool_())]))),
])
_STATE_DDL = "query long, code binary, unit float, pool array<struct<dist:float,node:bigint,done:boolean>>"


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools after the nodes expanded are marked and what they reached is taken in."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            left = EXPANDED
            pool = {}
            for p in row["pool"]:
                mark = not p["done"] and left > 0
                left -= mark
                pool[p["node"]] = (p["dist"], p["done"] or mark)
            for c in row["reached"] or []:
                pool.setdefault(c["near"], (c["dist"], False))
            best = sorted((d, node, done) for node, (d, done) in pool.items())[:POOL]
            rows.append({"query": row["query"], "code": row["code"], "unit": row["unit"], "pool": [dict(zip(("dist", "node", "done"), p, strict=True)) for p in best]})
        yield pa.RecordBatch.from_pylist(rows, schema=_STATE)


def walk(graph: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, pool) after greedy search; ``queries(query, own, code, unit)`` with the query's own node or null."""
    spark = nodes.sparkSession
    sample: dict[int, list] = {}
    for row in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "dim", "code", "unit").collect():
        sample.setdefault(row.dim, []).append(row)
    entries = {dim: (np.array([r.node for r in rs]), _decoded([bytes(r.code) for r in rs], [r.unit for r in rs])) for dim, rs in sample.items()}
    shared = spark.sparkContext.broadcast(entries)
    state = through_table(queries.select("query", "own", "code", "unit").mapInArrow(_started(shared), _STATE_DDL), "pools")
    open_ = F.filter("pool", lambda p: ~p["done"])
    while state.filter(F.size(open_) > 0).limit(1).count():
        bound = F.when(F.size("pool") >= POOL, F.element_at("pool", -1)["dist"]).otherwise(float("inf")).cast("float")
        asked = state.select("query", "code", "unit", bound.alias("bound"), F.explode(F.slice(open_, 1, EXPANDED)["node"]).alias("node"))
        reached = asked.join(graph, "node").select("query", "code", "unit", "bound", "near", "codes", "units")
        reached = reached.mapInArrow(_reached, "query long, near long, dist float")
        reached = reached.groupBy("query").agg(F.collect_list(F.struct("near", "dist")).alias("reached"))  # EXPANDED * NEIGHBOURS at most
        state = through_table(state.join(reached, "query", "left").mapInArrow(_advanced, _STATE_DDL), "pools")
    return state.select("query", "pool")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Euclidean distances of the original vectors in double precision."""
    for batch in batches:
        d = []
        for a, b in zip(batch.column("asked"), batch.column("vec"), strict=True):
            gap = a.values.to_numpy() - b.values.to_numpy()
            with np.errstate(over="ignore"):
                length = float(np.sqrt(np.cumsum(gap**2)[-1]))  # added in order
            most = np.abs(gap).max()
            d.append(float(most * np.sqrt(np.cumsum((gap / most) ** 2)[-1])) if not 1e-150 < length < np.inf and 0 < most < np.inf else length)
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), batch.column("members"), pa.array(d, pa.float64())], names=["query", "node", "members", "score"])


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row of ``vectors(vec_id, embedding)`` whose id ``every`` divides.

    Nearest first, equal distances by smaller id. Vectors that are null, empty or zero, or hold null or non-finite numbers, and
    rows with a null id take no part. Only vectors of equal dimension are compared. Rows alike in id and vector are several
    candidates; a query leaves out one row, itself. With k candidates or fewer all are returned. An empty table gives no
    rows; further columns are ignored.
    """
    rows = valid(vectors)
    nodes = through_table(nodes_of(rows, k), "vectors")
    graph = walkable(nodes, build(nodes))
    asking = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).join(nodes.select("vec", "node", "code", "unit"), "vec").select(F.col("vec_id").alias("query_id"), "node", "code", "unit")
    asking = through_table(asking, "asking")
    # Queries of one vector are one search.
    queries = asking.groupBy(F.col("node").alias("query")).agg(F.first("code").alias("code"), F.first("unit").alias("unit")).withColumn("own", F.col("query"))
    pools = walk(graph, nodes, queries).select("query", F.explode("pool.node").alias("node"))
    asked = nodes.select(F.col("node").alias("query"), F.col("vec").alias("asked"))
    met = pools.join(nodes.select("node", "vec", "members"), "node").join(asked, "query")
    scored = met.select("query", "node", "members", "asked", "vec").mapInArrow(_measured, "query long, node long, members array<bigint>, score double")
    found = scored.select("query", "node", "score", F.explode("members").alias("vec_id"))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "node"))).alias("best"))
    joined = asking.select("query_id", F.col("node").alias("query")).join(best, "query")
    itself = F.array_position(F.transform("best", lambda b: (b["node"] == F.col("query")) & (b["vec_id"] == F.col("query_id"))), True).cast("int")
    joined = joined.withColumn("itself", itself)
    others = F.when(F.col("itself") > 0, F.concat(F.slice("best", 1, F.greatest(F.col("itself") - 1, F.lit(0))), F.slice("best", F.col("itself") + 1, k + 1))).otherwise(F.col("best"))
    out = joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
