"""Near-duplicate vectors by product quantisation.

A coarse codebook deals unit vectors to inverted lists; residuals are coded per subspace. Each vector searches the lists
nearest to it: table look-ups give the distance to every coded member, which together with the member's own coding error
is a lower bound of the true distance, so dropping what lies beyond the link radius loses nothing. The rest is compared
exactly, by cosine in double precision. A pair is found if either vector's probes hold the other's list; both then count
it. Lists and searches are cut into blocks of bounded size, so a crowded list is shared by many tasks, and a task returns
counts and local components, never pairs.

Both codebooks are fitted on a bounded sample, all vectors are indexed. Equal vectors are one entry with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.llm.graph import components
from meterstone.session import through_table

COSINE = 0.9
#: Bound of the sample that the codebooks are fitted on, and of the number of lists.
SAMPLE, MOST_LISTS = 32768, 4096
#: Lists grow with the square root of the vectors; each vector searches this many.
LISTS_PER_ROOT, PROBES = 2.0, 24
SUBSPACES, CODES = 8, 256
#: Members and searches of a block.
MEMBERS, SEARCHES = 2048, 8192
#: Pairs compared at once.
PAIRS = 1 << 16


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)
    return np.concatenate([(square - 2 * x[k : k + 2048] @ centres.T).argmin(axis=1) for k in range(0, len(x), 2048)])


@dataclass(frozen=True)
class Codebooks:
    coarse: np.ndarray  # lists x dimension
    fine: np.ndarray  # subspaces x codes x dimension of a subspace

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, seed: int = 5) -> Codebooks:
        rng = np.random.default_rng(seed)
        coarse = _means(units, min(lists, len(units)), 8, rng)
        parts = _parts(units - coarse[_nearest(units, coarse)])[: 1 << 14]
        return cls(coarse, np.array([_means(parts[:, s], min(CODES, len(parts)), 8, rng) for s in range(SUBSPACES)]))

    def index(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probed lists (nearest first), codes in the nearest list, and the length of what the codes leave."""
        far = (self.coarse**2).sum(axis=1) - 2 * units @ self.coarse.T
        n = min(PROBES, len(self.coarse))
        probes = np.argpartition(far, n - 1, axis=1)[:, :n]
        rows = np.arange(len(units))[:, None]
        probes = probes[rows, np.argsort(far[rows, probes], axis=1, kind="stable")]
        parts = _parts(units - self.coarse[probes[:, 0]])
        codes = np.array([_nearest(parts[:, s], self.fine[s]) for s in range(SUBSPACES)]).T
        rest = np.array([parts[:, s] - self.fine[s][codes[:, s]] for s in range(SUBSPACES)])
        return probes, codes.astype(np.uint8), np.sqrt((rest**2).sum(axis=(0, 2)))

    def distances(self, which: int, units: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each unit vector to each coded member of list ``which``, by table look-up."""
        parts = _parts(units - self.coarse[which])
        total = np.zeros((len(units), len(codes)), np.float32)
        for s in range(SUBSPACES):
            x, c = parts[:, s], self.fine[s]
            table = ((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)).astype(np.float32)
            total += table[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows x subspaces x dimension of a subspace, filled up with zeros."""
    wide = -(-x.shape[1] // SUBSPACES) * SUBSPACES
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), SUBSPACES, -1)


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(vectors: DataFrame) -> tuple[DataFrame, np.dtype]:
    """(vec_id, dimension, digest, vec): the vector's bytes, null where it can't link; and the type of its numbers."""
    kind = np.dtype(np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("embedding"):
                x = np.array([math.nan if v is None else v for v in row.as_py() or []], kind)
                with np.errstate(over="ignore"):
                    length = np.linalg.norm(x.astype(np.float64)) if len(x) and np.isfinite(x).all() else 0.0
                out.append(x.tobytes() if 0 < length < math.inf else None)
            sizes = [None if v is None else len(v) // kind.itemsize for v in out]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dimension", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dimension int, vec binary")
    rows = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec")))
    return rows.withColumn("digest", F.sha2("vec", 256)), kind


def _index(entries: DataFrame, books, kind: np.dtype) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            probes, codes, rest = books.value.index(_units(_matrix(batch.column("vec"), kind)))
            names = ["rep", "copies", "vec", "list", "probes", "code", "rest"]
            columns = [pa.array(probes[:, 0].astype(np.int32)), pa.array(list(probes.astype(np.int32))), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("vec"), *columns], names=names)

    kinds = "rep long, copies long, vec binary, list int, probes array<int>, code binary, rest double"
    return entries.select("rep", "copies", "vec").mapInArrow(run, kinds)


_FOUND = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])


def _searched(books, kind: np.dtype, limit: float):
    """The search of one block: every query against every member of it."""
    radius = math.sqrt(2 - 2 * limit) + 1e-4

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        which = members.column("list")[0].as_py()
        y, x = _units(_matrix(members.column("vec"), kind)), _units(_matrix(queries.column("asked"), kind))
        codes = _matrix(members.column("code"), np.dtype(np.uint8))
        rest = members.column("rest").to_numpy()
        probes = np.array(members.column("probes").to_pylist())
        ids, asked = members.column("rep").to_numpy(), queries.column("asker").to_numpy()
        own = queries.column("own").to_numpy()
        weight, asking = members.column("copies").to_numpy(), queries.column("asking").to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        step = max(1, (1 << 22) // len(y))
        for at in range(0, len(x), step):
            near = books.value.distances(which, x[at : at + step], codes) - rest <= radius
            q, m = np.nonzero(near)
            for k in range(0, len(q), PAIRS):
                a, b = q[k : k + PAIRS] + at, m[k : k + PAIRS]
                linked = ((x[a] * y[b]).sum(axis=1) >= limit) & (asked[a] != ids[b])
                found.append(np.array([a[linked], b[linked]]))
        a, b = np.concatenate(found, axis=1)
        if not len(a):
            return _FOUND.empty_table()
        unseen = ~(probes[b] == own[a][:, None]).any(axis=1)  # the member's own search misses the query
        nodes = np.unique(np.concatenate([asked[a], ids[b]]))
        left, right = np.searchsorted(nodes, asked[a]), np.searchsorted(nodes, ids[b])
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, left, weight[b])
        np.add.at(n, right[unseen], asking[a[unseen]])
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            np.minimum.at(label, left, before[right])
            np.minimum.at(label, right, label[left])
            label = label[label]
            if (label == before).all():
                break
        return pa.table([nodes, n, nodes[label]], schema=_FOUND)

    return run


def _links(entries: DataFrame, n: int, kind: np.dtype, limit: float) -> DataFrame:
    """(rep, n, least) from all blocks for entries of one dimension."""
    spark = entries.sparkSession
    rows = entries.orderBy("digest").limit(SAMPLE).select("vec").collect()
    sample = _units(np.frombuffer(b"".join(bytes(r.vec) for r in rows), kind).reshape(len(rows), -1))
    lists = max(1, min(MOST_LISTS, math.ceil(LISTS_PER_ROOT * math.sqrt(n)), len(rows) // 8))
    books = spark.sparkContext.broadcast(Codebooks.fit(sample, lists))
    index = through_table(_index(entries, books, kind), "index")
    held = index.groupBy("list").agg(F.count("rep").alias("held"))
    asked = index.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("list").alias("asked"))
    blocks = held.join(asked, "list").select("list", F.ceil(F.col("held") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("asked") / SEARCHES).cast("int").alias("qb"))
    blocks = F.broadcast(through_table(blocks, "blocks"))  # one row per list, at most MOST_LISTS

    def part(key: str, of: str) -> Column:
        return F.pmod(F.hash(key), F.col(of))

    members = index.join(blocks, "list").withColumn("m", part("rep", "mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    names = {"rep": "asker", "copies": "asking", "vec": "asked", "list": "own"}
    queries = index.select(*[F.col(k).alias(v) for k, v in names.items()], F.explode("probes").alias("probe"))
    queries = queries.join(blocks.withColumnRenamed("list", "probe"), "probe").withColumn("q", part("asker", "qb"))
    queries = queries.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    members = members.select("list", "m", "q", "rep", "copies", "vec", "probes", "code", "rest").groupBy("list", "m", "q")
    queries = queries.select("probe", "m", "q", *names.values()).groupBy("probe", "m", "q")
    return members.cogroup(queries).applyInArrow(_searched(books, kind, limit), "rep long, n long, least long")


def near_duplicates(vectors: DataFrame, limit: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty or zero, or that hold null or non-finite numbers, link with nothing, nor do rows with a null
    vec_id, which have a null component and are kept. Vectors of different dimensions never link. Rows alike in id and
    vector are one vector; an id with several vectors has one component. An empty table gives no rows; further columns are
    ignored.
    """
    rows, kind = prepared(vectors)
    rows = through_table(rows, "vectors")
    known = rows.filter("vec is not null")
    single = known.groupBy("digest", "vec_id").agg(F.first("dimension").alias("dimension"), F.first("vec").alias("vec"))
    entries = single.groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count("vec_id").alias("copies"), F.first("dimension").alias("dimension"), F.first("vec").alias("vec"))
    entries = through_table(entries.withColumn("rep", F.monotonically_increasing_id()), "entries")
    found = None
    for size in entries.groupBy("dimension").agg(F.count("rep").alias("n")).collect():
        part = _links(entries.filter(F.col("dimension") == size.dimension), size.n, kind, limit)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = entries.select("rep", F.lit(0).cast("long").alias("n"), F.col("rep").alias("least"))
    found = through_table(found, "found")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    owners = known.select("vec_id", "digest").distinct().join(entries.select("digest", "rep"), "digest")
    several = owners.groupBy("vec_id").agg(F.min("rep").alias("u"), F.count("rep").alias("n")).filter("n > 1")
    same_id = owners.join(several, "vec_id").select("u", F.col("rep").alias("v"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")).unionByName(same_id))
    grouped = entries.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    grouped = grouped.join(named, "component").join(counted, "rep", "left").select("digest", "component_id", "copies", "n")
    joined = rows.select("vec_id", "digest").join(grouped, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    n_links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return joined.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
