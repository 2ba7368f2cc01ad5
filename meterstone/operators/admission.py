"""Sliding-window admission: at most ``limit`` admitted rows per key in any window; refused rows use no quota.

A per-key throttle is the plain case. A result store with a time to live is the case ``limit = 1``: the one admitted
row is the run that stores its result, and refused rows are the hits that the stored result answers.

The decision for a row depends on the decisions before it, but only within one window: after a silence of a window nothing
is live any more. Each key is therefore cut into segments at such silences, found from the first and last call of each key
and cell of the calendar, which are summed map-side. Segments are dealt out, sorted by time, and read as a stream: a task
holds the instants of at most ``limit`` admitted rows, however long a segment is, and writes the flag next to every row.
Refused rows between two admissible instants are skipped by binary search. Nothing runs before an action.

A key that is never silent is one segment, which is cut into blocks of about ``BLOCK_ROWS`` rows at the calendar's cells. What
a block does is a function from the instants that are live when it begins to those that are live when it ends, and it is
made from the block alone: with ``limit = 1`` by pointer doubling over the next admissible instants, which leaves the few
entries at which the outcome changes; otherwise it stays the block's bare instants, at most ``limit`` of a kind, which are
only searched. One stream per long segment composes the functions, and every block is then decided on its own, with the
instants live at its beginning as rows that are settled already.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.clock import SECOND, from_micros, micros


#: Rows after which a segment is cut; a block holds one cell at least.
BLOCK_ROWS = 1 << 17


def segments(calls: DataFrame, window_us: int) -> DataFrame:
    """(key, cell, segment, block, blocks) for rows (key, us, cell).

    A new segment begins after a silence of at least one window; ``blocks`` is the number of its last block.
    """
    cells = calls.groupBy("key", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("us").alias("n"))
    # The window goes over one row per key and cell, never over calls.
    by_key = W.partitionBy("key").orderBy("cell")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(by_key) >= window_us, F.lit(True))
    start = F.when(fresh, F.col("cell"))
    cut = cells.select("key", "cell", "n", F.last(start, ignorenulls=True).over(by_key).alias("segment"))
    before = F.sum("n").over(W.partitionBy("key", "segment").orderBy("cell")) - F.col("n")
    # Blocks are numbered by the rows before them, so numbers may be left out.
    cut = cut.withColumn("block", F.floor(before / BLOCK_ROWS).cast("bigint"))
    return cut.withColumn("blocks", F.max("block").over(W.partitionBy("key", "segment"))).drop("n")


class Admission:
    """State of one segment: the instants of its live admitted rows."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us, self.live = limit, window_us, deque()

    def decide(self, us: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Flags for ascending instants that follow those seen before; settled ones are admitted already."""
        out = np.zeros(len(us), bool)
        at = 0
        for stop in [*np.flatnonzero(settled), len(us)]:
            self._free(us[at:stop], out[at:stop])
            if stop < len(us):
                out[stop] = True
                self.live.append(int(us[stop]))
            at = stop + 1
        return out

    def _free(self, us: np.ndarray, out: np.ndarray) -> None:
        at = 0
        while at < len(us) and self.limit > 0:
            while self.live and self.live[0] <= us[at] - self.window_us:
                self.live.popleft()
            if len(self.live) >= self.limit:
                at += int(np.searchsorted(us[at:], self.live[0] + self.window_us))
                continue
            out[at] = True
            self.live.append(int(us[at]))
            at += 1


def _decide(limit: int, window_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, owner = Admission(limit, window_us), None
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column("us").to_numpy()
            first, settled = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "settled"))
            starts = [0, *(k for k in np.flatnonzero(first) if k), batch.num_rows]
            flags = []
            for a, b in zip(starts, starts[1:], strict=False):
                if first[a] or owner is None:
                    state, owner = Admission(limit, window_us), True
                flags.append(state.decide(us[a:b], settled[a:b]))
            kept = {name: batch.column(name) for name in ("id", "key", "us", "settled", "carried")}
            yield pa.RecordBatch.from_pydict({**kept, "admitted": pa.array(np.concatenate(flags))})

    return run


def single_exits(us: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a block with ``limit = 1``: (entries in order, last admitted instant of each).

    Whoever may be admitted from instant t on leaves the block with the last admitted instant of the first entry at or
    after t. Only entries within a window of the first are asked for, and the one after them.
    """
    us = np.unique(us)
    step = np.searchsorted(us, us + window_us)
    # Each instant points to the next one that it lets in; those without one point to themselves.
    ends = np.where(step < len(us), step, np.arange(len(us)))
    while (ends[ends] != ends).any():
        ends = ends[ends]
    asked = np.searchsorted(us, us[0] + window_us) + 1
    entries, exits = us[:asked], us[ends[:asked]]
    kept = np.append(exits[1:] != exits[:-1], True)
    return entries[kept], exits[kept]


def _packed(limit: int, window_us: int):
    """One block's function as bytes."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        us, settled = rows.column("us").to_numpy(), rows.column("settled").to_numpy()
        order = np.lexsort((~settled, us))
        us, settled = us[order], settled[order]
        if limit == 1 and not settled.any():
            us, out = single_exits(us, window_us)
        else:
            # Of free calls at one instant no more than the limit can be admitted.
            place = np.arange(len(us)) - np.searchsorted(us, us)
            kept = settled | (place < limit + np.cumsum(settled) - np.append(0, np.cumsum(settled))[np.searchsorted(us, us)])
            us, out = us[kept], settled[kept].astype(np.int64)
        single = bool(limit == 1 and not settled.any())
        return pa.table([[us.tobytes()], [out.tobytes()], [single]], schema=pa.schema([("us", pa.binary()), ("out", pa.binary()), ("single", pa.bool_())]))

    def keyed(group: tuple, rows: pa.Table) -> pa.Table:
        out = run(group, rows)
        for k, name in enumerate(("key", "segment", "block")):
            out = out.add_column(k, rows.schema.field(name), rows.column(name).slice(0, 1))
        return out

    return keyed


def _composed(limit: int, window_us: int):
    """(key, segment, block, live) at the beginning of every block but a segment's first, for blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, owner = Admission(limit, window_us), None
        for batch in batches:
            kept, live = [], []
            for k in range(batch.num_rows):
                mine = (batch.column("key")[k].as_py(), batch.column("segment")[k].as_py())
                if mine != owner:
                    state, owner = Admission(limit, window_us), mine
                else:
                    kept.append(k)
                    live.append(list(state.live))
                us, out = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("us", "out"))
                if batch.column("single")[k].as_py():
                    at = int(np.searchsorted(us, state.live[-1] + window_us)) if state.live else 0
                    if at < len(us):
                        state.live = deque([int(out[at])])
                else:
                    state.decide(us, out.astype(bool))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("key", "segment", "block")), pa.array(live, pa.list_(pa.int64()))], names=["key", "segment", "block", "live"])

    return run


def decide_slim(slim: DataFrame, limit: int, window_us: int) -> DataFrame:
    """(id, key, us, settled, admitted) for rows (id, key, us, settled); settled rows are admitted and use quota."""
    slim = slim.withColumn("cell", F.floor(F.col("us") / window_us).cast("bigint"))
    parts = segments(slim, window_us).withColumnsRenamed({"key": "owner", "cell": "own_cell"})
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def placed(parts: DataFrame) -> DataFrame:
        rows = slim.join(parts, slim["key"].eqNullSafe(parts["owner"]) & (slim["cell"] == parts["own_cell"]))
        return rows.select("id", "key", "us", "settled", "segment", "block", F.lit(False).alias("carried"))

    place = ["key", "segment", "block"]
    kinds_of_place = f"key {kinds['key']}, segment bigint, block bigint"
    functions = placed(parts.where("blocks > 0")).select(*place, "us", "settled").groupBy(*place)
    functions = functions.applyInArrow(_packed(limit, window_us), f"{kinds_of_place}, us binary, out binary, single boolean")
    functions = functions.repartition("key", "segment").sortWithinPartitions(*place)
    live = functions.mapInArrow(_composed(limit, window_us), f"{kinds_of_place}, live array<bigint>")
    carried = live.select(
        F.lit(None).cast(kinds["id"]).alias("id"), "key", F.explode("live").alias("us"), F.lit(True).alias("settled"), "segment", "block", F.lit(True).alias("carried")
    )
    rows = placed(parts).unionByName(carried)
    # The window marks where a block begins; its partitioning and order are the ones the stream needs.
    in_order = W.partitionBy(*place).orderBy("us", F.col("settled").desc(), "id")
    sorted_rows = rows.select("id", "key", "us", "settled", "carried", (F.row_number().over(in_order) == 1).alias("first"))
    schema = f"id {kinds['id']}, key {kinds['key']}, us bigint, settled boolean, carried boolean, admitted boolean"
    return sorted_rows.mapInArrow(_decide(limit, window_us), schema).where(~F.col("carried")).drop("carried")


def decide(calls: DataFrame, *, key: Column, ts: Column, id: Column, limit: int, window_seconds: int) -> DataFrame:
    """(id, key, ts, admitted), one row for every call; an id may repeat or be NULL, each call is decided by itself.

    Calls of one instant are taken in the order of their ids, NULL first. Calls without a key share the NULL key. Calls
    without a time cannot be ordered and come back undecided (NULL).
    """
    slim = calls.where(ts.isNotNull()).select(
        id.alias("id"), key.alias("key"), micros(ts).alias("us"), F.lit(False).alias("settled")
    )
    undecided = calls.where(ts.isNull()).select(
        id.alias("id"), key.alias("key"), ts.alias("ts"), F.lit(None).cast("boolean").alias("admitted")
    )
    decided = decide_slim(slim, limit, window_seconds * SECOND)
    return decided.select("id", "key", from_micros(F.col("us")).alias("ts"), "admitted").unionByName(undecided)
