"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are read once into index blocks: a block holds some thousand documents of one task, inverted over the terms that the
items ask for. Nothing is shuffled by term or by document, so a term that every document holds is no hot key. Counts of the
whole corpus come from the blocks. Then each block serves every item: its terms rarest first, adding to accumulators; once
the terms that remain cannot lift a new document to the kth partial score, no accumulator is created any more and only those
that exist are updated, exactly. The kth score that a task has already found for the item counts as well. A task returns at
most k documents an item, which windows merge.

Items are served in groups whose terms fit a broadcast; each group is another pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.tables import utf8
from meterstone.session import through_table

BEST = 10
#: Pairs of item and term served in one pass, which bounds what is broadcast.
ASKED = 1 << 18
#: Documents and postings after which a block ends; one document is never cut.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 20
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 64

_BLOCK = "ids array<bigint>, lengths binary, terms binary, starts binary, docs binary, times binary, n_docs bigint, n_terms bigint"
#: Bytes of a term keep or take lower case, all others become spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size; a cut falls between terms."""
    folded = text.translate(_FOLD)
    at = 0
    while len(folded) - at > most:
        end = folded.find(b" ", at + most)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
    yield folded[at:].split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = utf8(column)
    for first, last in zip(offsets, offsets[1:], strict=False):
        yield data[first:last].tobytes()


def _asked(items: DataFrame) -> DataFrame:
    """(item_id, term) once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                terms = list({t for piece in _pieces(text) for t in piece})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def _indexed(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Index blocks over ``docs(doc_id, text)`` for the terms of ``numbers``."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def block(ids: list, lengths: list, rows: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
        sizes = [len(r) for r in rows]
        term = np.fromiter((t for r in rows for t in r), np.int32, sum(sizes))
        times = np.fromiter((n for r in rows for n in r.values()), np.int32, sum(sizes))
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        parts = [np.array(lengths, np.int64), terms, np.append(starts, len(term)).astype(np.int64), doc, times[order]]
        columns = [pa.array([ids], pa.list_(pa.int64())), *[pa.array([p.tobytes()], pa.binary()) for p in parts], pa.array([n_docs]), pa.array([n_terms])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, lengths, rows = [], [], []
        n_docs = n_terms = held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found: Counter = Counter()
                n = 0
                for piece in _pieces(text):
                    n += len(piece)
                    for term, times in Counter(piece).items():
                        number = known.get(term)
                        if number is not None:
                            found[number] += times
                n_docs += n > 0
                n_terms += n
                if found:
                    ids.append(doc)
                    lengths.append(n)
                    rows.append(found)
                    held += len(found)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield block(ids, lengths, rows, n_docs, n_terms)
                    ids, lengths, rows = [], [], []
                    n_docs = n_terms = held = 0
        if n_docs:
            yield block(ids, lengths, rows, n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK)


def _frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; the answer is as long as the list of terms, which is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for numbers, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(numbers, np.int32)] += np.diff(np.frombuffer(starts, np.int64))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in index.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


@dataclass(frozen=True)
class Plan:
    """What a pass asks for: items as term numbers rarest first with their weights, and the corpus counts."""

    items: list[tuple[int | None, np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, asked: dict, df: np.ndarray, n_docs: int, n_terms: int) -> Plan:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        items = []
        for item, terms in asked.items():
            t = np.array(terms, np.int64)
            t = t[(df[t] > 0) & (weight[t] > 0)]
            t = t[np.lexsort((t, df[t]))]
            items.append((item, t, weight[t]))
        return cls(items, n_docs, n_terms)


def limited(postings: list[tuple[np.ndarray, np.ndarray, int]], docs: int, k: int, known: int = 0) -> np.ndarray:
    """Accumulators of ``docs`` documents after all ``postings``, given rarest first as (documents, gains, largest gain).

    A document whose accumulator was never created is 0; such a document scores less than k others here, or less than
    ``known``. Those created hold their whole score.
    """
    rest = np.cumsum([most for _, _, most in postings][::-1])[::-1] if postings else np.zeros(0, np.int64)
    total = np.zeros(docs, np.int64)
    alive = None
    for (doc, gain, _), remains in zip(postings, rest, strict=True):
        if alive is None:
            reach = known
            if remains < total.max(initial=0) and docs >= k:
                reach = max(reach, int(np.partition(total, docs - k)[docs - k]))
            if remains < reach:
                alive = total > 0
        if alive is None:
            total[doc] += gain
        else:
            kept = alive[doc]
            total[doc[kept]] += gain[kept]
    return total


def _ranked(score: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, a missing id last."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], absent[near], -score[near]))[:k]]
    return np.lexsort((ids, absent, -score))[:k]


def _served(plan, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = plan.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                absent = np.array([i is None for i in row["ids"]], bool)
                ids = np.array([i or 0 for i in row["ids"]], np.int64)
                terms, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int64)
                doc, times = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["times"], np.int32).astype(np.int64)
                if not len(doc):
                    continue
                m = 10 + 90 * np.frombuffer(row["lengths"], np.int64) * asked.n_docs // asked.n_terms
                part = 1_000_000_000 * times // (1000 * times + 8 * m[doc])
                most = np.maximum.reduceat(part, starts[:-1])
                for at, (_, wanted, weights) in enumerate(asked.items):
                    place = np.searchsorted(terms, wanted)
                    held = np.flatnonzero(terms[np.minimum(place, len(terms) - 1)] == wanted)
                    postings = []
                    for j in held:
                        p = place[j]
                        s = slice(starts[p], starts[p + 1])
                        postings.append((doc[s], weights[j] * part[s], int(weights[j] * most[p])))
                    score, old, gone = best.get(at, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
                    known = int(score[-1]) if len(score) == k else 0
                    total = limited(postings, len(ids), k, known)
                    found = np.flatnonzero(total >= max(known, 1))
                    if len(found):
                        score, old, gone = (np.concatenate(x) for x in ((score, total[found]), (old, ids[found]), (gone, absent[found])))
                        top = _ranked(score, old, gone, k)
                        best[at] = score[top], old[top], gone[top]
        for at, (score, ids, absent) in best.items():
            item = pa.array([asked.items[at][0]] * len(score), pa.int64())
            yield pa.RecordBatch.from_arrays([item, pa.array(ids, pa.int64(), mask=absent), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs(doc_id, text)`` for each item of ``items``.

    A null text has no terms. Rows of one ``item_id`` are one item with the terms of all of them, a null id included. Every
    row of ``docs`` is a document of its own, so repeated rows are counted and returned each; among equal scores a null
    doc_id comes last. Items without terms or without documents above 0 have no rows; an empty table on either side gives
    no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    asked = through_table(_asked(items), "asked")
    groups = -(-asked.count() // ASKED)
    out = None
    for group in range(groups):
        # At most ASKED pairs on average, and one item's terms more: what the driver holds and broadcasts.
        pairs = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        numbers: dict[bytes, int] = {}
        wanted: dict[int | None, list[int]] = {}
        for pair in sorted(pairs, key=lambda p: (p.item_id is None, p.item_id or 0, bytes(p.term))):
            wanted.setdefault(pair.item_id, []).append(numbers.setdefault(bytes(pair.term), len(numbers)))
        index = through_table(_indexed(docs, numbers), "blocks")
        counts = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        if not counts.docs:
            continue
        plan = spark.sparkContext.broadcast(Plan.of(wanted, _frequencies(index, len(numbers)), counts.docs, counts.terms))
        found = index.drop("n_docs", "n_terms").mapInArrow(_served(plan, k), "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    out = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")
