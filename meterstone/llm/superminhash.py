"""Near duplicates by SuperMinHash signatures, banding, verification on full shingle sets and grouping.

SuperMinHash gives every element of a set one random permutation of the slots; an element offers its j-th slot a value in
[j, j + 1). Ranks of one element are thus correlated across slots, which lowers the variance against independent
permutations. A slot filled in round j cannot be improved later, so all elements go through round j together and a
document stops as soon as its slots are full: after one or two rounds for texts of usual length.

Links are never lost in a hot band. Candidates are first the pairs of each bucket's members with its smallest member, of
linear number; verified links are grouped; members of one bucket that still lie in different groups are then compared,
the largest group of a bucket on one side only, as far as an exact bound and the signatures allow a link. Links inside a group need no further comparison, since only the group
counts. Equal sets are one node from the start, however many documents hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.graph import components
from meterstone.llm.tables import packed, text_of
from meterstone.llm.words import hashed_words, mix
from meterstone.session import through_table

WORDS = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
ROWS, BANDS = 4, 24
SLOTS = ROWS * BANDS
#: Slots of a pair at the similarity limit differ in two bits with a probability of 0.1875: 18 of 96, deviation 3.8.
#: A pair with more differing slots than six deviations beyond that is below the limit (an error in 10**9 pairs).
MOST_DIFFERENT = 18 + 23

#: Bits of the parity map, a lower bound of how many elements two sets don't share.
PARITY_BITS = 1024
_SIGNED_WORDS, _PARITY_WORDS = SLOTS // 32, PARITY_BITS // 64
_BIT_WORDS = _SIGNED_WORDS + _PARITY_WORDS

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, 257, dtype=np.uint64) * _GOLD
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as 64-bit hashes, sorted in the row, and the rows' offsets.

    A row of fewer words than ``WORDS`` has its whole sequence as its only shingle; one without words has none.
    """
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    padded = np.concatenate([hashes, np.zeros(WORDS - 1, np.uint64)])
    value = np.zeros(len(hashes), np.uint64)
    left = offsets[rows + 1] - np.arange(len(hashes))
    for k in range(WORDS):
        value += np.where(left > k, padded[k : k + len(hashes)] * _PLACES[k], np.uint64(0))
    value = mix(value + np.minimum(counts, WORDS)[rows].astype(np.uint64))
    first = np.arange(len(hashes)) == offsets[rows]
    real = (left >= WORDS) | (first & (counts[rows] < WORDS))
    value, rows = value[real], rows[real]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(len(counts) + 1)).astype(np.int64)


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: rows x slots; the round in the top byte, then the offered value."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full((len(offsets) - 1, slots), _FULL)
    flat = out.reshape(-1)
    order = None  # per element: its permutation of the slots, as far as it is drawn
    for j in range(slots):
        if not len(rows):
            break
        drawn = mix(elements + _SALTS[j])
        pick = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        value = (mix(drawn ^ _GOLD) >> np.uint64(8)) | np.uint64(j << 56)
        if order is None:
            slot = pick
        else:
            every = np.arange(len(rows))
            slot = order[every, pick].astype(np.int64)
            order[every, pick] = order[:, j]
        np.minimum.at(flat, rows * slots + slot, value)
        open_rows = (out == _FULL).any(axis=1)
        still = open_rows[rows]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(still.sum()), 1))
            order[np.arange(len(order)), pick[still]] = 0
        elif not still.all():
            order = order[still]
        elements, rows = elements[still], rows[still]
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mix(key + parts[:, :, k] * _PLACES[k])
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)


def _two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each slot, 32 slots to a word."""
    bits = (mix(signature) >> np.uint64(62)).reshape(len(signature), -1, 32)
    return (bits << (2 * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _parity(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each element flips one of ``PARITY_BITS`` bits of its row; rows of two sets differ in no more bits than elements."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flips = np.bincount(rows * PARITY_BITS + (elements % np.uint64(PARITY_BITS)).astype(np.int64), minlength=(len(offsets) - 1) * PARITY_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, offsets in hashed_words(batch.column("text")):
            elements, at = shingles(hashes, offsets)
            sizes = np.diff(at)
            some = sizes > 0
            starts = at[:-1][some]
            sums = np.zeros((2, len(sizes)), np.uint64)
            for k in range(2) if len(starts) else ():
                sums[k, some] = np.add.reduceat(mix(elements + _SALTS[k]), starts)
            signature = signatures(elements, at)
            regular = np.arange(last - first + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, last - first),
                    pa.array(sizes),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    _lists(_bands(signature).reshape(-1), regular * BANDS),
                    _lists(np.hstack([_two_bits(signature), _parity(elements, at).reshape(last - first, -1)]).reshape(-1), regular * _BIT_WORDS),
                ],
                names=["id", "n_shingles", "print_a", "print_b", "bands", "bits"],
            )


def sketch(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, print_a, print_b, bands, bits) of ``docs(doc_id, text)``.

    The two prints, sums of independent hashes over the set, stand for the whole set together with its size. ``bits`` are the
    two-bit signature and the parity map.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of("text").alias("text"))
    kinds = "id long, n_shingles long, print_a long, print_b long, bands array<long>, bits array<long>"
    return rows.mapInArrow(_sketch, kinds)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, offsets in hashed_words(batch.column("text")):
            elements, at = shingles(hashes, offsets)
            ids = batch.column("id").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([ids, _lists(elements, at)], names=["id", "shingles"])


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents whose id is in ``ids(id)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of("text").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = joined.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return both.filter(100 * F.col("common") >= SIMILAR * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def _grouped(nodes: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """``nodes`` with the group of each; written, as it is read several times."""
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return through_table(joined.withColumn("component", F.coalesce("component", "rep")), label)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs(doc_id, text)``.

    Rows without a word or text, and rows with a null doc_id, link with nothing; a null doc_id has a null component and is
    kept. Rows that repeat a doc_id are one document for links, whatever their texts, and share its component. An empty
    table gives no rows; further columns are ignored.
    """
    rows = through_table(sketch(docs), "sketch")
    linked = rows.filter("n_shingles > 0 and id is not null")
    prints = ["n_shingles", "print_a", "print_b"]
    nodes = linked.groupBy(*prints).agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min_by("bits", "id").alias("bits"), F.count("id").alias("n_docs"))
    nodes = through_table(nodes, "classes")
    members = linked.select("id", *prints).join(nodes.select(*prints, "rep"), prints).select("id", "rep")
    same_id = members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    keys = nodes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("rep").alias("n")).filter("n > 1").select("key", "least")
    shared = through_table(keys.join(buckets, "key"), "buckets")
    stars = shared.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    brief = nodes.select("rep", "n_shingles", *[F.col("bits")[k].alias(f"w{k}") for k in range(_BIT_WORDS)])
    stars = through_table(_plausible(stars, brief), "stars")
    sets = through_table(full_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")

    # Every document's pair with its smallest centre settles most groups; other centres matter only across groups.
    nearest = stars.groupBy("b").agg(F.min("a").alias("a"))
    links = through_table(verified(nearest, sets), "links")
    groups = _grouped(brief, links, "groups")
    more = _across(stars, groups)
    links = links.unionByName(through_table(verified(more, sets), "links"))
    groups = _grouped(brief, links, "groups")

    mixed = through_table(_mixed(shared, groups), "mixed")
    pairs = through_table(_apart(mixed), "apart")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    missing = through_table(ids.join(sets.select("id"), "id", "left_anti"), "missing")
    sets = sets.unionByName(through_table(full_sets(docs, missing), "sets"))
    links = links.unionByName(through_table(verified(pairs, sets), "links"))

    # Members with the id of their class need no edge, and equal texts link by their class.
    found = components(links.unionByName(same_id).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = rows.select("id", "n_shingles").join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return named.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _close(x: str, y: str) -> Column:
    """Sizes, parity maps and signatures allow the similarity; both sides carry n_shingles and the bit words.

    Sizes and parity decide exactly: 100 i >= S u holds if and only if (100 + S) d <= (100 - S) (n + m) for the number d of
    elements in one set only, of which the differing parity bits are a lower bound.
    """
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    xor = [F.col(f"{x}.w{k}").bitwiseXOR(F.col(f"{y}.w{k}")) for k in range(_BIT_WORDS)]
    slots = sum((F.bit_count(w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseAND(F.lit(0x5555555555555555))) for w in xor[:_SIGNED_WORDS]), F.lit(0))
    parity = sum((F.bit_count(w) for w in xor[_SIGNED_WORDS:]), F.lit(0))
    sizes = 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)
    return sizes & ((100 + SIMILAR) * parity <= (100 - SIMILAR) * (n + m)) & (slots <= MOST_DIFFERENT)


def _plausible(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    joined = pairs.join(brief.alias("y"), F.col("b") == F.col("y.rep")).join(brief.alias("x"), F.col("a") == F.col("x.rep"))
    return joined.filter(_close("x", "y")).select("a", "b")


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    joined = pairs.join(groups.select(F.col("rep").alias("b"), F.col("component").alias("cb")), "b")
    joined = joined.join(groups.select(F.col("rep").alias("a"), F.col("component").alias("ca")), "a")
    return joined.filter("ca <> cb").select("a", "b")


def _mixed(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold several groups, with the bucket's largest group."""
    rows = shared.select("key", "rep").join(groups, "rep")
    sizes = rows.groupBy("key", "component").agg(F.count("rep").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("n").alias("kinds"))
    return rows.join(mixed.filter("kinds > 1").select("key", "largest"), "key")


def _apart(mixed: DataFrame) -> DataFrame:
    """Plausible pairs of a bucket that lie in different groups; the bucket's largest group stands on one side only."""
    fewer, every = mixed.filter("component <> largest").alias("x"), mixed.alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.component") < F.col("y.component"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once
    joined = fewer.join(every, apart & _close("x", "y"))
    return joined.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays: the smallest doc_id of each group, with all columns."""
    dropped = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("dropped")).distinct()
    full = docs.select(packed(docs).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return full.join(dropped, F.col("id") == F.col("dropped"), "left_anti").select("doc.*")
