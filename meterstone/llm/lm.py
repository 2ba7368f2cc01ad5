"""Language-model scores from a weighted backoff automaton over words.

The root state holds the smoothed unigrams, P(w) = (c + 0.5) / (N + 0.5 (V + 1)). A word, or a pair of words, that opens a
kept n-gram is a state; its arcs carry (c - D) / c(state) and its failure arc carries L(state), the mass that the arcs leave,
times the next lower state's probability. So each state's probabilities add up to one, whichever n-grams are kept. A text is
traversed once from left to right: each token follows the arc of the state that is carried and its failure arcs, adds the
logarithm of what they weigh together, and leads to the longest state that ends in it.

All training tokens are counted, and every pair and triple of words that occurs at least ``LEAST`` times is kept at any
corpus size. Texts become written chunks of word codes. In a first round each chunk asks buckets of n-grams, dealt by a hash,
for the counts of its distinct n-grams; the answer is 0 for those that are not kept, and names one chunk that owns each kept
n-gram. In a second round the owners' shares of the mass of each state's arcs, and the counts of words, meet in buckets of
states. A chunk sends one record for an n-gram or a state however often it occurs, so no key is hot. Only what a chunk asked
for comes back to it, so no task holds the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.tables import bucketed, text_of
from meterstone.llm.words import hashed_words, mix
from meterstone.session import through_table

#: Documents with crc32(doc_id as text) mod FOLDS equal to HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 5, 1
#: Least count of a kept pair or triple.
LEAST = 2
DISCOUNT = 0.5
#: Bytes of text in a chunk, and tokens of the table for each bucket of an order.
BYTES, BUCKET_TOKENS = 6 << 20, 1 << 20
#: Bits of a key besides those that tell the bucket: of a million different keys in a bucket two fall together in about one
#: bucket of two, so about one n-gram in a million has a count that is not its own.
KEY_BITS = 40

END = mix(np.array([0x5E4D0F7E87], np.uint64))[0]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % FOLDS == HELD_OUT


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(np.int64, copy=False)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    """Steps between sorted 64-bit keys; their running sum gives the keys back."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.int64)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is); places need no stable sort."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


_CHUNK = "chunk long, n int, docs array<long>, held array<boolean>, lengths array<int>, kinds int, words binary, codes binary"
_GRAMS = "bucket long, chunk long, n int, keys binary, counts binary"
_COUNTED = "bucket long, chunk long, n int, counts binary"
_STATES = "bucket long, chunk long, n int, keys binary, counts binary, arcs binary"
_SUMMED = "bucket long, chunk long, n int, totals binary, arcs binary, kinds long"


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def chunks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as a written table of chunks of word codes."""
    most = BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for first, last, hashes, at in hashed_words(batch.column("text"), most):
                lengths = np.diff(at) + 1
                starts = np.concatenate([[0], np.cumsum(lengths)])
                tokens, place = np.full(int(starts[-1]), END), _place(lengths)
                tokens[place < np.repeat(lengths, lengths) - 1] = hashes
                words, _, codes = _unique(tokens)
                row = [
                    [0], [len(tokens)], [ids.slice(first, last - first).to_pylist()], [held.slice(first, last - first).to_pylist()], [lengths],
                    [len(words)], [_packed(_differences(words))], [_packed(codes)],
                ]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=_names(_CHUNK))

    table = docs.mapInArrow(run, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    return bucketed(table, "chunk")


def _place(lengths: np.ndarray) -> np.ndarray:
    """Place of each token in its row."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that sorted keys fall into, where each begins and the last ends)."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    bucket = bucket.astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts], np.append(starts, len(keys))


class Grams:
    """The distinct n-grams of one order in a chunk, by key; ``at`` are the tokens that end one, ``state`` the numbers of the
    words or pairs before these."""

    def __init__(self, order: int, at: np.ndarray, state: np.ndarray, keys: np.ndarray, buckets: int):
        self.order, self.all_buckets, self.at, self.state = order, buckets, at, state
        self.keys, self.first, self.of = _unique(keys)
        self.buckets, self.ends = _buckets(self.keys, buckets)

    def answers(self, got: dict[int, dict]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the kept n-grams, 0 for others; which of them this chunk owns)."""
        found = _joined(got, self.buckets + self.all_buckets * (self.order - 2), np.diff(self.ends), "counts")
        return found >> 1, (found & 1).astype(bool)


class States:
    """The states of one order that a chunk asks for, by key: those of its words or pairs that are ``asked``."""

    def __init__(self, keys: np.ndarray, asked: np.ndarray, order: int, buckets: int):
        self.order, self.all_buckets, self.asked = order, buckets, asked
        self.keys, self.place = keys[asked], np.cumsum(asked) - 1
        self.buckets, self.ends = _buckets(self.keys, buckets)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Places among the states of words or pairs that are asked for."""
        return self.place[numbers]

    def answers(self, got: dict[int, dict], what: str) -> np.ndarray:
        return _joined(got, self.buckets + self.all_buckets * (self.order - 2), np.diff(self.ends), what)


def _joined(got: dict[int, dict], buckets: np.ndarray, sizes: np.ndarray, what: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[_unpacked(got[int(b)][what], int(n)) for b, n in zip(buckets, sizes, strict=True)]])


def _pairs_and_triples(words: np.ndarray, codes: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[Grams]:
    """The key of a triple is made from that of the pair before its last word, which is its state."""
    last = (_ODD * mix(words))[codes]
    at = np.flatnonzero(place >= 1)
    keys = np.zeros(len(codes), np.uint64)
    keys[at] = mix(words[codes[at - 1]] + last[at])
    pairs = Grams(2, at, codes[at - 1], keys[at], buckets)
    yield pairs
    number = np.zeros(len(codes), np.int64)
    number[at] = pairs.of
    at = np.flatnonzero(place >= 2)
    yield Grams(3, at, number[at - 1], mix(keys[at - 1] + last[at]), buckets)


def _asked(words: np.ndarray, codes: np.ndarray, place: np.ndarray, got: dict[int, dict], buckets: int) -> Iterator[tuple[Grams, np.ndarray, np.ndarray, States, np.ndarray]]:
    """(n-grams, their counts, which are owned, states asked for, ends of n-grams with such a state) for pairs and triples.

    The states of pairs are all words of the chunk but the end; those of triples are the kept pairs that go on.
    """
    keys, asked = words, words != END
    for grams in _pairs_and_triples(words, codes, place, buckets):
        count, owned = grams.answers(got)
        # A triple whose pair is not kept can only share the bits of its key with others.
        owned &= asked[grams.state[grams.first]]
        yield grams, count, owned, States(keys, asked, grams.order, buckets), asked[grams.state]
        keys, asked = grams.keys, (count > 0) & (words[codes[grams.at[grams.first]]] != END)


def _read_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, code and place of each token, row of each token, held) of a chunk."""
    lengths = np.array(row["lengths"], np.int64)
    words = np.cumsum(_unpacked(row["words"], row["kinds"]).view(np.uint64), dtype=np.uint64)
    return words, _unpacked(row["codes"], row["n"]), _place(lengths), np.repeat(np.arange(len(lengths)), lengths), np.array(row["held"], bool)


def _shift(buckets: int) -> np.uint64:
    return np.uint64(max(0, 64 - KEY_BITS - buckets.bit_length()))


def grams(table: DataFrame, buckets: int) -> DataFrame:
    """The first round's questions: n-grams with training counts, a row for a bucket and chunk. Triples have the upper buckets."""
    shift = _shift(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, codes, place, owner, held = _read_chunk(row)
                for found in _pairs_and_triples(words, codes, place, buckets):
                    out = []
                    counts = np.bincount(found.of, ~held[owner][found.at], minlength=len(found.keys)).astype(np.int64)
                    for b, i, j in zip(found.buckets, found.ends[:-1], found.ends[1:], strict=True):
                        packs = (_differences(found.keys[i:j] >> shift), counts[i:j])
                        out.append((int(b) + buckets * (found.order - 2), row["chunk"], int(j - i), *map(_packed, packs)))
                    if out:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(_GRAMS))

    return table.select("chunk", "n", "held", "lengths", "kinds", "words", "codes").mapInArrow(run, _GRAMS)


def _records(group: pa.Table, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row ends, values of the columns) of all questions to a bucket; keys are summed up from their steps."""
    n = group.column("n").to_pylist()
    parts = [[_unpacked(x, k) for x, k in zip(group.column(c).to_pylist(), n, strict=True)] for c in columns]
    parts[0] = [np.cumsum(x) for x in parts[0]]
    return np.cumsum([0, *n]), [np.concatenate(p) for p in parts]


def _cut(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [_packed(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def counted(questions: DataFrame, least: int) -> DataFrame:
    """Twice the count of each n-gram asked for, 0 if it is not kept; plus one for the chunk that owns it."""

    def run(group: pa.Table) -> pa.Table:
        ends, (keys, counts) = _records(group, "keys", "counts")
        _, first, at = _unique(keys)
        total = np.bincount(at, counts).astype(np.int64)
        total[total < least] = 0
        out = 2 * total[at]
        out[first] += total > 0
        return group.select(["bucket", "chunk", "n"]).append_column("counts", pa.array(_cut(out, ends), pa.binary()))

    return questions.groupBy("bucket").applyInArrow(run, _COUNTED)


def states(table: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """The second round's questions: states with the chunk's count of a word, and twice the discounted counts of the arcs it owns."""
    shift = _shift(buckets)

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words, codes, place, owner, held = _read_chunk(row)
        got, out = {r["bucket"]: r for r in replies.to_pylist()}, []
        learnt = np.bincount(codes[~held[owner]], minlength=len(words))
        for found, count, owned, asked, _ in _asked(words, codes, place, got, buckets):
            times = learnt[asked.asked] if found.order == 2 else np.zeros(len(asked.keys), np.int64)
            arcs = np.bincount(asked.of(found.state[found.first[owned]]), 2 * count[owned] - int(2 * DISCOUNT), minlength=len(asked.keys)).astype(np.int64)
            for b, i, j in zip(asked.buckets, asked.ends[:-1], asked.ends[1:], strict=True):
                packs = (_differences(asked.keys[i:j] >> shift), times[i:j], arcs[i:j])
                out.append((int(b) + buckets * (found.order - 2), row["chunk"], int(j - i), *map(_packed, packs)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=_names(_STATES))

    asking = table.select("chunk", "n", "held", "lengths", "kinds", "words", "codes").groupBy("chunk")
    return asking.cogroup(counts.groupBy("chunk")).applyInArrow(run, _STATES)


def summed(questions: DataFrame, buckets: int) -> DataFrame:
    """Counts of words and twice the discounted sum of the arcs of each state asked for; one more row for each bucket, with a
    null chunk, has its number of known words."""

    def run(group: pa.Table) -> pa.Table:
        ends, (keys, counts, arcs) = _records(group, "keys", "counts", "arcs")
        _, _, at = _unique(keys)
        total, mass = (np.bincount(at, x).astype(np.int64) for x in (counts, arcs))
        bucket = group.column("bucket")[0].as_py()
        known = int((total > 0).sum()) if bucket < buckets else 0
        n = group.num_rows
        out = [
            [bucket] * (n + 1), [*group.column("chunk").to_pylist(), None], [*group.column("n").to_pylist(), 0],
            [*_cut(total[at], ends), b""], [*_cut(mass[at], ends), b""], [*[0] * n, known],
        ]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=_names(_SUMMED))

    return questions.groupBy("bucket").applyInArrow(run, _SUMMED)


def traversed(lengths: np.ndarray, root: np.ndarray, arcs: dict[int, np.ndarray], fails: dict[int, np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Log-probability of each text, all read from left to right side by side with the order of the state that each carries.

    By token, in the order of the texts: ``root`` has the probability at the root, ``arcs`` and ``fails`` the weights of the
    token's arc and of the failure arc at the states of one word (2) and of two (3), and ``pair`` whether the token and the one
    before are a state.
    """
    texts = np.argsort(-lengths, kind="stable")  # the longest first, so that those still being read are the first ones
    place = _place(lengths)
    rank = np.empty(len(lengths), np.int64)
    rank[texts] = np.arange(len(lengths))
    reading = np.bincount(place) if len(place) else np.zeros(0, np.int64)
    order = np.empty(len(place), np.int64)
    order[(np.cumsum(reading) - reading)[place] + np.repeat(rank, lengths)] = np.arange(len(place))
    root, pair = root[order], pair[order]
    a2, a3, f2, f3 = (x[k][order] for x in (arcs, fails) for k in (2, 3))
    level, score = np.zeros(len(lengths), np.int8), np.zeros(len(lengths))
    at = 0
    for n in reading:
        now, carried = slice(at, at + n), level[:n]
        weight = root[now]
        one = a2[now] + f2[now] * weight
        weight = np.where(carried > 0, one, weight)
        weight = np.where(carried > 1, a3[now] + f3[now] * one, weight)
        score[:n] += np.log10(weight)
        level[:n] = 1 + pair[now]
        at += n
    out = np.empty(len(lengths))
    out[texts] = score
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs(doc_id, text)``.

    Null text is empty: it has the end as its only token. A null doc_id counts as the empty id when documents are dealt to
    training or held out; rows that repeat an id are scored each by itself. Without any training document all counts are 0,
    every token has probability 1 and the scores are 0. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of("text").alias("text"))
    table = chunks(rows)
    one = table.select("n", F.explode(F.arrays_zip("held", "lengths")).alias("d"))
    learnt = ~F.col("d.held")
    everything, n, texts = one.agg(
        F.coalesce(F.sum("d.lengths"), F.lit(0)), F.coalesce(F.sum(F.when(learnt, F.col("d.lengths"))), F.lit(0)), F.count(F.when(learnt, 1))
    ).first()
    buckets = 1 + everything // BUCKET_TOKENS
    counts = bucketed(counted(grams(table, buckets), LEAST), "chunk")
    sums = through_table(summed(states(table, counts, buckets), buckets), "sums")
    kinds = sums.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0] + (texts > 0)
    floor = n + 0.5 * (kinds + 1)

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words, codes, place, owner, held = _read_chunk(row)
        replies = replies.to_pylist()
        first, second = ({r["bucket"]: r for r in replies if (r["counts"] is None) == x} for x in (False, True))
        times = np.full(len(words), texts)  # the end occurs once in each text
        arcs, fails, pair = {}, {}, np.zeros(len(codes), bool)
        before = np.zeros(len(codes), np.int64)  # count of the state before a token
        for found, count, _, asked, able in _asked(words, codes, place, first, buckets):
            if found.order == 2:
                times[asked.asked] = asked.answers(second, "totals")
                single = times[codes]
                before[found.at] = single[found.at - 1]
            else:
                before = np.append(0, twos[:-1])
            mine = np.zeros(len(codes), np.int64)
            mine[found.at] = count[found.of]
            mass = np.zeros(len(codes), np.int64)
            ends = found.at[able]
            mass[ends] = asked.answers(second, "arcs")[asked.of(found.state[able])]
            total = np.maximum(before, 1)
            arcs[found.order] = np.where(mine > 0, (mine - DISCOUNT) / total, 0.0)
            fails[found.order] = 1 - mass / 2 / total
            if found.order == 2:
                twos, pair = mine, mine > 0
        known = single > 0
        root = (times + 0.5) / floor if n else np.ones(len(words))
        many = len(row["docs"])
        base = np.bincount(owner, np.log10(root)[codes], minlength=many)
        score = traversed(np.array(row["lengths"], np.int64), root[codes], arcs, fails, pair)
        out = [row["docs"], row["held"], row["lengths"], np.bincount(owner, known, minlength=many).astype(np.int64), [n] * many, base, score]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=_names(_SCORES))

    asking = table.select("chunk", "n", "docs", "held", "lengths", "kinds", "words", "codes").groupBy("chunk")
    replies = sums.filter("chunk is not null").drop("kinds").unionByName(counts, allowMissingColumns=True)
    return asking.cogroup(replies.groupBy("chunk")).applyInArrow(run, _SCORES)
