"""Groups of spelling variants by generation over a reduced alphabet.

Letters are hashed to a few symbols, which turns the vocabulary into fewer reduced words. Words one edit apart have reduced
words that are equal or one edit apart, so the full one-edit neighbourhood of every reduced word is generated, as 64-bit
keys, and joined to the reduced vocabulary. Words behind joined reduced words are verified on their original strings inside
the join, so pairs that fail never become rows. Per word only a count and the best partner are kept, which combine before
they are shuffled.

A bitmap of fixed size over the keys of the reduced vocabulary is broadcast: most generated keys meet no reduced word and are
dropped where they are made. With a vocabulary too large for the bitmap more keys travel; none that matters is ever lost. Two
of n different reduced words share a key with probability n * n / 2**65.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.tables import text_of
from meterstone.llm.words import mix
from meterstone.session import through_table

#: A letter's symbol is its code point modulo this.
SYMBOLS = 8
#: A run loses a letter where this divides its checksum.
DAMAGED = 97
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: A form has at least this many times the word's occurrences.
TIMES = 2
#: Entries that a task counts before it passes them on, and bytes of a text split at once.
HELD, PIECE = 1 << 18, 1 << 20
#: Two to this power is the number of bits of the broadcast bitmap (8 MB).
BITS = 26
#: Symbols and keys made at once, which bounds a task's memory for words of any length.
AT_ONCE = 1 << 20

#: Latin-1 bytes: A-Z fold, letters stay, all others separate.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _runs(text: str, most: int = PIECE) -> Iterator[list[bytes]]:
    """Folded runs of letters, one Latin-1 byte a code point, in lists of bounded size."""
    folded = text.encode("latin-1", "replace").translate(_FOLD)  # what Latin-1 lacks becomes a question mark
    at = 0
    while len(folded) - at > most:
        end = folded.find(b" ", at + most)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
    yield folded[at:].split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def vocabulary(docs: DataFrame, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n) over whole texts of ``docs(doc_id, text)``; a null id is written as nothing before the colon."""

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(b"%s:" % (doc.as_py() or "").encode())
                for piece in _runs(text.as_py()):
                    for word, n in Counter(piece).items():
                        length = len(word)
                        if length < LEAST_LENGTH:
                            continue
                        h = zlib.crc32(_utf8(word), start)
                        if h % DAMAGED == 0:
                            if length == LEAST_LENGTH:
                                continue
                            at = h % length
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                    if len(held) >= HELD:
                        yield counted(held)
                        held = Counter()
        yield counted(held)

    rows = docs.select(F.col("doc_id").cast("string"), text_of("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _symbols(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols 1 to SYMBOLS."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return (codes % SYMBOLS + 1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The 64-bit key of each reduced word."""
    return mix((symbols * _powers(symbols.shape[1])).sum(axis=1, dtype=np.uint64))


def neighbourhood(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of each reduced word and of all reduced words one edit away, rows as ``symbols``, in blocks of columns."""
    n, m = symbols.shape
    powers = _powers(m + 1)
    terms = symbols * powers[:m]
    before = np.zeros((n, m + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:], dtype=np.uint64)
    whole = before[:, -1:]
    yield mix(whole)
    yield mix(before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_INVERSE))  # one symbol less
    for s in range(1, SYMBOLS + 1):
        yield mix(whole - terms + powers[:m] * np.uint64(s))  # one symbol changed
        yield mix(before + powers * np.uint64(s) + (whole - before) * np.uint64(_P))  # one symbol more


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols) of words of one length, in groups of bounded size."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, AT_ONCE // int(length))
        for k in range(0, len(places), step):
            yield places[k : k + step], _symbols([words[p] for p in places[k : k + step]])


def _reduced(words: DataFrame) -> DataFrame:
    """``words(word, n)`` with the key of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = np.zeros(len(words), np.uint64)
            for places, symbols in _by_length(words):
                keys[places] = _keys(symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return words.mapInArrow(run, "word string, n long, key long")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys that occur; the answer has 2 ** (BITS - 6) rows at most."""
    slot = F.shiftrightunsigned("key", 64 - BITS + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63 as int))")
    out = np.zeros(1 << (BITS - 6), np.int64)
    for batch in keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def _generated(reduced: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, near): each reduced word's key beside those of its neighbourhood that the bitmap holds."""
    shared = reduced.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            words, own = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for places, symbols in _by_length(words):
                keys, near = [], []
                for block in neighbourhood(symbols):
                    place = block >> np.uint64(64 - BITS)
                    row, column = np.nonzero(held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                    keys.append(own[places][row])
                    near.append(block[row, column].view(np.int64))
                pairs = np.unique(np.array([np.concatenate(keys), np.concatenate(near)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "near"])

    return reduced.mapInArrow(run, "key long, near long")


def _partners(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for words that have a near word; ``words(word, n, key)`` is written."""
    # One word stands for all of its reduced word.
    reduced = words.groupBy("key").agg(F.min("word").alias("word"))
    pairs = _generated(reduced.select("word", "key"), _bitmap(words.select("key")))
    left = words.select("key", F.col("word").alias("a"))
    right = words.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # The pairs of keys meet the words on both sides; the edit is verified within the second join.
    met = pairs.join(left, "key").join(right, (pairs.near == right.near) & (F.levenshtein("a", "b", 1) == 1))
    best = F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")))
    found = met.groupBy(F.col("a").alias("word")).agg(F.count("b").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, by pointer doubling: occurrences double along a chain, so rounds are few."""
    steps = through_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left")
        moved = through_table(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs(doc_id, text)``.

    Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count each. Among near words of
    equal count the smallest in code-point order is the form. An empty table gives no rows; further columns are ignored.
    """
    words = through_table(_reduced(vocabulary(docs)), "vocabulary")
    near = through_table(_partners(words), "partners")
    joined = words.select("word", "n").join(near, "word", "left")
    named = F.col("form_n") >= TIMES * F.col("n")
    joined = through_table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(named, F.col("form")).alias("form"), F.when(named, F.col("form_n")).alias("form_n")), "forms")
    out = joined.join(_roots(joined.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
