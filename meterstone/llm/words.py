"""Words of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow batch.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a sum of table values weighted
by odd powers, so it depends on the bytes alone: any task on any machine gets the same value. Two of n different words
share a hash with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from meterstone.llm.tables import slices, utf8

#: Bytes hashed at once; bounds the memory of a task whatever the length of a text.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_VALUES[_SPACE] = 0


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0xD6E8FEB86659FD93))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(1 << 12)


def _hash(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words; a word also ends where a row begins (``breaks``)."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = breaks[breaks < len(data)]
    starts[first] = inside[first]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), at
    # A word's stretch reaches to the next word; the white space in it adds nothing.
    stretch = np.diff(at, append=len(data))
    place = np.arange(len(data) - at[0], dtype=np.int32)
    place -= np.repeat((at - at[0]).astype(np.int32), stretch)
    longest = int(stretch.max())
    value = (_POWERS if longest <= len(_POWERS) else _powers(longest))[place]
    value *= _VALUES[data[at[0] :]]
    return mix(np.add.reduceat(value, at - at[0])), at


def _long(data: np.ndarray, most: int) -> np.ndarray:
    """Hashes of one text, in pieces cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + most]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + most, len(data))
        parts.append(_hash(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def hashed_words(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, word offsets of the rows) for consecutive row ranges of a string array."""
    data, offsets = utf8(array)
    for first, last in slices(offsets, most):
        hashes, many = [], []
        for a, b in slices(offsets[first : last + 1], CHUNK_BYTES):
            row_at = offsets[first + a : first + b + 1]
            part, row_at = data[row_at[0] : row_at[-1]], row_at - row_at[0]
            if b - a == 1 and len(part) > CHUNK_BYTES:
                hashes.append(_long(part, CHUNK_BYTES))
                many.append([len(hashes[-1])])
                continue
            found, at = _hash(part, row_at[:-1])
            hashes.append(found)
            many.append(np.diff(np.searchsorted(at, row_at)))
        yield first, last, np.concatenate(hashes), np.cumsum(np.concatenate([[0], *many])).astype(np.int64)
