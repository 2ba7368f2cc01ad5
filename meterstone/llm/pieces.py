"""Offset-preserving SentencePiece encoding and decoding.

Normalisation follows the model's compiled character map: at every position the longest prefix that the map knows is
replaced, else one character is copied; each byte of the result remembers the source byte where its prefix began. The
library segments the text; its pieces, laid end to end, are the normalised text (checked for every document), so running
sums of their lengths, sent through the recorded alignment, give the bytes of the original that each piece stands for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from meterstone.llm.tables import slices, text_of, utf8

SPACE = "▁".encode()
#: Bytes of text that one library call gets.
CALL_BYTES = 1 << 20


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values point into a block of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        found, node = None, self._jump(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


def _character(data: bytes, at: int) -> int:
    lead = data[at]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """Text to (normalised bytes, source offset of each normalised byte and of the end)."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.space = SPACE if spec.escape_whitespaces else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        plain = not self.map.units and not self.squeeze and not self.suffix and len(self.space) == 3
        return self._plain(data) if plain else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change, so the alignment comes from whole-array operations."""
        if not data:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(data, np.uint8)
        width = np.where(source == 0x20, 3, 1)
        at = np.repeat(np.arange(len(source)), width)
        head = 3 if self.prefix else 0
        aligned = np.concatenate([np.zeros(head, np.int64), at, [len(source)]])
        return (SPACE if self.prefix else b"") + data.replace(b" ", SPACE), aligned

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            length, new = found if found else (_character(data, at), data[at : at + _character(data, at)])
            parts.append((new, at))
            at += length
        end = len(data)
        if self.squeeze:
            while parts and parts[0][0].strip(b" ") == b"":
                parts.pop(0)
        if not parts:
            return b"", np.array([end if data and not self.squeeze else 0])
        out, aligned = bytearray(), []

        def put(piece: bytes, where: int) -> None:
            piece = piece.replace(b" ", self.space)
            out.extend(piece)
            aligned.extend([where] * len(piece))

        if self.prefix and not self.suffix:
            put(b" ", parts[0][1])
        after_space = self.squeeze
        for new, where in parts:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new, where)
                after_space = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(self.space):
                end = aligned[len(out) - len(self.space)]
                del out[-len(self.space) :], aligned[-len(self.space) :]
        if self.prefix and self.suffix:
            put(b" ", end)
        return bytes(out), np.array([*aligned, end])


class Encoder:
    """A model with the bytes of its pieces; made once in each Python worker."""

    _made: dict[bytes, Encoder] = {}

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in proto.pieces]
        self.lengths = np.array([len(p) for p in self.bytes])

    @classmethod
    def of(cls, model: bytes) -> Encoder:
        if model not in cls._made:
            cls._made[model] = cls(model)
        return cls._made[model]

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
        """Ids, and the offsets in the source where each piece begins and the last one ends."""
        out = []
        for text, ids in zip(texts, self.library.encode(texts, num_threads=1), strict=True):
            normal, aligned = self.normalise(text)
            if b"".join(map(self.bytes.__getitem__, ids)) != normal:
                raise ValueError("the pieces don't add up to the normalised text")
            bounds = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.lengths[ids], out=bounds[1:]) if ids else None
            out.append((ids, aligned[bounds]))
        return out


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids, bounds, decoded) for ``docs(doc_id, text)``, one row per row.

    Piece k stands for bytes ``bounds[k]`` to ``bounds[k + 1]`` of the text in UTF-8. A null text is empty; an empty text has no
    ids and the bounds ``[0]``. ``model`` is the serialised model, which travels with the task: executors need no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in slices(offsets, CALL_BYTES):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)]
                coded = encoder.encode(texts)
                ends = np.cumsum([0, *(len(ids) for ids, _ in coded)])
                ids = np.concatenate([np.array(ids, np.int32) for ids, _ in coded])
                bounds = np.concatenate([b for _, b in coded]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                        pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(bounds)),
                        pa.array([encoder.library.decode(ids) for ids, _ in coded], pa.string()),
                    ],
                    names=["doc_id", "ids", "bounds", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, bounds array<int>, decoded string")


def _listed(name: str) -> Column:
    return F.sha2(F.array_join(F.col(name).cast("array<string>"), ","), 256)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, bounds_hash) of the rows of ``encode``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _listed("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("bounds").alias("bounds_hash"),
    )


def with_digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids, bounds, n_tokens, decoded_sha256): a training table with a check of the round trip."""
    return encoded.select("doc_id", "ids", "bounds", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))
