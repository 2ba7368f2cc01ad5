import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from meterstone.llm import pieces
from tests.llm.helpers import ODD_TEXTS

TEXTS = ["", " ", "  two  spaces ", "a\nb\tc", "▁ under", "日本語 ﬁ①Ａ", "🙂🙂 x", "<s></s><unk>", "\u0000nul", "é́ é", "x" * 3000, "  ", "ｱﾞ ガ　wide nb"]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_ids_and_text_equal_the_library(spark, model):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + ODD_TEXTS + [(None, "no id")]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = {r.doc_id: r for r in encoded.collect()}
    digests = {r.doc_id: r for r in pieces.digests(encoded).collect()}
    for i, t in rows:
        ids = library.encode(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == library.decode(ids)
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_bounds_cover_the_source_bytes(model):
    encoder = pieces.Encoder.of(model)
    for t in TEXTS:
        data = t.encode()
        [(ids, bounds)] = encoder.encode([data])
        assert len(bounds) == len(ids) + 1 and (np.diff(bounds) >= 0).all()
        assert bounds[0] == 0 and (not ids or bounds[-1] == len(data))
        for k, i in enumerate(ids):
            part = data[bounds[k] : bounds[k + 1]]
            piece = encoder.bytes[i].replace(pieces.SPACE, b" ")
            assert part == piece or (k == 0 and b" " + part == piece) or "▁".encode() in data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_against_the_library(rule, prefix, squeeze):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(made.serialized_model_proto())
    own = pieces.Normaliser(proto.normalizer_spec)
    for t in [*TEXTS, *(x or "" for _, x in ODD_TEXTS)]:
        want, offsets = made.normalize(t, with_offsets=True)
        normal, aligned = own(t.encode())
        assert normal.decode() == want, t
        if want:
            # the library counts characters here; ours are bytes
            starts = [0]
            for c in t:
                starts.append(starts[-1] + len(c.encode()))
            at = np.cumsum([0, *(len(c.encode()) for c in want)])
            assert [int(aligned[k]) for k in at] == [starts[o] for o in offsets], t
