import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterstone.llm import lm
from tests.llm.helpers import ODD_TEXTS, words

END = "\0end"


def rows_of(n=300):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)]
    out = []
    for i in range(n):
        w = [vocabulary[0]]
        for _ in range(rng.randrange(1, 40)):
            k = vocabulary.index(w[-1]) if w[-1] in vocabulary else 0
            w.append(rng.choice([vocabulary[(k * 7 + 1) % 60], vocabulary[(k * 3 + 2) % 60], rng.choice(vocabulary), f"r{rng.randrange(4000)}"]))
        out.append((i, " ".join(w)))
    return out + [(1000 + i, t) for i, t in ODD_TEXTS] + [(None, "v0 v1"), (3, "again")]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Brute:
    """The same model by dictionaries, one token at a time."""

    def __init__(self, rows):
        texts = [[*words(t), END] for i, t in rows if not held(i)]
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.two = {p: k for p, k in Counter(p for t in texts for p in zip(t, t[1:])).items() if k >= 2}
        self.three = {p: k for p, k in Counter(p for t in texts for p in zip(t, t[1:], t[2:])).items() if k >= 2}
        self.fail1, self.fail2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
        for (a, _), k in self.two.items():
            self.fail1[a] -= (k - 0.5) / self.c[a]
        for (a, b, _), k in self.three.items():
            self.fail2[a, b] -= (k - 0.5) / self.two[a, b]

    def p1(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1)) if self.n else 1.0

    def p2(self, a, w):
        return ((self.two[a, w] - 0.5) / self.c[a] if (a, w) in self.two else 0.0) + self.fail1[a] * self.p1(w)

    def p3(self, a, b, w):
        if (a, b) not in self.two:
            return self.p2(b, w)
        return ((self.three[a, b, w] - 0.5) / self.two[a, b] if (a, b, w) in self.three else 0.0) + self.fail2[a, b] * self.p2(b, w)

    def score(self, text):
        t = [None, None, *words(text), END]
        return sum(math.log10(self.p3(*t[k - 2 : k + 1])) for k in range(2, len(t)))


def check(spark, rows):
    got = lm.scores(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()
    model = Brute(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert len(got) == len(rows)
    for r in got:
        t = next(t for t in texts[r.doc_id] if len(words(t)) + 1 == r.n_tokens)
        tokens = [*words(t), END]
        assert r.held_out == held(r.doc_id) and r.train_tokens == model.n
        assert r.n_known == sum(model.c[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10(model.p1(w)) for w in tokens), abs=1e-7)
        assert r.score == pytest.approx(model.score(t), abs=1e-7)
    return got, model


def test_scores_match_dictionaries(spark):
    got, model = check(spark, rows_of())
    assert len(model.three) > 50
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_states_are_distributions():
    model = Brute(rows_of())
    every = [*model.c, "unseen"]
    for a, b in list(model.two)[:20]:
        assert sum(model.p3(a, b, w) for w in every) == pytest.approx(1.0, abs=1e-9)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    only = [(i, "a b") for i in range(40) if held(i)]
    assert [(r.score, r.base_score, r.n_known) for r in lm.scores(spark.createDataFrame(only[:2], schema)).collect()] == [(0.0, 0.0, 0)] * 2
    assert lm.scores(spark.createDataFrame([], schema)).count() == 0


def same_as_dictionaries(spark, rows):
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    model, texts = Brute(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*words(texts[r.doc_id]), END]
        assert r.train_tokens == model.n and r.n_known == sum(model.c[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10(model.p1(w)) for w in tokens), abs=1e-6)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), abs=1e-6)
    return model


def test_ngrams_are_kept_whatever_the_size_of_the_corpus(spark):
    """With 400,000 tokens a share of 2**-16 is 6 times; pairs and triples that occur twice are to be kept."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"u{rng.randrange(3000)}" for _ in range(1000))) for i in range(500)]
    rows += [(i + 500, rows[i][1]) for i in range(0, 20)]
    model = same_as_dictionaries(spark, rows)
    assert model.n > 3 * 2**16 and sum(k == 2 for k in model.three.values()) > 1000


def test_small_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 500)
    model = same_as_dictionaries(spark, [r for r in rows_of() if r[0] is not None and (r[0] != 3 or r[1] == "again")])
    assert len(model.three) > 50


def test_the_state_is_carried_from_token_to_token():
    """Two texts side by side; the second loses its state of two words and falls back."""
    lengths = np.array([2, 3])
    root = np.array([0.1, 0.2, 0.1, 0.2, 0.3])
    arcs = {2: np.array([0, 0.5, 0, 0, 0.25]), 3: np.array([0, 0.9, 0, 0, 0.5])}
    fails = {2: np.array([1, 0.5, 1, 1, 0.75]), 3: np.array([1, 0.1, 1, 1, 0.5])}
    pair = np.array([False, True, False, False, True])
    got = lm.traversed(lengths, root, arcs, fails, pair)
    # No text reaches a state of two words before its last token, so their arcs are not followed.
    assert np.allclose(got, [np.log10(0.1 * (0.5 + 0.5 * 0.2)), np.log10(0.1 * 0.2 * (0.25 + 0.75 * 0.3))])
    pair[3] = True
    assert np.allclose(lm.traversed(lengths, root, arcs, fails, pair)[1], np.log10(0.1 * 0.2 * (0.5 + 0.5 * (0.25 + 0.75 * 0.3))))
    assert len(lm.traversed(np.zeros(0, np.int64), *[np.zeros(0)] * 1, {2: np.zeros(0), 3: np.zeros(0)}, {2: np.zeros(0), 3: np.zeros(0)}, np.zeros(0, bool))) == 0


def test_states_of_triples_are_the_pairs_of_the_chunk():
    """A triple's state is found by its pair's number, without a second sort or search; keys agree with those of the pairs."""
    tokens = [1, 2, 3, 1, 2, 4, 1, 2, 3]
    words = np.array([5, 6, 7, 8], np.uint64)
    codes, place = np.array(tokens) - 1, np.array([0, 1, 2, 3, 4, 5, 0, 1, 2])
    two, three = lm._pairs_and_triples(words, codes, place, 1)
    assert len(two.keys) == 4 and len(three.keys) == 4
    for grams, order in ((two, 2), (three, 3)):
        names = [tuple(tokens[k - order + 1 : k + 1]) for k in grams.at]
        assert len(set(zip(names, grams.of))) == len(set(names)) == len(grams.keys)
        states = {(n[:-1], int(s)) for n, s in zip(names, grams.state)}
        assert len(states) == len({n[:-1] for n in names})
    pair_of = dict(zip(two.at, two.of))
    assert all(pair_of[k - 1] == s for k, s in zip(three.at, three.state))
