import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterstone.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, ask in wanted.items():
        scored = []
        for doc, c in counted:
            if not c:
                continue
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ask if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(1, 60)))) for i in range(n)]


def test_ranking_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    docs = corpus()
    rng = random.Random(3)
    items = [(i, " ".join(f"W{rng.choice((rng.randint(0, 20), rng.randint(0, 320)))}" for _ in range(rng.randint(1, 25)))) for i in range(40)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows(got) == brute(docs, items)


def test_items_in_several_groups_give_the_same_rows(spark, monkeypatch):
    docs, items = corpus(200), [(i, f"w{i} w{i + 1} w{3 * i}") for i in range(30)]
    monkeypatch.setattr(lexical, "ASKED", 20)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    long = " ".join(f"t{i % 700}" for i in range(40000)) + " needle " + "y" * 3000
    docs = [
        (1, "Éa été the\x00the", 5), (2, "éa", 5), (3, None, 5), (4, "", 5), (5, " -- ", 5), (6, long, 5), (7, "needle_needle", 5), (7, "needle_needle", 5),
        (None, "needle needle", 5), (-8, "THE ÉA x[y]z", 5), (9, "y" * 3000, 5),
    ]
    items = [(1, "éa Éa the THE", 1), (2, "needle", 1), (3, None, 1), (4, "absent", 1), (None, "x", 1), (5, "z", 1), (5, "y z", 1), (6, "y" * 3000, 1), (7, "", 1)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string, rank int"), spark.createDataFrame(items, "item_id long, text string, score int"))
    assert rows(got) == brute([d[:2] for d in docs], [i[:2] for i in items])
    assert [r.doc_id for r in sorted(got.filter("item_id = 2").collect(), key=lambda r: r["rank"])][:3] == [7, 7, None]


@pytest.mark.parametrize("which", ["docs", "items", "textless"])
def test_empty_sides(spark, which):
    docs = spark.createDataFrame([(1, None if which == "textless" else "a b")], "doc_id long, text string").limit(0 if which == "docs" else 1)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string").limit(0 if which == "items" else 1)
    assert lexical.search(docs, items).collect() == []


def test_accumulators_stop_and_survivors_stay_exact():
    rare = (np.arange(12), np.full(12, 100), 100)
    common = (np.arange(1000), np.concatenate([np.arange(12), np.full(988, 90)]), 90)
    total = lexical.limited([rare, common], 1000, 10)
    assert (total[12:] == 0).all() and (total[:12] == 100 + np.arange(12)).all()
    # A document that could tie with the kth still gets its accumulator.
    total = lexical.limited([rare, (common[0], np.full(1000, 100), 100)], 1000, 10)
    assert (total[12:] == 100).all()
