import random
import re
import zlib
from collections import Counter

import numpy as np

from meterstone.llm import spelling


def vocabulary(docs):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = vocabulary(docs)
    partners = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in partners.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(partners[w]), n.get(form[w])))
    return sorted(rows)


def rows(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in frame.collect())


def edited(word, rng):
    at, letter = rng.randrange(len(word)), rng.choice("abcdefghéü")
    return rng.choice((word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]))


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefghéü", k=rng.randint(5, 9))) for _ in range(60)]
    pool = base + [edited(w, rng) for w in base for _ in range(4)] + ["aaaaa" + "b" * k for k in range(5)]
    pool += [edited(w, rng) for w in pool[60:]]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.3 else w for w in rng.choices(pool, k=120))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = brute(docs)
    assert sum(r[4] for r in expected) > 200 and any(r[2] != r[0] and r[2] != r[1] for r in expected)
    assert rows(spelling.variants(frame)) == expected


def test_a_full_bitmap_and_small_steps_lose_nothing(spark, monkeypatch):
    docs = [(i, "colour color colours cooler cooolor àccent accent accents") for i in range(5)]
    monkeypatch.setattr(spelling, "BITS", 8)
    monkeypatch.setattr(spelling, "HELD", 3)
    monkeypatch.setattr(spelling, "PIECE", 7)
    monkeypatch.setattr(spelling, "AT_ONCE", 4)
    assert rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_chains_longer_than_one_step(spark):
    words = [("abcdef" + "g" * k, 3 * 2**k) for k in range(7)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs) and {r[2] for r in got} == {"abcdefgggggg"}


def test_odd_rows(spark):
    long = "q" * 3000
    docs = [
        (1, None, 1), (2, "", 1), (3, "ÉTUDE étude Étude ÉTUDE études " * 4, 1), (None, "wordy wordy " * 3, 1), (None, "wordz wordz " * 3, 1),
        (4, "abcd " * 9 + "naïveĀnaive " * 5 + "x×y÷zw " * 3, 1), (4, "naïve " * 4, 1), (4, "naïve " * 4, 1), (5, f"{long} {long} {long} {long}r {long}r {long}r", 1),
        (6, "\U0001f600wordy1wordz_wordy", 1),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word int")
    assert rows(spelling.variants(frame)) == brute([d[:2] for d in docs])
    assert rows(spelling.variants(frame.limit(0))) == [] and rows(spelling.variants(frame.filter("doc_id < 3"))) == []


def test_neighbourhood_holds_all_edits():
    for reduced in ([1, 2, 3], [5, 5, 5, 8]):
        x = np.array([reduced], np.uint64)
        got = {int(k) for block in spelling.neighbourhood(x) for k in block.ravel()}
        expected = {tuple(reduced)}
        for i in range(len(reduced) + 1):
            expected |= {(*reduced[:i], s, *reduced[i:]) for s in range(1, 9)}
            if i < len(reduced):
                expected |= {(*reduced[:i], *reduced[i + 1 :])} | {(*reduced[:i], s, *reduced[i + 1 :]) for s in range(1, 9)}
        assert got == {int(spelling._keys(np.array([e], np.uint64))[0]) for e in expected}
