import hashlib
import math
import random
from collections import defaultdict

import pytest

from meterstone.llm import mixing
from tests.llm.helpers import ODD_TEXTS, words

SCHEMA = "doc_id long, text string, lang string, source string, factor string"


def table(n=3000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "", None])
        lang = rng.choices(["en", "fr", None], [6, 3, 1])[0]
        text = " ".join(["w"] * rng.randrange(1, 30)) + rng.choice(["", "", " | | |", " @ http", " licensed", " !! !!"])
        rows.append((i, text, lang, source, "clash"))
    return rows + [(10_000 + i, t, "en", "odd", None) for i, t in ODD_TEXTS] + [(None, "a b", "en", "a", None), (20_000, "", "zz", "empty", None)]


def brute(cells, sweeps=200):
    dims = list(mixing.TARGETS)
    share = {}
    for d, name in enumerate(dims):
        margin = defaultdict(float)
        for cell, n in cells.items():
            margin[cell[d]] += n
        wanted = {k: v ** mixing.TARGETS[name] if v else 0.0 for k, v in margin.items()}
        share[d] = {k: v / sum(wanted.values()) for k, v in wanted.items()}
    w = {c: float(n) for c, n in cells.items()}
    for _ in range(sweeps):
        for d in range(len(dims)):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * share[d][c[d]] / now[c[d]] if now[c[d]] else 0.0 for c, x in w.items()}
    f = {c: w[c] / n if n else 0.0 for c, n in cells.items()}
    top = max(f.values())
    return {c: x / top for c, x in f.items()}, w, share


def test_factors_and_draws_match_brute_force(spark):
    rows = table()
    got = mixing.annotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    cells = defaultdict(int)
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    want, fitted, share = brute(cells)
    tokens = {i: len(words(t)) for i, t, *_ in rows}
    for r in got:
        p = want[r.source, r.lang, r.topic]
        assert r.probability == pytest.approx(p, abs=2e-6) and r.n_tokens == tokens[r.doc_id]
        if r.doc_id is not None:
            u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
            assert r.sampled == (u < p) or abs(u - p) < 1e-6
    total = sum(fitted.values())
    for d in range(3):
        for k, s in share[d].items():
            assert sum(x for c, x in fitted.items() if c[d] == k) / total == pytest.approx(s, abs=1e-6)


def test_stated_weights_are_reached_in_expectation(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    cells = docs.select(*mixing.labels()).groupBy("source", "lang", "topic").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    out = mixing.rake(cells, {"source": {"big": 1.0, "a": 3.0}, "lang": {"en": 0.5, "fr": 0.5}}).collect()
    by = defaultdict(float)
    for r in out:
        by["source", r.source] += r.factor * r.tokens
        by["lang", r.lang] += r.factor * r.tokens
    assert by["source", "a"] / by["source", "big"] == pytest.approx(3.0, rel=1e-6)
    assert by["lang", "en"] == pytest.approx(by["lang", "fr"], rel=1e-6) and by["source", "b"] == 0
    with pytest.raises(ValueError, match="no weight"):
        mixing.rake(cells, {"source": {"nowhere": 1.0}})


def test_sample_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    out = mixing.sample(docs)
    drawn = {r.doc_id for r in mixing.annotate(docs).collect() if r.sampled}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == drawn
    empty = docs.limit(0)
    assert mixing.annotate(empty).count() == 0 and mixing.sample(empty).count() == 0


def test_topics(spark):
    from pyspark.sql import functions as F

    rows = [("plain", "general"), (None, "general"), ("a | b", "tabular"), ("licensed @", "licence"), ("!! *** @", "emphatic"), ("http://x @y", "contact")]
    got = spark.createDataFrame(rows, "t string, want string").select(mixing.topic_of(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got) and math.isclose(len(got), 6)


def test_margins_that_contradict_each_other_are_reported(spark):
    """Two sources in one language each: the share of a source fixes the share of its language."""
    cells = spark.createDataFrame([("web", "en", 100), ("books", "fr", 900)], "source string, lang string, tokens long")
    targets = {"source": 0.3, "lang": 0.9}
    with pytest.warns(UserWarning, match="raking can't meet all targets: source"):
        got = {r.source: r.factor for r in mixing.rake(cells, targets).collect()}
    met = {(r.dimension, r.label): (r.target, r.reached) for r in mixing.margins(cells, targets).collect()}
    web = 100**0.9 / (100**0.9 + 900**0.9)
    assert met["lang", "en"] == pytest.approx((web, web)) and met["source", "web"] == pytest.approx((100**0.3 / (100**0.3 + 900**0.3), web))
    assert got["web"] == 1 and got["books"] == pytest.approx((1 - web) / 900 / (web / 100))


def test_margins_that_agree_give_no_warning(spark):
    import warnings

    rows = [(s, la, "", n) for s, la, n in [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert mixing.rake(cells).count() == 4
    assert all(abs(r.target - r.reached) < 1e-8 for r in mixing.margins(cells).collect())
    assert mixing.margins(cells.limit(0)).count() == 0 and mixing.rake(cells.limit(0)).count() == 0
