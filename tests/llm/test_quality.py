import random

import numpy as np
import pytest

from meterstone.llm import quality
from meterstone.llm.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_labelled_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rng = random.Random(1)
    held = {i for i in marks if rng.random() < 0.4}
    model_labels = labels.filter(~labels.doc_id.isin(list(held)))
    got = {r.doc_id: r for r in quality.annotate(docs, model_labels).collect()}
    assert len(got) == docs.count()
    good = [got[i].kept for i in held if marks[i] == 1]
    bad = [got[i].kept for i in held if marks[i] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, "a b c", "en", "s", 5, 0.0), (1, "a b c", "en", "s", 5, 0.0), (2, None, None, None, None, None), (None, "", "", "", -3, 1.0), (3, "x" * 400000, "en", "s", 400000, 1.0)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(docs, none)
    assert out.columns == docs.columns and out.count() == 5
    assert [r.score for r in quality.annotate(docs, none).collect()] == [1.0] * 5
    one = spark.createDataFrame([(1, 1, 0), (99, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.annotate(docs, one).filter("kept").count() == 5
    assert quality.annotate(docs.limit(0), one).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(2)

    def rows(n):
        y = (rng.random(n) < 0.6).astype(float)
        return y, rng.normal(0, 1, (n, 6)) + 1.5 * (y[:, None] - 0.5), rng.normal(0, 1, (n, 4)) + 2 * (y[:, None] - 0.5)

    y, t, m = rows(60)
    _, pt, pm = rows(3000)
    held = np.arange(60) % 3 == 0
    model = quality.co_train(t, m, y, held, pt, pm)
    yy, tt, mm = rows(4000)
    text, metadata, both = model.scores(tt, mm)
    right = [((s > 0.5) == yy).mean() for s in (text, metadata, both)]
    assert right[2] >= max(right[:2]) - 0.01 and right[2] > 0.93


def test_threshold_keeps_the_good():
    score = np.concatenate([np.linspace(0.6, 1, 1000), np.linspace(0, 0.5, 200)])
    y = np.concatenate([np.ones(1000), np.zeros(200)])
    assert 0.5 < quality._threshold(score, y) < 0.6


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.createDataFrame(
        [(i, "good words in a row " * 5 if i % 2 else "!!! ### $$$ " * 9, "en", f"s{i % 2}", 100) for i in range(100)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20000)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, labelled=100)
    assert model.text is not None
    kept = {r.doc_id for r in quality.annotate(docs, labels).filter("kept").collect()}
    assert kept == set(range(1, 100, 2))


def test_labels_of_one_class_are_reported(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "s", 3) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="20 labelled documents"):
        assert quality.annotate(docs, labels).filter("kept").count() == 20


def test_hashing_words_needs_little_memory(monkeypatch):
    """Some MB whatever the batch holds, as two tasks of an executor hash side by side; pieces don't change the words."""
    import tracemalloc

    import pyarrow as pa

    from meterstone.llm import words

    texts = pa.array([f"  Word{i} and\tmore {'of it ' * 150}" for i in range(6000)] + [None, "", " \n", "x" * 5000 + " " * 6000 + "end"])
    tracemalloc.start()
    found = [hashes[:3].copy() for _, _, hashes, _ in words.hashed_words(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 30 << 20

    def every():
        parts = [(hashes, np.diff(at)) for _, _, hashes, at in words.hashed_words(texts, 1 << 30)]
        return [np.concatenate(p) for p in zip(*parts, strict=True)]

    whole = every()
    monkeypatch.setattr(words, "CHUNK_BYTES", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, every(), strict=True)) and len(whole[1]) == len(texts)
