import math

import numpy as np

from meterstone.llm import pq
from tests.llm.helpers import smallest_reachable


def vectors(n=1500, d=20, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for k in range(0, n, 10):  # near copies at several distances
        for j in range(1, 4):
            x[k + j] = x[k] + rng.normal(size=d) * (0.1, 0.3, 0.45)[j - 1]
    x[7] = x[9]
    x[17] = 3 * x[19]
    x[200:320] = x[200] + rng.normal(size=(120, d)) * 0.05
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def brute(rows):
    e = np.array([v for _, v in rows])
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [i for i, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(close)), strict=True)]
    return close.sum(axis=1), smallest_reachable(ids, links)


def test_links_and_components_match_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: r for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    n, component = brute(rows)
    found = sum(got[i].n_links for i, _ in rows)
    assert found >= 0.999 * n.sum() and all(got[i].n_links <= k for (i, _), k in zip(rows, n, strict=True))
    wrong = [i for i, _ in rows if got[i].component_id != component[i]]
    assert len(wrong) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [], "x"), (5, [0.0, 0.0], "x"), (6, [1.0, None], "x"), (7, [nan, 1.0], "x"),
        (8, [inf, 1.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (11, [0.0, 1.0], "x"), (2, [0.0, 5.0], "x"),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = pq.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(2, 1, True)] and by[10] == [(2, 1, False)] * 2
    assert sorted(by[2]) == [(1, 1, False), (2, 1, False)] and by[11] == [(1, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9)) and by[None] == [(0, None, True)]
    assert pq.near_duplicates(docs.limit(0)).count() == 0


def test_table_distances_bound_the_true_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = pq.Codebooks.fit(x, 12)
    probes, codes, rest = books.index(x)
    for which in range(12):
        own = probes[:, 0] == which
        true = np.linalg.norm(x[:, None] - x[own][None], axis=2)
        assert (books.distances(which, x, codes[own]) - rest[own] <= true + 1e-4).all()
    assert (probes[:, 0] == pq._nearest(x, books.coarse)).all()
