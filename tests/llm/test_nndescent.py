import math
from collections import defaultdict

import numpy as np

from meterstone.llm import nndescent


def brute(rows, k=10, every=100):
    """Ranked (vec_id, distance) of each query row, by position of the row."""
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = defaultdict(list)
    for at, (q, x) in enumerate(kept):
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for j, (i, y) in enumerate(kept) if j != at and len(y) == len(x))
            out[q].append(near[:k])
    return out


def found(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"] and dict(frame.dtypes)["rank"] == "int"
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, true):
    return sum(len({i for _, i, _ in got[q]} & {i for _, i in lists[0]}) for q, lists in true.items()) / sum(len(lists[0]) for lists in true.values())


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x[:600] = x[0] + rng.normal(size=(600, 24)) * 0.01  # a tight cluster
    x[1000:1800] = x[1000]  # copies
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    got = found(nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    true = brute(rows)
    assert got.keys() == true.keys()
    assert all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    assert recall(got, true) >= 0.95
    by_id = dict(rows)
    for q, v in got.items():
        exact = [(float(np.sqrt(((np.array(by_id[q]) - np.array(by_id[i])) ** 2).sum())), i) for _, i, _ in v]
        assert exact == sorted(exact) and np.allclose([d for d, _ in exact], [s for _, _, s in v], rtol=1e-12, atol=0)
        assert q not in {i for _, i, _ in v}
    assert [i for _, i, _ in got[1000]] == list(range(1001, 1011)) and [i for _, i, _ in got[1500]] == list(range(1000, 1010))


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [], 1), (100, [0.0, 0.0], 1), (200, [1.0, None], 1), (4, [nan, 1.0], 1),
        (5, [inf, 1.0], 1), (300, [1.0, 0.0, 0.0], 1), (6, [1.0, 0.0, 5.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (400, [-1.0, 0.0], 1),
        (400, [-1.0, 0.0], 1), (500, [9.0], 1), (-100, [1e200, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = found(nndescent.nearest(frame))
    assert [i for _, i, _ in got[0]] == [7, 7, 1, 400, 400, -100]
    assert [i for _, i, _ in got[300]] == [6] and got[300][0][2] == 5.0
    assert sorted(i for _, i, _ in got[400]) == sorted([0, 7, 7, 1, 400, -100] * 2)
    assert math.isclose(got[-100][0][2], 1e200) and got.keys() == {0, 300, 400, -100}
    assert nndescent.nearest(frame.limit(0)).collect() == []
    assert nndescent.nearest(frame.filter("vec_id = 500")).collect() == []


def test_a_pivot_introduces_its_members():
    import pyarrow as pa

    x = np.array([[0, 0], [1, 0], [5, 0], [1.5, 0]], np.float32)
    vectors = pa.table({"member": [10, 11, 12, 13], "code": [(r * 2).astype(np.int16).tobytes() for r in x], "unit": pa.array([0.5] * 4, pa.float32()), "kth": pa.array([9.0, 9.0, 9.0, 0.1], pa.float32())})
    members = pa.table({"pivot": [1, 1, 1, 1, 2, 2], "part": pa.array([0] * 6, pa.int32()), "member": [10, 11, 12, 13, 10, 12], "fresh": [True, False, False, False, False, False]})
    got = nndescent.introduced(members, vectors).to_pylist()
    assert {(r["node"], r["near"], r["dist"]) for r in got} == {(10, 11, 1.0), (11, 10, 1.0), (10, 13, 2.25)}
