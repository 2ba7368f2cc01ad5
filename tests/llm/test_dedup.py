import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np

from meterstone.llm import exact, graph, superminhash
from tests.llm.helpers import ODD_TEXTS, shingles, smallest_reachable


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_exact_annotate_matches_brute_force(spark):
    rows = ODD_TEXTS + [(100 + i, "hot  copy") for i in range(400)] + [(50, "hot copy"), (None, "hot copy"), (None, "alone")]
    got = exact.annotate(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None)
        assert r.group_size == len(ids)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_repeated_rows_keep_one(spark):
    rows = [(1, "same")] * 300 + [(2, "same")] * 5 + [(3, "other")] * 2 + [(None, "none")] * 2
    docs = frame(spark, rows).repartition(5)
    kept = [r for r in exact.annotate(docs).collect() if r.kept]
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]
    assert sorted((r.doc_id or 0) for r in exact.deduplicate(docs).collect()) == [0, 1, 3]


def test_exact_clashing_columns_and_empty(spark):
    docs = frame(spark, [(1, "a", 5, "k"), (2, "a", 6, None)], "doc_id long, text string, keep_id int, digest string")
    out = exact.deduplicate(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a", 5, "k")]
    assert exact.annotate(docs.limit(0)).count() == 0 and exact.deduplicate(docs.limit(0)).count() == 0


def test_heavy_digests_are_verified(spark):
    rows = [(i, "h" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    heavy = exact.heavy_digests(frame(spark, rows).select("doc_id", exact.digest("text").alias("digest")), share=0.01).collect()
    assert [(r.keep_id, r.group_size) for r in heavy] == [(0, 1000)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (300, 200)]
    got = {r.node: r.component for r in graph.components(frame(spark, links, "u long, v long")).collect()}
    want = smallest_reachable({x for p in links for x in p if x is not None}, [p for p in links if p[0] is not None])
    assert got == want
    assert graph.components(frame(spark, [], "u long, v long")).count() == 0


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    links = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in x for t in y):
            links.append((a, b))
    return smallest_reachable(sets, links)


def near_rows(seed=1):
    rng = random.Random(seed)
    rows = list(ODD_TEXTS)
    common = [f"c{i}" for i in range(60)]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(40)}" for _ in range(rng.choice([4, 6, 20, 120, 400]))]
        for k in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            if rng.random() < 0.3:
                copy = common + copy
            rows.append((1000 + 100 * g + k, " ".join(copy)))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = superminhash.near_duplicates(frame(spark, rows)).collect()
    want = brute(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(texts[r.doc_id]))


def test_near_duplicates_odd_tables(spark):
    docs = frame(spark, [(1, "a b c d e f", 3), (1, "a b c d e f", 3), (2, "a b c d e f", 4), (None, "a b c d e f", 5)], "doc_id long, text string, component long")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in superminhash.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = superminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 30, dtype=np.uint64)
        x, y = (np.sort(np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        signature = superminhash.signatures(np.concatenate([x, y]), np.array([0, 40, 80]))
        errors.append((signature[0] == signature[1]).mean() - 30 / 50)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.24 / superminhash.SLOTS) ** 0.5


def test_each_element_ranks_every_slot_once():
    signature = superminhash.signatures(np.array([123456789], np.uint64), np.array([0, 1]))
    assert sorted(signature[0] >> np.uint64(56)) == list(range(superminhash.SLOTS))
