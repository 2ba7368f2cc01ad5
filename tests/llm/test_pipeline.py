import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from meterstone.llm import exact, mixing, quality, superminhash
from meterstone.llm.tables import table
from tests.llm.helpers import shingles, smallest_reachable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
            got = spark.createDataFrame(got.collect(), got.schema)
        out.append((name, docs, got))
        docs = got
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_by_brute_force(spark, stages):
    by = {name: (rows(before), rows(after)) for name, before, after in stages}

    before, after = by["quality_filter"]
    scores = rows(quality.annotate(table(spark, SF, "documents"), table(spark, SF, "labels")))
    assert set(after) == {i for i in before if scores[i].kept}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in after) >= 0.98 * sum(labels.get(i) == 1 for i in before)

    before, after = by["exact_dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
    assert set(after) == set(first.values())

    before, after = by["near_dedup"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = smallest_reachable(sets, links)
    assert set(after) == {i for i in group if group[i] == i}

    before, after = by["mix"]
    drawn = {r.doc_id for r in mixing.annotate(stages[3][1]).collect() if r.sampled}
    assert set(after) == drawn and 0 < len(after) < len(before)

    before, after = by["encode"]
    assert set(after) == set(before)
    for i, r in after.items():
        assert len(r.bounds) == len(r.ids) + 1 and (not before[i].text or r.bounds[-1] == len(before[i].text.encode()))


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()} == {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages[-1][2].collect()}


def test_extra_columns_pass_all_filters(spark):
    docs = table(spark, SF, "documents").limit(60).selectExpr("*", "doc_id as id", "'x' as digest", "1 as component", "map('a', 1) as m")
    for keep in (exact.deduplicate, superminhash.keep_one, mixing.sample, lambda d: quality.keep_good(d, table(spark, SF, "labels"))):
        out = keep(docs)
        assert out.columns == docs.columns and out.count() > 0


def test_registered_names():
    names = set(entry.queries())
    assert {"pipeline"} < names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(entry.oracle_sql()) <= names
