import pytest
from pyspark.sql import functions as F

from meterstone.functions import sqltext
from meterstone.operators import scoring

CASES = [
    ("select 'copied from archive' as note from mart_user_metrics", {"mart_user_metrics"}, set()),
    ("select a from t -- join old_table\nwhere b = 1", {"t"}, {"a", "b"}),
    ("select a /* from x, 'y */ from t", {"t"}, {"a"}),
    ("select '-- from x' , '/*' , a from t", {"t"}, {"a"}),
    ("select extract(year from event_date) from t", {"t"}, {"event_date"}),
    ("select trim(both ' ' from a), substring(b from 2 for 3) from s.t", {"s.t", "t"}, {"a", "b"}),
    ("select a from `marts`.`mart_user_metrics`", {"marts.mart_user_metrics", "mart_user_metrics"}, {"a"}),
    ('select "From" from "S"."T x" as y', {"s.t x", "t x"}, {"from"}),
    ("select 1 from x left join lateral y on true", {"x", "y"}, set()),
    ("select 1 from x, lateral (select a from y where x.k = y.k) z", {"x", "y"}, {"a", "k"}),
    ("select count((select max(a) from u)) from t where exists (select 1 from v) and b in (select c from w)", {"t", "u", "v", "w"}, {"a", "b", "c"}),
    ("select coalesce((select a from u), 0) from (t join v using (k)), (select b from x) y", {"t", "u", "v", "x"}, {"a", "b", "k"}),
    ("select a from t where a is distinct from b and c is not distinct from d", {"t"}, {"a", "b", "c", "d"}),
    ("select a from range(10) r, generate_series(1, 2), t", {"t"}, {"a"}),
    ("select a from unnest(x) with ordinality as u(v, i), t", {"t"}, {"a", "x", "v", "i"}),
    ("with recursive r(n) as (select 1 union all select n + 1 from r), b as materialized (select a from t) select n from r, b, s.r", {"t", "s.r", "r"}, {"n", "a"}),
    ("select a from (with q as (select b from t) select b from q)", {"t"}, {"a", "b"}),
    ("from t select a", {"t"}, {"a"}),
    ("select a from d.s.t", {"s.t", "t"}, {"a"}),
    ("select a from t x, s.u as y order by a, b", {"t", "s.u", "u"}, {"a", "b"}),
    ("select a from t union all select b from u order by c, d", {"t", "u"}, {"a", "b", "c", "d"}),
    ("insert into s.t (a, b) select c, d from u", {"s.t", "t", "u"}, {"a", "b", "c", "d"}),
    ("delete from t where a = 'it''s from x'", {"t"}, {"a"}),
    ("update t set a = b from u", {"t", "u"}, {"a", "b"}),
    ("select E'it\\'s from x', $$from y$$, a from t", {"t"}, {"a"}),
    ("select a as mrr, b revenue, sum(c) total, case when d then 1 end e from t", {"t"}, {"a", "b", "c", "d"}),
    ("select 'mart_user_metrics'", set(), set()),
    ("select cast(a as timestamp with time zone), b from t, u", {"t", "u"}, {"a", "b"}),
    ("SELECT A\n FROM\tMarts . Mart_X M ;", {"marts.mart_x", "mart_x"}, {"a"}),
    ("select été from größe", {"größe"}, {"été"}),
]

UNREADABLE = ["what about (mart_z);", "select a from mart_z where (b = 1", "select 'a from mart_z", "select a) from mart_z", "select a /* from mart_z", 'select "a from mart_z']


@pytest.fixture(scope="module")
def read(spark):
    texts = [c[0] for c in CASES] + UNREADABLE + ["", " "]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "q string")
    columns = sorted(set().union(*(c[2] for c in CASES)) | {"mrr", "revenue", "total", "t", "u", "x"})
    rows = frame.select("q", scoring.table_refs(F.col("q")).alias("tables"), sqltext.references(F.col("q")).alias("r"), scoring.column_refs(F.col("q"), columns).alias("columns")).collect()
    return {r.q: r for r in rows}


@pytest.mark.parametrize(("sql", "tables", "columns"), CASES)
def test_references(read, sql, tables, columns):
    row = read[sql]
    assert row.r.readable and set(row.tables) == tables and set(row.columns) == columns


def test_unreadable_texts_fall_back_to_words(read):
    for text in UNREADABLE:
        assert not read[text].r.readable and read[text].tables == ["mart_z"] and read[text].columns == []
    assert read[""].tables == [] and read[" "].tables == [] and not read[""].r.readable
    assert not read[None].tables and not read[None].columns


def test_long_statements(spark):
    sql = "select " + ", ".join(f"'{'x' * 50}''from y' as c{i}" for i in range(2000)) + ", '" + "q" * 200_000 + "' from t " + "-- from z\n" * 5000
    assert spark.createDataFrame([(sql,)], "q string").select(scoring.table_refs(F.col("q"))).first()[0] == ["t"]
