import os
import uuid

import pytest

from meterstone.operators import inventory, quality
from meterstone.plans import exports
from meterstone.plans.warehouse import Warehouse
from meterstone.session import new_scratch, scratch_root, through_table
from meterstone.sources import csv_tables, schemas, sinks

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_csv_keeps_null_and_empty_apart(spark):
    rows = [
        ("1", "U1", "pro", 1.5, "2023-01-01", "", " Annual"),
        ("2", None, 'a "b", c', None, "2023-01-01", None, "line\nbreak"),
    ]
    df = spark.createDataFrame(rows, schemas.RAW_SUBSCRIPTIONS)
    path = new_scratch(spark, "csv")
    csv_tables.write_csv(df.where("subscription_id = '1'"), path)
    assert csv_tables.read_raw_csv(spark, path, "raw_subscriptions").collect() == df.where("subscription_id = '1'").collect()
    other = new_scratch(spark, "csv")
    csv_tables.write_csv(df.where("subscription_id = '2'").withColumn("billing_interval", df.plan), other)
    back = csv_tables.read_raw_csv(spark, other, "raw_subscriptions").first()
    assert (back.user_id, back.plan, back.mrr_usd, back.ended_at) == (None, 'a "b", c', None, None)


def test_csv_that_does_not_fit_raises(spark, tmp_path):
    (tmp_path / "x.csv").write_text("subscription_id,user_id,plan,mrr_usd,started_at,ended_at,billing_interval\n1,U,p,oops,a,b,c\n")
    with pytest.raises(Exception):
        csv_tables.read_raw_csv(spark, str(tmp_path), "raw_subscriptions").collect()


def test_scratch_follows_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")
    assert new_scratch(spark, "x") != new_scratch(spark, "x")
    assert through_table(spark.range(3), "r").count() == 3


@needs_data
def test_mart_is_partitioned_and_pruned(spark):
    w = Warehouse(spark, SF)
    path = new_scratch(spark, "mart")
    sinks.write_mart(w.cohort_retention, path, "cohort_month")
    back = sinks.read_mart(spark, path, w.cohort_retention)
    assert back.schema["cohort_month"].dataType.simpleString() == "date"
    assert sorted(map(str, back.collect())) == sorted(map(str, w.cohort_retention.collect()))
    plan = back.where("cohort_month = date'1995-03-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cohort_month" in plan


@needs_data
def test_exports_write_four_reports(spark):
    w = Warehouse(spark, SF)
    paths = exports.write_exports(w.marts, new_scratch(spark, "exports"))
    assert len(paths) == 4
    for p in paths.values():
        assert spark.read.option("header", True).csv(p).count() > 0


@needs_data
def test_views_and_missing_tables(spark):
    w = Warehouse(spark, SF)
    w.register_views()
    missing = {r.table_name for r in inventory.missing_tables(spark).collect()}
    assert missing == {"raw_users", "raw_events", "raw_subscriptions", "raw_payments"}
    out = {r.table_name: r for r in inventory.inventory({"stg_users": w.users}, ("stg_users", "nope")).collect()}
    assert out["nope"].missing and not out["stg_users"].missing and out["stg_users"].rows == 150


def test_rule_set_size():
    tests = [r.test for r in quality.RULES]
    assert (tests.count("not_null"), tests.count("unique"), tests.count("accepted_values"), len(tests)) == (28, 5, 5, 40)


def test_rule_statuses(spark):
    df = spark.createDataFrame([("a", "pro"), ("a", "gold"), (None, None)], "id string, plan string")
    rules = [
        quality.Rule("not_null", "t", "id"),
        quality.Rule("not_null", "t", "id", threshold=1),
        quality.Rule("unique", "t", "id"),
        quality.Rule("accepted_values", "t", "plan", ("pro",), quality.WARN),
        quality.Rule("accepted_values", "t", "plan", ("pro", "gold"), quality.WARN),
    ]
    got = [(r.test, r.failures, r.status) for r in quality.run_rules({"t": df}, rules).collect()]
    assert sorted(got) == sorted(
        [
            ("not_null", 1, "fail"),
            ("not_null", 1, "pass"),
            ("unique", 1, "fail"),
            ("accepted_values", 1, "warn"),
            ("accepted_values", 0, "pass"),
        ]
    )


def test_catalog_diff_tells_each_kind_of_difference(spark):
    database = f"t{uuid.uuid4().hex}"
    frames = {
        "a": spark.createDataFrame([(1, None), (2, "x")], "id bigint, `odd name` string"),
        "b": spark.createDataFrame([], "id int"),
        "extra": spark.createDataFrame([(1,)], "v int"),
    }
    declared = {"a": "id bigint, lost date", "b": "id bigint, price decimal(10,2)", "gone": "id bigint"}
    sinks.save_tables(spark, database, frames)
    got = {(r.table_name, r.column_name): (r.declared_type, r.saved_type, r.state, r.rows, r.filled) for r in inventory.catalog_diff(spark, database, declared).collect()}
    assert got == {
        ("a", "id"): ("bigint", "bigint", "ok", 2, 2), ("a", "odd name"): (None, "string", "undeclared", 2, 1), ("a", "lost"): ("date", None, "missing", None, None),
        ("b", "id"): ("bigint", "int", "type", 0, 0), ("b", "price"): ("decimal(10,2)", None, "missing", None, None),
        ("gone", "id"): ("bigint", None, "missing", None, None), ("extra", "v"): (None, "int", "undeclared", 1, 1),
    }
    spark.sql(f"drop database {database} cascade")
    spark.sql(f"create database {database}")
    assert {r.state for r in inventory.catalog_diff(spark, database, declared).collect()} == {"missing"}


@needs_data
def test_declared_models_are_those_that_are_built(spark):
    w = Warehouse(spark, SF)
    for name, df in {**w.staging_views, **w.marts}.items():
        assert schemas.columns(schemas.MODELS[name]) == [(f.name, f.dataType.simpleString()) for f in df.schema]
