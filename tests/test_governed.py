import datetime as dt
import os

import pytest

from meterstone.operators import governed
from meterstone.plans.warehouse import Warehouse

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize(
    ("name", "kwargs"),
    [
        ("net_promoter_score", {}),
        ("daily_active_users", {"dims": ["email"]}),
        ("daily_active_users", {"dims": ["*"]}),
        ("daily_active_users", {"dims": ["company_size"]}),
        ("churn_rate", {"dims": ["acquisition_channel"]}),
        ("monthly_active_users", {"grain": "day"}),
        ("daily_active_users", {"where": [("phone", "=", "1")]}),
        ("daily_active_users", {"where": [("user_id", "=", "U1")]}),
        ("daily_active_users", {"where": [("plan", "like", "p%")]}),
        ("daily_active_users", {"order_by": "user_id"}),
    ],
)
def test_requests_outside_the_layer_are_refused(spark, name, kwargs):
    with pytest.raises(governed.GovernanceError):
        governed.query_metric(Warehouse(spark, SF), name, **kwargs)


@needs_data
def test_limit_order_and_filter(spark):
    df = governed.query_metric(
        Warehouse(spark, SF),
        "daily_active_users",
        ["plan"],
        where=[("metric_date", "<", dt.date(2000, 1, 1)), ("plan", "in", ("pro", "free"))],
        limit=7,
    )
    rows = df.collect()
    assert len(rows) == 7 and df.columns == ["metric_date", "plan", "daily_active_users"]
    assert [r.metric_date for r in rows] == sorted((r.metric_date for r in rows), reverse=True)
    assert {r.plan for r in rows} <= {"pro", "free"} and rows[0].metric_date < dt.date(2000, 1, 1)


@needs_data
def test_top_k_is_not_a_full_sort(spark):
    df = governed.query_metric(Warehouse(spark, SF), "churn_rate", ["plan"], order_by="churn_rate_pct", limit=3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_scan_reads_only_what_a_query_needs(spark):
    w = Warehouse(spark, SF)
    plan = w.payments.groupBy("payment_month").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
    assert "Join" not in plan  # the owner of a payment is not looked up where it is not read
