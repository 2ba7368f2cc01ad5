import datetime as dt
import os

import pytest

from meterstone.plans import monthly, stored
from meterstone.plans.warehouse import Warehouse
from meterstone.session import new_scratch
from meterstone.sources import adapters

T0 = dt.datetime(2024, 1, 1)
JAN, FEB, MAR = (dt.date(2024, m, 1) for m in (1, 2, 3))


def events(first, months, n=40):
    """Events of users 1 to 5, spread over some months of 2024."""
    rows = []
    for k in range(n):
        ts = dt.datetime(2024, months[k % len(months)], 1 + k % 25, k % 24)
        rows.append((first + k, ts, 1 + k % 5, ("view", "click", "error")[k % 3], 1.0, "{}"))
    return rows


@pytest.fixture()
def tables(spark):
    """A data folder with few users and one order each, in 2023."""
    folder = new_scratch(spark, "small")
    customers = [(k, f"Customer#{k}", 0, 1000.0, "BUILDING") for k in range(1, 6)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    orders = [(k, k, "F", 10.0, dt.datetime(2023, 5, k), "1-URGENT") for k in range(1, 6)]
    spark.createDataFrame(orders, adapters.TABLES["orders"]).write.parquet(f"{folder}/orders.parquet")
    return folder


def append(spark, folder, rows):
    spark.createDataFrame(rows, adapters.TABLES["events"]).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def month_files(layer, name):
    """Data files of each month folder."""
    top = f"{layer.root}/{name}".removeprefix("file:")
    return {d: sorted(f for f in os.listdir(f"{top}/{d}") if f.endswith(".parquet")) for d in os.listdir(top) if "=" in d}


def same_as_whole(spark, folder, layer):
    whole = Warehouse(spark, folder)
    for own, built in ((layer.events, whole.events), (layer.user_metrics, whole.user_metrics)):
        assert own.columns == built.columns and sorted(map(str, own.collect())) == sorted(map(str, built.collect()))


def test_a_changed_file_rebuilds_its_months_only(spark, tables):
    append(spark, tables, events(0, (1, 2)))
    append(spark, tables, events(100, (3,)))
    layer = monthly.MonthlyUserMetrics(Warehouse(spark, tables), f"{tables}/events.parquet")
    assert layer.refresh() == [dt.date(2023, 5, 1), JAN, FEB, MAR] and layer.refresh() == []
    same_as_whole(spark, tables, layer)
    before = {n: month_files(layer, n) for n in ("stg_events", "mart_user_metrics")}
    append(spark, tables, events(200, (2,)))
    assert layer.refresh() == [FEB]
    same_as_whole(spark, tables, layer)
    for name, files in before.items():
        now = month_files(layer, name)
        assert {d for d in now if now[d] != files.get(d)} == {"event_month=2024-02-01"}
    # A file that goes takes its rows along; a month without any has no folder left.
    gone = next(f for f, months in layer._recorded().items() if months == [MAR])
    os.remove(gone[0].removeprefix("file:"))
    assert layer.refresh() == [MAR]
    same_as_whole(spark, tables, layer)
    assert "event_month=2024-03-01" not in month_files(layer, "stg_events")


def test_months_are_pruned_on_read(spark, tables):
    append(spark, tables, events(0, (1, 2, 3)))
    layer = monthly.MonthlyUserMetrics(Warehouse(spark, tables), f"{tables}/events.parquet")
    layer.refresh()
    one = layer.user_metrics.where("event_month = date'2024-02-01'")
    assert "PartitionFilters: [isnotnull(event_month" in one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) and one.select("event_month").distinct().collect()[0].event_month == FEB


def test_events_without_a_date_have_a_month_of_their_own(spark, tables):
    append(spark, tables, events(0, (1,)))
    layer = monthly.MonthlyUserMetrics(Warehouse(spark, tables), f"{tables}/events.parquet")
    layer.refresh()
    append(spark, tables, [(500, None, 1, "view", 1.0, "{}")])
    assert layer.refresh() == [None]
    same_as_whole(spark, tables, layer)


def test_an_interrupted_refresh_is_repeated(spark, tables, monkeypatch):
    append(spark, tables, events(0, (1,)))
    layer = monthly.MonthlyUserMetrics(Warehouse(spark, tables), f"{tables}/events.parquet")
    layer.refresh()
    append(spark, tables, events(100, (1, 2)))
    monkeypatch.setattr(monthly, "user_metrics", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        layer.refresh()
    monkeypatch.undo()
    assert layer.refresh() == [JAN, FEB]
    same_as_whole(spark, tables, layer)


def test_changed_rules_or_users_begin_anew(spark, tables, monkeypatch):
    append(spark, tables, events(0, (1,)))
    path = f"{tables}/events.parquet"
    first = monthly.MonthlyUserMetrics(Warehouse(spark, tables), path)
    assert monthly.MonthlyUserMetrics(Warehouse(spark, tables), path).root == first.root
    monkeypatch.setattr(monthly, "rules_stamp", lambda: "other")
    assert monthly.MonthlyUserMetrics(Warehouse(spark, tables), path).root != first.root
    monkeypatch.undo()
    spark.createDataFrame([(9, 9, "F", 1.0, T0, "1")], adapters.TABLES["orders"]).write.mode("append").parquet(f"{tables}/orders.parquet")
    assert monthly.MonthlyUserMetrics(Warehouse(spark, tables), path).root != first.root
    assert len(stored.rules_stamp()) == 24
