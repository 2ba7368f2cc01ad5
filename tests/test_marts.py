import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterstone.operators import staging
from meterstone.plans import funnel, retention, revenue, user_metrics
from meterstone.sources.schemas import RAW_EVENTS, RAW_PAYMENTS, RAW_SUBSCRIPTIONS, RAW_USERS

D = dt.date


def users(spark, *rows):
    full = [(u, f"{u}@x.io", s, p, c, n, None) for u, s, p, c, n in rows]
    return staging.stg_users(spark.createDataFrame(full, RAW_USERS))


def events(spark, *rows):
    full = [(str(i), u, k, t, "S", None) for i, (u, k, t) in enumerate(rows)]
    return staging.stg_events(spark.createDataFrame(full, RAW_EVENTS))


def subs(spark, *rows):
    full = [(str(i), u, p, m, s, e, b) for i, (u, p, m, s, e, b) in enumerate(rows)]
    return staging.stg_subscriptions(spark.createDataFrame(full, RAW_SUBSCRIPTIONS))


def payments(spark, *rows):
    full = [(str(i), u, "S", a, "USD", False, d, "card") for i, (u, a, d) in enumerate(rows)]
    return staging.stg_payments(spark.createDataFrame(full, RAW_PAYMENTS))


def test_daily_metrics_count_a_duplicated_user_once_per_slice(spark):
    u = users(spark, ("U1", "2024-01-01", "pro", "seo", "us"), ("U1", "2023-01-01", "pro", "seo", "us"))
    e = events(spark, ("U1", "page_view", "2024-01-05"), ("U1", "export", "2024-01-05"), ("U9", "export", "2024-01-05"))
    rows = {r.plan: r for r in user_metrics.user_metrics(u, e).collect()}
    assert rows["pro"].daily_active_users == 1 and rows["pro"].new_user_activations == 1
    assert rows["pro"].total_events == 4  # the fan-out of the left join stays visible
    assert rows[None].daily_active_users == 1 and rows[None].new_user_activations == 0


def test_activity_before_signup_counts_as_new(spark):
    u = users(spark, ("U1", "2024-02-01", "pro", "seo", "us"))
    e = events(spark, ("U1", "page_view", "2024-01-05"))
    assert user_metrics.user_metrics(u, e).first().new_user_activations == 1


def test_spine_has_quiet_days(spark):
    e = events(spark, ("U1", "page_view", "2024-01-01"), ("U1", "login", "2024-01-04"))
    rows = [tuple(r) for r in user_metrics.daily_active_spine(e).orderBy("metric_date").collect()]
    assert rows == [(D(2024, 1, 1), 1), (D(2024, 1, 2), 0), (D(2024, 1, 3), 0), (D(2024, 1, 4), 0)]


def test_rolling_active_equals_brute_force(spark):
    log = [("U%d" % (i * i % 5), "page_view", f"2024-01-{1 + (i * 7) % 29:02d}") for i in range(40)]
    e = events(spark, *log)
    for days in (1, 7, 30):
        got = {r[0]: r[1] for r in user_metrics.rolling_active(e, days).collect()}
        active = [(u, D.fromisoformat(t)) for u, _, t in log]
        for day, n in got.items():
            assert n == len({u for u, d in active if day - dt.timedelta(days - 1) <= d <= day})


def test_rolling_sketch_is_close_to_exact(spark):
    log = [("U%d" % (i % 300), "page_view", f"2024-01-{1 + (i * 7) % 29:02d}") for i in range(2000)]
    e = events(spark, *log)
    exact = {r[0]: r[1] for r in user_metrics.rolling_active(e, 7).collect()}
    rough = {r[0]: r[1] for r in user_metrics.rolling_active_sketch(e, 7).collect()}
    assert exact.keys() == rough.keys()
    assert all(abs(rough[d] - n) <= 0.05 * n + 1 for d, n in exact.items())


def test_retention_drops_slices_without_country(spark):
    u = users(spark, ("U1", "2024-01-10", "pro", "seo", "us"), ("U2", "2024-01-10", "pro", "seo", None))
    e = events(spark, ("U1", "export", "2024-03-01"), ("U1", "export", "2023-12-01"), ("U2", "export", "2024-02-01"))
    rows = retention.cohort_retention(u, e).collect()
    assert [(r.retention_period, r.cohort_size, r.retained_users, r.retention_rate_pct) for r in rows] == [(2, 1, 1, 100.0)]


def test_heatmap_columns(spark):
    u = users(spark, ("U1", "2024-01-10", "pro", "seo", "us"))
    e = events(spark, ("U1", "export", "2024-01-11"), ("U1", "export", "2024-03-01"))
    wide = retention.retention_heatmap(retention.cohort_retention(u, e))
    assert len(wide.columns) == 14
    row = wide.first()
    assert (row.period_0, row.period_1, row.period_2) == (1, None, 1)


@pytest.fixture(scope="module")
def calendar(spark):
    # February is missing on purpose: a month exists only if some payment fell into it.
    paid = payments(spark, ("U1", 1.0, "2024-01-15"), ("U1", 1.0, "2024-03-15"), ("U1", 1.0, "2024-04-15"))
    return revenue.Calendar.read(paid)


def months(df):
    return sorted(r.metric_month.month for r in df.collect())


def test_active_months_follow_calendar_start_and_end(spark, calendar):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    cases = {
        ("2024-01-01", ""): [1, 3, 4],
        ("2024-01-02", ""): [3, 4],  # a mid-month start counts from the next month
        ("2023-05-05", "2024-03-01"): [1],  # the end day itself is not active
        ("2023-05-05", "2024-03-02"): [1, 3],
        ("2024-03-01", "n/a"): [3, 4],
        ("2024-04-01", "2024-04-01"): [],
        ("2030-01-01", ""): [],
    }
    for (start, end), expected in cases.items():
        s = subs(spark, ("U1", "pro", 10.0, start, end, "monthly"))
        assert months(revenue.active_subs_monthly(u, s, calendar)) == expected, (start, end)


def test_non_positive_revenue_is_not_active(spark, calendar):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    s = subs(spark, ("U1", "pro", 0.0, "2023-01-01", "", "monthly"), ("U1", "pro", -3.0, "2023-01-01", "", "monthly"))
    assert revenue.active_subs_monthly(u, s, calendar).count() == 0


def churn_rows(df):
    return sorted((r.metric_month.month, r.user_id, r.plan) for r in df.collect())


def test_plan_change_is_churn_as_written_but_not_as_documented(spark, calendar):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"), ("U2", "2023-01-01", "pro", "seo", "us"))
    s = subs(
        spark,
        ("U1", "pro", 10.0, "2024-01-01", "2024-04-01", "monthly"),
        ("U1", "free", 5.0, "2024-04-01", "", "monthly"),
        ("U2", "pro", 10.0, "2024-01-01", "", "monthly"),
    )
    steps = revenue.plan_steps(u, s, calendar)
    assert (4, "U1", "pro") in churn_rows(revenue.churned_users(steps, calendar))
    documented = {r.metric_month.month: r for r in revenue.churn_start_of_month(s, calendar).collect()}
    assert documented[4].churned_customers == 0 and documented[4].customers_at_start == 2


def test_null_user_never_matches_in_churn(spark, calendar):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    s = subs(spark, (None, "pro", 10.0, "2024-03-01", "", "monthly"))
    steps = revenue.plan_steps(u, s, calendar)
    assert churn_rows(revenue.churned_users(steps, calendar)) == [(4, None, "pro"), (5, None, "pro")]
    assert {r.churned_customers for r in revenue.churned_monthly(steps, calendar).collect()} == {0}
    assert {r.paying_customers for r in revenue.mrr_monthly(steps, calendar).collect()} == {0}


def test_revenue_mart_values(spark):
    paid = payments(spark, ("U1", 1.0, "2024-01-15"), ("U1", 1.0, "2024-03-15"), ("U1", 1.0, "2024-04-15"))
    u = users(spark, ("U1", "2024-03-01", "pro", "seo", "us"), ("U2", "2024-03-01", "pro", "seo", "us"))
    s = subs(
        spark,
        ("U1", "pro", 120.0, "2024-03-01", "2024-04-01", " Annual"),
        ("U2", "pro", 30.0, "2024-03-01", "", "monthly"),
    )
    rows = {r.metric_month.month: r for r in revenue.revenue_metrics(u, s, paid).collect()}
    march, april = rows[3], rows[4]
    assert (march.paying_customers, march.mrr, march.arr, march.arpu) == (2, 40.0, 480.0, 20.0)
    assert march.estimated_ltv is None and march.estimated_cac == 10.0 and march.ltv_to_cac_ratio is None
    assert (april.paying_customers, april.churned_customers, april.churned_mrr, april.churn_rate_pct) == (1, 1, 10.0, 100.0)
    assert april.estimated_ltv == 21.0 and april.estimated_cac == 0.0 and april.ltv_to_cac_ratio is None
    assert april.net_revenue == 1.0


def test_hot_user_gives_bounded_groups(spark, calendar):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    s = subs(spark, *[("U1", "pro", 10.0, "2024-01-01", "", "monthly")] * 500)
    steps = revenue.plan_steps(u, s, calendar)
    assert sorted((r.at, r.held, float(r.twelfths)) for r in steps.collect()) == [(0, 500, 60000.0), (3, -500, -60000.0)]
    assert {(r.paying_customers, r.mrr, r.arpu) for r in revenue.mrr_monthly(steps, calendar).collect()} == {(1, 5000.0, 10.0)}


def test_funnel_windows_and_null_counts(spark):
    u = users(
        spark,
        ("U1", "2024-01-01", "pro", "seo", "us"),
        ("U2", "2024-01-01", "free", "seo", "us"),
    )
    e = events(spark, ("U1", "export", "2024-01-08"), ("U1", "export", "2024-02-05"), ("U2", "login", "2024-01-01"))
    p = payments(spark, ("U1", 5.0, "2024-01-09"), ("U2", -5.0, "2024-01-09"))
    rows = {r.plan: r for r in funnel.funnel_analysis(u, e, p).collect()}
    assert (rows["pro"].activations, rows["pro"].conversions, rows["pro"].day30_retained) == (1, 1, 1)
    assert (rows["free"].activations, rows["free"].conversions, rows["free"].activation_rate_pct) == (None, None, None)
    same_day = {r.plan: r for r in funnel.funnel_analysis(u, e, p, as_written=True).collect()}
    assert same_day["pro"].activations is None and same_day["pro"].paid_to_retained_rate_pct is None


def test_funnel_flags_every_row_of_a_duplicated_user(spark):
    u = users(spark, ("U1", "2024-01-01", "pro", "seo", "us"), ("U1", "2020-01-01", "free", "seo", "us"))
    e = events(spark, ("U1", "export", "2024-01-03"))
    p = payments(spark, ("U2", 5.0, "2024-01-09"))
    flags = funnel.user_funnel(u, e, p).select("plan", "reached_activation").collect()
    assert {tuple(r) for r in flags} == {("pro", True), ("free", True)}


def test_range_join_is_not_a_nested_loop(spark):
    paid = payments(spark, ("U1", 1.0, "2024-01-15"))
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    s = subs(spark, ("U1", "pro", 10.0, "2024-01-01", "", "monthly"))
    plan = revenue.revenue_metrics(u, s, paid)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_metric_mau_differs_from_sum_of_daily(spark):
    u = users(spark, ("U1", "2023-01-01", "pro", "seo", "us"))
    e = events(spark, ("U1", "export", "2024-01-03"), ("U1", "export", "2024-01-04"))
    assert user_metrics.active_users_by(u, e, "month").first().active_users == 1
    daily = user_metrics.user_metrics(u, e).agg(F.sum("daily_active_users")).first()[0]
    assert daily == 2


def test_copies_of_a_user_multiply_instead_of_fanning_out(spark, calendar):
    u = users(spark, *[("U1", "2024-01-01", "pro", "seo", "us")] * 3)
    e = events(spark, ("U1", "page_view", "2024-01-05"), ("U1", "export", "2024-01-05"))
    daily = user_metrics.user_metrics(u, e).collect()
    assert [(r.daily_active_users, r.total_events) for r in daily] == [(1, 6)]
    assert user_metrics.user_daily_activity(u, e).count() == 1
    s = subs(spark, ("U1", "pro", 10.0, "2024-01-01", "", "monthly"))
    steps = revenue.plan_steps(u, s, calendar)
    rows = revenue.mrr_monthly(steps, calendar).collect()
    assert {(r.paying_customers, r.mrr, r.arpu) for r in rows} == {(1, 30.0, 10.0)}
    assert revenue.active_subs_monthly(u, s, calendar).count() == 9
    assert retention.cohort_activity(u, e).count() == 1


def test_stored_layer_is_read_again_and_renewed_when_the_input_changes(spark, tmp_path):
    import shutil

    from meterstone.plans.stored import StoredWarehouse
    from meterstone.plans.warehouse import Warehouse
    from meterstone.sources.adapters import TABLES as NAMES

    for name in NAMES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    first = StoredWarehouse(spark, str(tmp_path))
    users = first.users.count()
    again = StoredWarehouse(spark, str(tmp_path))
    assert again.stamp == first.stamp and again.users.inputFiles() == first.users.inputFiles()
    spark.read.parquet(str(tmp_path / "customer.parquet")).limit(20).write.parquet(str(tmp_path / "few"))
    (tmp_path / "customer.parquet").unlink()
    (tmp_path / "few").rename(tmp_path / "customer.parquet")
    changed = StoredWarehouse(spark, str(tmp_path))
    assert changed.stamp != first.stamp and changed.users.count() < users
    lazy = Warehouse(spark, str(tmp_path))
    for name, df in changed.staging_views.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, lazy.staging_views[name].collect()))
