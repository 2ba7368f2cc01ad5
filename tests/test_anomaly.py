import datetime as dt
import math
import random
import statistics

from meterstone.operators import anomaly

SCHEMA = "metric string, ds date, y double"
START = dt.date(2024, 1, 1)


def series(spark, values, metric="m"):
    return spark.createDataFrame([(metric, START + dt.timedelta(i), float(y)) for i, y in enumerate(values)], SCHEMA)


def test_short_series_never_flags(spark):
    assert anomaly.sigma(series(spark, [1.0] * 12 + [1000.0])).count() == 0
    assert anomaly.sigma(series(spark, [1.0, 2.0] * 10 + [1000.0])).count() == 1


def test_flat_series_has_no_score(spark):
    assert anomaly.sigma(series(spark, [5.0] * 40)).count() == 0


def test_sigma_equals_brute_force(spark):
    rng = random.Random(3)
    values = [rng.gauss(100, 5) + (80 if i % 37 == 20 else 0) for i in range(120)]
    expected = []
    for i, y in enumerate(values):
        window = values[max(0, i - 29) : i + 1]
        if len(window) >= 7:
            z = (y - statistics.fmean(window)) / statistics.stdev(window)
            if abs(z) > 3:
                expected.append((START + dt.timedelta(i), math.floor(z * 100 + 0.5) / 100))
    got = anomaly.sigma(series(spark, values)).orderBy("ds").collect()
    assert [(r.ds, r.z_score) for r in got] == expected and expected
    assert {r.direction for r in got} == {"spike"} and {r.method for r in got} == {"3sigma"}


def test_seasonal_band_learns_weekdays(spark):
    values = [100 + 2 * i + (50 if (START + dt.timedelta(i)).weekday() == 6 else 0) for i in range(70)]
    values[40] += 400
    got = anomaly.seasonal(series(spark, values)).collect()
    assert [r.ds for r in got] == [START + dt.timedelta(40)] and got[0].direction == "spike"
    assert got[0].expected_lower < got[0].expected_value < got[0].expected_upper


def test_seasonal_alert_wins_and_ids_are_stable(spark):
    values = [100.0 + i % 3 for i in range(60)]
    values[50] = 500.0
    data = series(spark, values)
    alerts = anomaly.detect(data).collect()
    assert [(r.ds, r.method) for r in alerts] == [(START + dt.timedelta(50), "seasonal")]
    detected = data.selectExpr("timestamp_ntz'2024-06-01 00:00:00' as t").first().t
    from pyspark.sql import functions as F

    feed = anomaly.feed_records(anomaly.detect(data), F.lit(detected).cast("timestamp_ntz"))
    again = anomaly.feed_records(anomaly.detect(data), F.lit(detected).cast("timestamp_ntz"))
    assert feed.first() == again.first()
    row = feed.first()
    assert row.human_review_required and not row.commentary_approved
    assert row.commentary.startswith("Auto-flagged: +") and row.commentary.endswith("on 2024-02-20")
    approved = anomaly.apply_approvals(feed, feed.select("id").union(feed.select("id")))
    assert [r.commentary_approved for r in approved.collect()] == [True]
    assert anomaly.latest(feed, 5).count() == 1


def test_a_yearly_peak_is_expected_and_another_one_is_not(spark):
    days = [dt.date(2019 + m // 12, m % 12 + 1, 1) for m in range(60)]
    values = [100.0 + (50 if d.month == 12 else 0) + (40 if d == dt.date(2022, 6, 1) else 0) for d in days]
    rows = spark.createDataFrame([("monthly", d, v) for d, v in zip(days, values)], SCHEMA)
    flagged = {r.ds for r in anomaly.seasonal(rows).collect()}
    assert dt.date(2022, 6, 1) in flagged and not any(d.month == 12 for d in flagged)


def test_a_slope_that_changes_midway_is_not_flagged(spark):
    rng = random.Random(8)
    bent = [100 + 3 * i if i < 60 else 280 - 2 * (i - 60) for i in range(121)]
    values = [y + rng.uniform(-1, 1) for y in bent]
    values[30] += 60
    got = anomaly.seasonal(series(spark, values), z=3.5)
    assert [r.ds for r in got.collect()] == [START + dt.timedelta(30)]
    # One straight line is far off at the bend.
    straight = anomaly.seasonal(series(spark, values), bends=1, z=1.5)
    assert START + dt.timedelta(60) in {r.ds for r in straight.collect()}


def test_the_bending_line_is_the_least_squares_one(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    days = np.sort(rng.choice(400, 90, replace=False))
    y = rng.normal(size=90) * 5 + days
    rows = [("m", START + dt.timedelta(int(d)), float(v)) for d, v in zip(days, y, strict=True)]
    got = {r.ds: r.trend for r in anomaly._trend(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    place = (days - days[0]) / (days[-1] - days[0]) * 4
    hats = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(5)))
    want = hats @ np.linalg.lstsq(hats, y, rcond=None)[0]
    assert np.allclose([got[r[1]] for r in rows], want, rtol=1e-8)


def test_lines_and_lone_points_give_no_flags(spark):
    for values in ([5.0] * 40, [3.0 * i for i in range(40)]):
        assert anomaly.seasonal(series(spark, values)).count() == 0
    far = [("m", START + dt.timedelta(i), 1.0 + i) for i in range(20)] + [("m", START + dt.timedelta(4000), 4001.0)]
    assert anomaly._trend(spark.createDataFrame(far, SCHEMA), 4).where("abs(trend - y) > 1e-3").count() == 0
    assert anomaly._trend(spark.createDataFrame([("m", START, 7.0)], SCHEMA), 4).first().trend == 7.0
