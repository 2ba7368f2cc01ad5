import datetime as dt
from decimal import Decimal

from meterstone.operators import staging
from meterstone.sources.schemas import RAW_EVENTS, RAW_PAYMENTS, RAW_SUBSCRIPTIONS, RAW_USERS


def test_users_are_normalised_but_never_dropped(spark):
    raw = spark.createDataFrame(
        [
            ("U1", "  A@B.Com ", "2023-01-05", " PRO ", "SEO", " us ", None),
            (None, None, "2999-01-01", None, None, None, "51+"),
        ],
        RAW_USERS,
    )
    one, two = staging.stg_users(raw).collect()
    assert one == ("U1", "a@b.com", dt.date(2023, 1, 5), "pro", "organic", "US", "unknown")
    assert two == (None, None, dt.date(2999, 1, 1), "unknown", "unknown", None, "51+")


def test_event_flag_is_three_valued_and_week_starts_on_monday(spark):
    raw = spark.createDataFrame(
        [
            ("1", "U1", " Page_View", "2024-01-07 23:59:59.5", "S", None),
            ("2", "U1", "legacy_click", "2024-01-08", "S", None),
            ("3", "U1", None, "2024-01-08", "S", None),
        ],
        RAW_EVENTS,
    )
    rows = staging.stg_events(raw).orderBy("event_id").collect()
    assert [r.is_activity_event for r in rows] == [True, False, None]
    assert rows[0].event_week == dt.date(2024, 1, 1) and rows[1].event_week == dt.date(2024, 1, 8)
    assert rows[0].event_month == dt.date(2024, 1, 1)


def test_subscription_end_states(spark):
    raw = spark.createDataFrame(
        [
            ("1", "U", "Pro", 120.0, "2023-01-01", "", " Annual"),
            ("2", "U", None, 10.0, "2023-01-01", None, "monthly"),
            ("3", "U", "gold", -1.0, "2023-01-01", "n/a", None),
            ("4", "U", "free", 0.0, "2023-01-01", "2023-02-01", "monthly"),
        ],
        RAW_SUBSCRIPTIONS,
    )
    rows = staging.stg_subscriptions(raw).orderBy("subscription_id").collect()
    assert [r.is_active for r in rows] == [True, True, False, False]
    assert [r.ended_at for r in rows] == [None, None, None, dt.date(2023, 2, 1)]
    assert [r.plan_tier for r in rows] == [2, -1, -1, 0]
    assert [r.monthly_recurring_revenue for r in rows] == [10.0, 10.0, -1.0, 0.0]
    assert [r.monthly_twelfths for r in rows] == [Decimal(120), Decimal(120), Decimal(-12), Decimal(0)]


def test_payment_flags(spark):
    raw = spark.createDataFrame(
        [
            ("1", "U", "S", -5.0, "USD", False, "2023-01-31", " Card"),
            ("2", "U", "S", -5.0, " usd", True, "2023-01-31", "Card"),
            ("3", "U", "S", -5.0, None, None, "2023-01-31", "Card"),
            ("4", "U", "S", 5.0, "EUR", True, "2023-01-31", "Card"),
        ],
        RAW_PAYMENTS,
    )
    rows = staging.stg_payments(raw).orderBy("payment_id").collect()
    assert [r.is_usd for r in rows] == [True, False, None, False]
    assert [r.currency for r in rows] == ["USD", "USD", None, "EUR"]
    assert [r.is_suspected_dirty for r in rows] == [True, False, None, False]
    assert [r.net_amount_usd for r in rows] == [Decimal(-5), Decimal(-5), Decimal(-5), Decimal(-5)]


def test_lineage_columns(spark):
    df = staging.with_lineage(spark.range(1), "raw_users")
    assert df.columns == ["id", "_loaded_at", "_source"] and df.first()._source == "raw_users"
