"""Lazy frames of one data folder: raw tables, staging views and marts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from meterstone.config import DEFAULTS, Settings
from meterstone.operators import staging
from meterstone.plans import funnel, retention, revenue, user_metrics
from meterstone.session import through_table
from meterstone.sources import adapters, query_log


class Warehouse:
    """Nothing is computed until a frame is used; each frame is built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULTS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.settings = settings

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return getattr(adapters, name)(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return staging.stg_users(self.raw("raw_users"))

    @cached_property
    def events(self) -> DataFrame:
        return staging.stg_events(self.raw("raw_events"), self.settings)

    @cached_property
    def subscriptions(self) -> DataFrame:
        return staging.stg_subscriptions(self.raw("raw_subscriptions"))

    @cached_property
    def payments(self) -> DataFrame:
        return staging.stg_payments(self.raw("raw_payments"), self.settings)

    @property
    def staging_views(self) -> dict[str, DataFrame]:
        return {
            "stg_users": self.users,
            "stg_events": self.events,
            "stg_subscriptions": self.subscriptions,
            "stg_payments": self.payments,
        }

    def register_views(self, session: SparkSession | None = None, leave_out: tuple[str, ...] = ()) -> None:
        """Expose staging and marts as temp views: lazy and always fresh. Views belong to one session."""
        own = self if session is None else type(self)(session, self.sf_dir, self.settings)
        for name, df in {**own.staging_views, **own.marts}.items():
            if name not in leave_out:
                df.createOrReplaceTempView(name)

    @cached_property
    def user_metrics(self) -> DataFrame:
        return user_metrics.user_metrics(self.users, self.events)

    @cached_property
    def cohort_retention(self) -> DataFrame:
        return retention.cohort_retention(self.users, self.events)

    @cached_property
    def payment_months(self) -> DataFrame:
        """Written, since the calendar and the revenue mart both read it: payments are scanned once."""
        return through_table(revenue.payments_by_month(self.payments), "payment_months")

    @cached_property
    def calendar(self) -> revenue.Calendar:
        return revenue.Calendar.of(self.payment_months)

    @cached_property
    def plan_steps(self) -> DataFrame:
        return revenue.plan_steps(self.users, self.subscriptions, self.calendar)

    @cached_property
    def revenue_metrics(self) -> DataFrame:
        # Revenue and churn both read the steps.
        steps = through_table(self.plan_steps, "plan_steps")
        return revenue.revenue_metrics(self.users, self.subscriptions, self.payments, self.calendar, self.settings, self.payment_months, steps)

    @cached_property
    def funnel_analysis(self) -> DataFrame:
        return funnel.funnel_analysis(self.users, self.events, self.payments, self.settings)

    @property
    def marts(self) -> dict[str, DataFrame]:
        return {
            "mart_user_metrics": self.user_metrics,
            "mart_cohort_retention": self.cohort_retention,
            "mart_revenue_metrics": self.revenue_metrics,
            "mart_funnel_analysis": self.funnel_analysis,
        }

    @cached_property
    def query_log(self) -> DataFrame:
        return query_log.query_log(self.spark, self.sf_dir)
