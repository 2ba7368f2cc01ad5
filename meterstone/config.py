"""Parameters shared by staging, marts, tests and log jobs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# The governed definition of an "active" event.
ACTIVITY_EVENT_TYPES = ("page_view", "feature_used", "api_call", "export")

# Accepted vocabularies used by the data tests.
PLANS = ("free", "starter", "pro", "enterprise", "unknown")
CHANNELS = ("organic", "paid_search", "referral", "direct", "email", "unknown")
EVENT_TYPES = ("page_view", "feature_used", "api_call", "export", "login", "settings_change")

# Acquisition cost in USD per new customer, by channel.
CHANNEL_COST = {"paid_search": 85, "referral": 25, "email": 15, "organic": 10}
OTHER_CHANNEL_COST = 30


@dataclass(frozen=True)
class Settings:
    activity_event_types: tuple[str, ...] = ACTIVITY_EVENT_TYPES
    ltv_margin: float = 0.70
    currency: str = "USD"
    # "Today" is a parameter so that results do not depend on the wall clock.
    as_of: dt.date = dt.date(2025, 1, 1)
    # Funnel windows in days after signup, both ends included.
    activation_days: tuple[int, int] = (0, 7)
    retained_days: tuple[int, int] = (28, 35)


DEFAULTS = Settings()
