"""Clock arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-less timestamp."""
    second = (F.extract(F.lit("SECOND"), ts) * SECOND).cast("bigint")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return F.unix_date(F.to_date(ts)).cast("bigint") * (86_400 * SECOND) + minutes.cast("bigint") * (60 * SECOND) + second


def from_micros(us: Column) -> Column:
    days = F.floor(us / F.lit(86_400 * SECOND)).cast("int")
    rest = us - days.cast("bigint") * (86_400 * SECOND)
    seconds = (rest.cast("decimal(20,0)") / SECOND).cast("decimal(18,6)")
    return F.date_from_unix_date(days).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
