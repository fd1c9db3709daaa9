"""Time helpers on wall-clock timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp without zone, fraction dropped."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minutes_since(last_ts: Column, now: Column) -> Column:
    """Whole minutes from ``last_ts`` to ``now``; NULL before the first move."""
    seconds = whole_seconds(now) - whole_seconds(last_ts)
    return (seconds / F.lit(60)).cast("long")


def minute_component(last_ts: Column, now: Column) -> Column:
    """Only the minute field of the elapsed interval: 2 h 05 min gives 5."""
    return F.extract(F.lit("MINUTE"), now - last_ts).cast("long")
