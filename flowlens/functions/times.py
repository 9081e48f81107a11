"""Column functions on timestamps. The session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 text with ``Z``, an offset or no zone to timestamp; junk becomes NULL."""
    iso = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.trim(text).try_cast("timestamp"))


def epoch_bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def floor_window(ts: Column, minutes: int) -> Column:
    """Floor to the hour's ``minutes`` grid; for divisors of 60 this is the epoch grid."""
    hour = F.date_trunc("hour", ts)
    step = F.minute(ts) - F.minute(ts) % minutes
    return hour + F.make_dt_interval(mins=step)


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def recent(ts: Column, now: Column, minutes: int) -> Column:
    """Rows not older than ``minutes`` before ``now``; ``now`` is given so that reruns agree."""
    return ts >= now - F.make_dt_interval(mins=F.lit(minutes))


def iso_utc(ts: Column) -> Column:
    """ISO text with numeric offset, as used in campaign keys."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
