"""Record times and time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
#: Numbers beyond this are milliseconds.
MILLIS = 1e12


def parse_time(text: Column) -> Column:
    """ISO-8601 (UTC if it names no zone), or seconds or milliseconds since the epoch, as a timestamp."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > MILLIS, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(text))


def record_time(*candidates: Column, now: Column | None = None) -> Column:
    """The first candidate that parses, else now."""
    return F.coalesce(*[parse_time(c) for c in candidates], now if now is not None else F.current_timestamp())


def iso_millis(text: Column) -> Column:
    """Milliseconds since the epoch of an ISO-8601 text, 0 if it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1000.0, F.lit(0.0))


def bucket(time: Column, granularity: str = "day") -> Column:
    return F.date_format(F.date_trunc(granularity, time), FORMATS[granularity])


def buckets_between(start: Column, end: Column, granularity: str = "day") -> Column:
    """All bucket names from start to end; one bound alone gives its own bucket."""
    first, last = (F.date_trunc(granularity, F.coalesce(*x)) for x in ((start, end), (end, start)))
    steps = F.sequence(first, last, F.expr(f"interval 1 {granularity}"))
    return F.transform(steps, lambda t: F.date_format(t, FORMATS[granularity]))


def age_days(bucket_name: Column, now: Column, granularity: str = "day") -> Column:
    """Days from a bucket's start to now; infinite for a name that is no bucket."""
    start = F.try_to_timestamp(bucket_name, F.lit(FORMATS[granularity]))
    return F.coalesce((F.unix_micros(now) - F.unix_micros(start)) / 86_400e6, F.lit(float("inf")))
