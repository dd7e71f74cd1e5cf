"""Time buckets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from timberline.functions.text import col


def naive(moment: datetime) -> Column:
    """A naive UTC time as literal, independent of the session zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a naive timestamp, independent of the session zone."""
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c))


def seconds_between(start: Column, end: Column) -> Column:
    """Exact difference in seconds as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def time_bucket(c: str | Column, minutes: int) -> Column:
    """Start of the bucket inside the hour; ``minutes`` must divide 60."""
    if 60 % minutes:
        raise ValueError("bucket minutes must divide 60")
    ts = col(c)
    offset = F.floor(F.minute(ts) / minutes) * minutes
    return F.timestamp_add("MINUTE", offset.cast("int"), F.date_trunc("hour", ts).cast("timestamp_ntz"))


def bucket_range(first: Column, last: Column, minutes: int) -> Column:
    """All bucket starts from first to last."""
    return F.sequence(first, last, F.expr(f"interval {minutes} minutes"))
