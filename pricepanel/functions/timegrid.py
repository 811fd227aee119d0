"""Column functions on naive local time (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ts: str | Column, minutes: int) -> Column:
    """Start of the ``minutes``-long bucket, counted from midnight."""
    if minutes <= 0 or 1440 % minutes:
        raise ValueError("minutes must divide a day")
    c = _col(ts)
    past = (F.hour(c) * 60 + F.minute(c)) % F.lit(minutes)
    return c - F.make_dt_interval(
        F.lit(0), F.lit(0), past, F.extract(F.lit("SECOND"), c)
    )


def delivery_to_ts(date: str | Column, hour: str | Column, quarter: str | Column) -> Column:
    """Interval start from delivery date, hour 1-24 and quarter 1-4.

    Malformed dates give null.
    """
    start = _col(date).try_cast("timestamp_ntz")
    return start + F.make_dt_interval(
        F.lit(0),
        _col(hour).cast("int") - 1,
        (_col(quarter).cast("int") - 1) * 15,
        F.lit(0).cast("decimal(18,6)"),
    )


def delivery_columns(ts: str | Column) -> list[Column]:
    """Delivery date, hour (1-24) and quarter (1-4) of an interval start."""
    c = _col(ts)
    return [
        F.to_date(c).alias("delivery_date"),
        (F.hour(c) + 1).alias("delivery_hour"),
        (F.floor(F.minute(c) / 15) + 1).cast("int").alias("delivery_interval"),
    ]


def calendar(ts: str | Column) -> list[Column]:
    """Hour, quarter of the hour, weekday (Monday 0) and month from 0."""
    c = _col(ts)
    return [
        F.hour(c).alias("hr"),
        F.floor(F.minute(c) / 15).cast("int").alias("qtr"),
        F.weekday(c).alias("dow"),
        (F.month(c) - 1).alias("mon"),
    ]


def minute_of_day(ts: str | Column) -> Column:
    c = _col(ts)
    return F.hour(c) * 60 + F.minute(c)


def plus_minutes(ts: str | Column, minutes: str | Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else _col(minutes)
    return _col(ts) + F.make_dt_interval(
        F.lit(0), F.lit(0), m.cast("int"), F.lit(0).cast("decimal(18,6)")
    )


_EPOCH = "1970-01-01 00:00:00"


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Exact seconds between two naive times, whatever the session time zone."""
    gap = _col(later) - _col(earlier)
    return gap.cast("interval second").cast("decimal(18,6)")


def to_instant(ts: str | Column) -> Column:
    """Naive time as the instant it would be in UTC (event time needs an instant)."""
    epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    return F.timestamp_micros((seconds_between(ts, epoch) * 1_000_000).cast("bigint"))


def from_instant(ts: str | Column) -> Column:
    """Inverse of :func:`to_instant`."""
    seconds = (F.unix_micros(_col(ts)) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
