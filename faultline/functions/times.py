"""Time buckets, lookbacks and elapsed seconds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucket:
    """A report bucket: rows group on ``grain`` and are labelled with ``pattern``."""

    grain: str
    pattern: str

    def start(self, ts: Column) -> Column:
        """Start of the day or hour; cheap to group on, formatted only after grouping."""
        if self.grain == "day":
            return ts.cast("date").cast("timestamp_ntz")
        return hour_start(ts)

    def label(self, ts: Column) -> Column:
        """The pattern filled from the parts of the time, which no session zone can shift."""
        hour = F.hour(ts)
        parts = {"yyyy": (F.year(ts), 4), "yy": (F.year(ts) % 100, 2), "MM": (F.month(ts), 2),
                 "dd": (F.day(ts), 2), "HH": (hour, 2), "hh": ((hour + 11) % 12 + 1, 2)}
        pieces = re.findall("[A-Za-z]+|[^A-Za-z]+", self.pattern)
        return F.concat(*[F.lpad(parts[p][0].cast("string"), parts[p][1], "0") if p in parts
                          else F.lit(p) for p in pieces])

    def parse(self, label: Column) -> Column:
        return F.to_timestamp_ntz(label, F.lit(self.pattern))


# The bucket formats of the reports. HOUR12_US folds morning and evening together.
DAY_US = Bucket("day", "MM-dd-yyyy")
DAY_US_SHORT = Bucket("day", "MM-dd-yy")
DAY_ISO = Bucket("day", "yyyy-MM-dd")
HOUR_ISO = Bucket("hour", "yyyy-MM-dd-HH")
HOUR_US = Bucket("hour", "MM-dd-yyyy-HH")
HOUR12_US = Bucket("hour", "MM-dd-yyyy-hh")


def instant(as_of) -> Column:
    """Reference time as a TIMESTAMP_NTZ literal; accepts a string, datetime or Column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


_UNITS = {"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def interval(count: int, unit: str) -> Column:
    return F.make_dt_interval(**{_UNITS[unit]: F.lit(count)})


def since(ts: Column, as_of, count: int, unit: str = "day") -> Column:
    """``as_of - count unit < ts <= as_of``: what "now" would see, also in a replay."""
    return (ts > instant(as_of) - interval(count, unit)) & (ts <= instant(as_of))


def within(df: DataFrame, as_of, lookback: tuple[int, str] | None) -> DataFrame:
    """Rows started inside the lookback. A stored table that carries its date partition is cut
    down to the days in question before any file is opened."""
    if lookback is None:
        return df
    inside = since(F.col("time_started"), as_of, *lookback)
    if "event_date" in df.columns:
        first = (instant(as_of) - interval(*lookback)).cast("date")
        inside = F.col("event_date").between(first, instant(as_of).cast("date")) & inside
    return df.filter(inside)


def until(df: DataFrame, as_of) -> DataFrame:
    """Rows started no later than the reference time; all rows without one."""
    if as_of is None:
        return df
    known = F.col("time_started") <= instant(as_of)
    if "event_date" in df.columns:
        known = (F.col("event_date") <= instant(as_of).cast("date")) & known
    return df.filter(known)


def hour_start(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def minute_start(ts: Column) -> Column:
    return hour_start(ts) + F.make_dt_interval(mins=F.minute(ts))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants, fractions kept."""
    return (micros(end) - micros(start)) / F.lit(1000000.0)


def micros(ts: Column) -> Column:
    """Microseconds of a time without zone, from its parts, so no session zone can shift it."""
    minutes = F.unix_date(ts.cast("date")) * F.lit(1440) + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts) * 1000000
    return minutes.cast("bigint") * 60000000 + seconds.cast("bigint")
