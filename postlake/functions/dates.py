"""Date bounds, and conversions from the stored forms of dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(year: int, month: int | None, day: int | None) -> tuple[dt.datetime, dt.datetime | None]:
    """Start of a year, month or day, and of the next one (None past the year 9999)."""
    start = dt.datetime(year, month or 1, day or 1)
    try:
        if day:
            return start, start + dt.timedelta(days=1)
        if month:
            return start, dt.datetime(year + month // 12, month % 12 + 1, 1)
        return start, dt.datetime(year + 1, 1, 1)
    except (ValueError, OverflowError):
        return start, None


def listing_bound(text: str | None, end: bool = False) -> dt.datetime | None:
    """`2019`, `2019-03`, `2019/3/15`: first instant, or the last microsecond with end; anything else is None.

    The bound is in the session's time zone, which is the zone the listing shows.
    """
    m = re.fullmatch(r"\s*(\d{4})(?:[-/. ](\d{1,2})(?:[-/. ](\d{1,2}))?)?\s*", text or "")
    if not m:
        return None
    try:
        start, after = period(int(m[1]), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None)
        if m[2] and int(m[2]) == 0 or m[3] and int(m[3]) == 0:
            return None
    except ValueError:
        return None
    if not end:
        return start
    return after - dt.timedelta(microseconds=1) if after else dt.datetime.max


def search_bound(text: str, end: bool) -> dt.datetime | None:
    """`2019`, `2019-03`, `2019-03-15` in UTC: the start of the unit, or with end that of the next one."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text.strip())
    if not m:
        return None
    try:
        start, after = period(int(m[1]), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None)
    except ValueError:
        return None
    return after if end else start


def timestamp(d: dt.datetime) -> Column:
    """A literal that takes the type of the date column it is compared with, so that the filter reaches the scan."""
    return F.lit(d.isoformat(sep=" "))


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 to a timestamp; zero and less have no date."""
    return F.when(ticks > 0, F.timestamp_micros(F.floor((ticks - 116444736000000000) / 10)))


def ole_date(days: Column) -> Column:
    """Days since 1899-12-30."""
    return F.timestamp_micros(F.floor((days - 25569) * 86_400_000_000).cast("long"))


def birthday(ts: Column) -> Column:
    """The intended day of a local midnight that was stored in UTC: the nearest one."""
    return F.to_date(ts + F.expr("INTERVAL 12 HOURS"))
