"""Times and windows that a caller asks for."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

#: Years a time may name, and the longest window.
YEARS, LONGEST = range(1900, 2201), timedelta(days=366)


def read_time(text: str, zone: str = "UTC") -> datetime:
    """An instant: RFC 3339, a local time in ``zone`` (the earlier of two, moved forward by a gap), or a date, its midnight there."""
    t = text.strip()
    if not re.fullmatch(r"\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?", t):
        raise ValueError(f"{text!r} is no time; write 2026-10-05T09:00:00-07:00, 2026-10-05T09:00 or 2026-10-05")
    at = datetime.fromisoformat(t.upper().replace("Z", "+00:00"))
    if at.year not in YEARS:
        raise ValueError(f"{text!r} is outside the years {YEARS[0]} to {YEARS[-1]}")
    if at.tzinfo is None:
        at = at.replace(tzinfo=ZoneInfo(zone))
    return at.astimezone(timezone.utc)


def listing_window(start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """Seven days from the start, which is now unless given."""
    start = start or now
    return _sound(start, end or start + timedelta(days=7))


def search_window(start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """90 days back and 275 ahead; one bound alone covers 365 days on its side."""
    year = timedelta(days=365)
    if start is None and end is None:
        start, end = now - timedelta(days=90), now + timedelta(days=275)
    return _sound(start or end - year, end or start + year)


def _sound(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    if not timedelta(0) < end - start <= LONGEST:
        raise ValueError(f"a window ends after it starts and covers at most {LONGEST.days} days")
    return start, end
