"""Recurrence rules of calendars (RRULE), expanded on the wall clock."""

from __future__ import annotations

import calendar
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Occurrences of one series at most, from the begin of what is asked for.
MOST = 2_000
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


@lru_cache(1024)
def zone_info(name: str | None) -> ZoneInfo | None:
    """The zone of an IANA id; null for UTC and for what is none."""
    try:
        return ZoneInfo(name) if name and name != "UTC" else None
    except (ValueError, OSError, KeyError):
        return None


def instant(wall: datetime, zone: ZoneInfo | None) -> datetime:
    """UTC of a wall time: the earlier of two, a skipped one moved by the skip."""
    if zone is None:
        return wall
    try:
        return wall.replace(tzinfo=zone).astimezone(timezone.utc).replace(tzinfo=None)
    except OverflowError:
        return wall


def wall_time(utc: datetime, zone: ZoneInfo | None) -> datetime:
    """The wall time of a UTC instant."""
    if zone is None:
        return utc
    try:
        return utc.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None, fold=0)
    except OverflowError:
        return utc


class Rule:
    """A parsed rule. Raises ValueError for what it can't read."""

    def __init__(self, text: str):
        parts = dict(p.split("=", 1) for p in text.strip().removeprefix("RRULE:").upper().split(";") if p)
        self.freq = parts.pop("FREQ", "")
        if self.freq not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY"):
            raise ValueError(f"FREQ={self.freq} is not supported")
        self.interval = int(parts.pop("INTERVAL", "1"))
        self.count = int(parts.pop("COUNT")) if "COUNT" in parts else None
        self.until = parts.pop("UNTIL", None)
        self.week_start = DAYS.index(parts.pop("WKST", "MO"))
        numbers = lambda k: [int(x) for x in parts.pop(k).split(",")] if k in parts else []
        self.months, self.month_days, self.positions = numbers("BYMONTH"), numbers("BYMONTHDAY"), numbers("BYSETPOS")
        self.days = [(int(d[:-2] or 0), DAYS.index(d[-2:])) for d in parts.pop("BYDAY").split(",")] if "BYDAY" in parts else []
        if parts or self.interval < 1:
            raise ValueError(f"{', '.join(parts) or 'INTERVAL'} is not supported")

    def _days_of_month(self, y: int, m: int, start: datetime) -> list[date]:
        length = calendar.monthrange(y, m)[1]
        wanted = {d if d > 0 else length + 1 + d for d in self.month_days}
        out = []
        for n in range(1, length + 1):
            d = date(y, m, n)
            if self.month_days and n not in wanted:
                continue
            if self.days and not any(w == d.weekday() and (not k or k == (n - 1) // 7 + 1 or k == -((length - n) // 7 + 1)) for k, w in self.days):
                continue
            if not self.month_days and not self.days and n != start.day:
                continue
            out.append(d)
        return out

    def _skipped(self, day: date, to: date) -> int:
        """Periods from ``day`` on that surely end before ``to``."""
        periods = {"DAILY": (to - day).days, "WEEKLY": (to - day).days // 7, "MONTHLY": (to.year - day.year) * 12 + to.month - day.month, "YEARLY": to.year - day.year}
        return max(0, periods[self.freq] // self.interval - 1)

    def _sets(self, start: datetime, since: date | None = None) -> Iterator[list[date]]:
        """The dates of each period, in order; dates that don't exist are left out. Periods before ``since`` may be."""
        day = start.date()
        step = self._skipped(day, since) if since else 0
        while True:
            if self.freq == "DAILY":
                d = day + timedelta(days=step * self.interval)
                fits = (not self.months or d.month in self.months) and (not self.days or d.weekday() in {w for _, w in self.days})
                length = calendar.monthrange(d.year, d.month)[1]
                fits = fits and (not self.month_days or d.day in self.month_days or d.day - length - 1 in self.month_days)
                yield [d] if fits else []
            elif self.freq == "WEEKLY":
                first = day - timedelta(days=(day.weekday() - self.week_start) % 7) + timedelta(weeks=step * self.interval)
                wanted = {w for _, w in self.days} or {day.weekday()}
                week = [first + timedelta(days=k) for k in range(7)]
                yield [d for d in week if d.weekday() in wanted and (not self.months or d.month in self.months)]
            elif self.freq == "MONTHLY":
                at = day.year * 12 + day.month - 1 + step * self.interval
                y, m = divmod(at, 12)
                yield self._days_of_month(y, m + 1, start) if not self.months or m + 1 in self.months else []
            else:
                y = day.year + step * self.interval
                months = self.months or ([day.month] if not self.days or self.month_days else list(range(1, 13)))
                if self.days and not self.months and any(k for k, _ in self.days):
                    whole = [date(y, 1, 1) + timedelta(days=k) for k in range(366 if calendar.isleap(y) else 365)]
                    out = []
                    for k, w in self.days:
                        mine = [d for d in whole if d.weekday() == w]
                        out += mine if not k else [mine[k - 1 if k > 0 else k]] if abs(k) <= len(mine) else []
                    yield sorted(set(out))
                else:
                    yield [d for m in months for d in self._days_of_month(y, m, start)]
            step += 1

    def starts(self, start: datetime, until: datetime | None, before: datetime, most: int = MOST, since: datetime | None = None, utc: Callable[[datetime], datetime] = lambda t: t) -> Iterator[datetime]:
        """Occurrences from ``start`` on, on the wall clock, up to ``until`` and before ``before``; ``utc`` makes them what these and ``since`` are.

        With ``since`` those at or after it, ``most`` of them; COUNT counts from ``start`` all the same.
        """
        given, counted, empty = 0, 0, 0
        try:
            for dates in self._sets(start, since.date() - timedelta(days=2) if since and since.year > 1 and self.count is None else None):
                if self.positions and dates:
                    dates = sorted({dates[p - 1 if p > 0 else p] for p in self.positions if abs(p) <= len(dates)})
                empty = 0 if dates else empty + 1
                for d in dates:
                    at = datetime.combine(d, start.time())
                    if at < start:
                        continue
                    now = utc(at)
                    if (until is not None and now > until) or now >= before or given >= most or (self.count is not None and counted >= self.count):
                        return
                    counted += 1
                    if since is None or now >= since:
                        given += 1
                        yield at
                if empty > 4000:
                    return
        except (OverflowError, ValueError):
            return
