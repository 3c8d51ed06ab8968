"""Calendar events: series expanded, windows, term search, occurrence ids and pages."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import recurrence
from almanak.functions import zones as Z
from almanak.operators import intervals
from almanak.plans.paging import next_offset, page_size, read_window_token, window_token

#: Occurrences that a caller may expect of one query; beyond it ``expansion_summary`` says that it is not complete. None is dropped.
MOST_OCCURRENCES = 50_000
#: How far back a series may begin before the window, beside its length.
LOOK_BACK = timedelta(hours=3)


def overlaps(start: Column, end: Column, begin: Column, until: Column) -> Column:
    """Whether an event meets a window; one without length does if it begins inside."""
    return (start < until) & ((end > begin) | ((end == start) & (start >= begin)))


def matches_terms(fields: list[Column], wanted: list[str], unwanted: list[str]) -> Column:
    """Every wanted term in any field, no unwanted one in any; case aside. Null fields hold nothing."""
    if not wanted and not unwanted:
        raise ValueError("a search needs a term")
    holds = lambda term: _any([F.coalesce(F.contains(F.lower(f), F.lit(term.lower())), F.lit(False)) for f in fields])
    out = F.lit(True)
    for t in wanted:
        out = out & holds(t)
    for t in unwanted:
        out = out & ~holds(t)
    return out


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def terms(text: str) -> tuple[list[str], list[str]]:
    """Wanted and unwanted terms of a search text; quotes keep phrases together."""
    from almanak.plans.querylang import tokens

    bare = lambda t: t[1:-1] if len(t) > 1 and t[0] == t[-1] == '"' else t
    out: tuple[list[str], list[str]] = ([], [])
    for t in tokens(text):
        no = t.startswith("-") and len(t) > 1
        out[no].append(bare(t[1:] if no else t))
    return out


def expand(series: DataFrame, before: datetime, look_from: datetime | None = None) -> DataFrame:
    """``key``, ``start``: occurrences of series (``key``, ``start`` wall time, ``rrule``, ``rdates``, ``exdates``, ``length_s``, perhaps ``zone``).

    Rules run on the wall clock of ``zone``, an IANA id: the series' own, of
    floating ones the reader's; null or none is UTC. ``before`` and
    ``look_from`` are UTC, and instants are compared. ``rdates`` and
    ``exdates`` are wall times of the series, or structs ``kind``, ``wall``,
    ``tz`` as sent. Extra dates join, exceptions go, both without repeats; an
    unreadable rule gives the first start only. With ``look_from`` only what
    may reach it is kept, however long before it the series began.
    """
    zoned = "zone" in series.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, times = [], []
            zones = b.column("zone").to_pylist() if zoned else [None] * b.num_rows
            for key, start, rrule, rdates, exdates, length, name in zip(*(b.column(c).to_pylist() for c in names), zones):
                if start is None:
                    continue
                zone = recurrence.zone_info(name)
                utc = lambda t, z=zone: recurrence.instant(t, z)
                found = {utc(start): start}
                floor = None if look_from is None else look_from - timedelta(seconds=length or 0) - LOOK_BACK
                parsed = _rule(rrule) if rrule else None
                if parsed:
                    until = parsed[1] if parsed[1] is None or parsed[0].until.endswith("Z") else utc(parsed[1])
                    found = {utc(t): t for t in parsed[0].starts(start, until, before, since=floor, utc=utc)} or found
                extra = {_sent(t, zone) for t in rdates or () if t}
                found |= {t: recurrence.wall_time(t, zone) for t in extra if t not in found}
                for t in exdates or ():
                    found.pop(_sent(t, zone) if t else None, None)
                kept = sorted(w for t, w in found.items() if t < before and (floor is None or t >= floor))
                keys += [key] * len(kept)
                times += kept
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(times, pa.timestamp("us"))], ["key", "start"])

    names = ["key", "start", "rrule", "rdates", "exdates", "length_s"]
    session = series.sparkSession
    spread = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # rules cost more than their rows weigh
    return series.select(*names, *["zone"] * zoned).repartition(spread, "key").mapInArrow(run, "key bigint, start timestamp_ntz")


def _sent(value: datetime | dict, zone: ZoneInfo | None) -> datetime:
    """UTC of an extra date or exception: a wall time of the series, or a struct ``kind``, ``wall``, ``tz``."""
    if isinstance(value, datetime):
        return recurrence.instant(value, zone)
    if value["kind"] == "utc":
        return value["wall"]
    return recurrence.instant(value["wall"], (recurrence.zone_info(value["tz"]) or zone if value["tz"] != "UTC" else None) if value["kind"] == "zoned" else zone)


@lru_cache(1024)
def _rule(text: str) -> tuple[recurrence.Rule, datetime | None] | None:
    try:
        rule = recurrence.Rule(text)
        return rule, _until(rule.until)
    except (ValueError, IndexError):
        return None


def _until(text: str | None) -> datetime | None:
    if text is None:
        return None
    text = text.rstrip("Z")
    return datetime.strptime(text, "%Y%m%dT%H%M%S") if "T" in text else datetime.strptime(text, "%Y%m%d") + timedelta(days=1, microseconds=-1)


def with_overrides(occurrences: DataFrame, overrides: DataFrame) -> DataFrame:
    """Occurrences but those that an override (``key``, ``recurrence_start``, ``start``, ``status``) replaces, with the overrides; cancelled ones go."""
    o = overrides.select("key", F.col("recurrence_start").alias("original"), "start", "status")
    left = occurrences.withColumn("original", F.col("start")).join(o.select("key", "original"), ["key", "original"], "left_anti")
    moved = o.filter(F.coalesce(F.lower("status"), F.lit("")) != "cancelled").select("key", "original", "start")
    return left.select("key", "original", "start").unionByName(moved)


def occurrence_id(uid: Column, start: Column, fixed: Column, recurring: Column) -> Column:
    """``UID``, or ``UID|start`` of a series: in UTC with Z for a fixed instant, the wall time without for a floating one."""
    at = F.concat(F.date_format(start, "yyyyMMdd'T'HHmmss"), F.when(fixed, "Z").otherwise(""))
    return F.when(recurring, F.concat(uid, F.lit("|"), at)).otherwise(uid)


_SENT = "array<struct<kind: string, wall: timestamp_ntz, tz: string>>"


def expand_window(events: DataFrame, begin: datetime, until: datetime, zone: str = "UTC") -> DataFrame:
    """Every occurrence that meets the window [``begin``, ``until``) of UTC times, in no order.

    ``events`` holds ``feed``, ``event_no``, ``uid``, ``starts``, ``ends``,
    ``duration``, ``status`` and, for series, ``rrule``, ``rdates``, ``exdates``
    (as sent) and ``recurrence_id``; missing ones are null. Times without a zone
    are in ``zone``, the reader's. Gives ``feed``, ``event_no``, ``uid``, ``id``,
    ``start_us``, ``end_us``, ``whole_day``, ``recurring``.

    An event lasts until ``ends`` where that is later, else for its duration,
    else a date's one day, else not at all; whole days are counted on the wall
    clock. What overrides an occurrence replaces it, wherever it moved it to;
    cancelled events and occurrences are left out. Events without a start are
    left out.
    """
    kinds = {"rrule": "string", "rdates": _SENT, "exdates": _SENT, "recurrence_id": "struct<kind: string, wall: timestamp_ntz, tz: string>"}
    given = lambda c: (F.col(c) if c in events.columns else F.lit(None).cast(kinds[c])).alias(c)
    e = events.filter("starts.wall is not null").select("feed", "event_no", "uid", "starts", "ends", "duration", F.coalesce(F.lower(F.trim("status")) == "cancelled", F.lit(False)).alias("cancelled"), *map(given, kinds))
    e = e.withColumn("key", F.xxhash64("feed", "event_no"))
    own = lambda c: F.when(F.lower(F.col(f"{c}.kind")) == "utc", "UTC").otherwise(F.col(f"{c}.tz"))
    for c, into in (("starts", "_z"), ("ends", "_ez"), ("recurrence_id", "_rz")):
        e = Z.with_zone(e, own(c), into).withColumn(into, F.coalesce(into, F.lit(zone)))
    # in steps, each of a size that the compiler takes
    e = e.withColumn("_bw", Z.wall_us(F.col("starts.wall"))).withColumn("_uw", Z.wall_us(F.col("ends.wall")))
    days, seconds = intervals.duration_parts(F.col("duration"))
    day = F.lit(86_400_000_000)
    e = e.withColumn("_lasting", days * day + seconds * 1_000_000)
    lasting = F.col("_lasting")
    e = e.withColumn("whole_day", F.lower("starts.kind").eqNullSafe("date")).withColumn("_b", Z.local_to_utc_us(F.col("_bw"), F.col("_z"))).withColumn("_u", Z.local_to_utc_us(F.col("_uw"), F.col("_ez")))
    longer = F.col("_u") > F.col("_b")
    nominal = F.when(longer, F.col("_uw") - F.col("_bw")).otherwise(F.coalesce(lasting, day))
    e = e.withColumn("_size", F.when(F.col("whole_day"), nominal).when(longer, F.col("_u") - F.col("_b")).otherwise(F.coalesce(lasting, F.lit(0).cast("bigint"))))
    e = e.withColumn("recurring", F.col("rrule").isNotNull() | (F.coalesce(F.size("rdates"), F.lit(0)) > 0) | F.col("recurrence_id.wall").isNotNull())

    masters = e.filter("recurrence_id.wall is null and not cancelled")
    length = F.ceil(F.col("_size") / 1_000_000).cast("bigint")
    series = masters.select("key", F.col("starts.wall").alias("start"), "rrule", "rdates", "exdates", length.alias("length_s"), F.col("_z").alias("zone"))
    plain = series.filter("rrule is null and coalesce(size(rdates), 0) = 0 and coalesce(size(exdates), 0) = 0").select("key", "start")
    starts = plain.unionByName(expand(series.filter("rrule is not null or coalesce(size(rdates), 0) > 0 or coalesce(size(exdates), 0) > 0"), until, begin))
    kept = ["feed", "event_no", "uid", "whole_day", "recurring", "_z", "_size", F.lower("starts.kind").isin("utc", "zoned").alias("fixed")]
    found = starts.join(masters.select("key", *kept), "key").withColumn("start_us", Z.local_to_utc_us(Z.wall_us(F.col("start")), F.col("_z")))
    found = found.withColumn("_at", F.when(F.col("fixed"), Z.wall_of(F.col("start_us"))).otherwise(F.col("start")))
    overrides = e.filter("recurrence_id.wall is not null").withColumn("_rid", Z.local_to_utc_us(Z.wall_us(F.col("recurrence_id.wall")), F.col("_rz")))
    found = found.join(overrides.select("feed", "uid", F.col("_rid").alias("start_us")).distinct(), ["feed", "uid", "start_us"], "left_anti")
    moved = overrides.filter("not cancelled").select(
        *kept[:-1], F.lower("recurrence_id.kind").isin("utc", "zoned").alias("fixed"), F.col("starts.wall").alias("start"), F.col("_b").alias("start_us"),
        F.when(F.lower("recurrence_id.kind").isin("utc", "zoned"), Z.wall_of(F.col("_rid"))).otherwise(F.col("recurrence_id.wall")).alias("_at"))
    rows = found.select(*moved.columns).unionByName(moved)
    end = F.when(F.col("whole_day"), Z.local_to_utc_us(Z.wall_us(F.col("start")) + F.col("_size"), F.col("_z"))).otherwise(F.col("start_us") + F.col("_size"))
    rows = rows.withColumn("end_us", end).filter(overlaps(F.col("start_us"), F.col("end_us"), F.lit(_micros(begin)), F.lit(_micros(until))))
    return rows.select("feed", "event_no", "uid", occurrence_id(F.col("uid"), F.col("_at"), F.col("fixed"), F.col("recurring")).alias("id"), "start_us", "end_us", "whole_day", "recurring")


def _micros(utc: datetime) -> int:
    at = utc.replace(tzinfo=timezone.utc) if utc.tzinfo is None else utc
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def expansion_summary(occurrences: DataFrame, most: int = MOST_OCCURRENCES) -> DataFrame:
    """``occurrences``, ``complete``, one row: how many there are, and whether a query of at most ``most`` would have held them all."""
    return occurrences.agg(F.count("*").alias("occurrences")).withColumn("complete", F.col("occurrences") <= most)


def occurrences_page(occurrences: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """A page of occurrences by start, then feed, event and id, with ``row_no`` from 1 on."""
    order = [F.asc(c) for c in ("start_us", "feed", "event_no", "id")]
    rows = occurrences.orderBy(*order).offset(offset).limit(page_size("events", size))
    return rows.withColumn("row_no", F.row_number().over(W.orderBy(*order)).cast("bigint") + offset).orderBy("row_no")  # over a page


def list_events(events: DataFrame, begin: datetime, until: datetime, zone: str = "UTC", token: str | None = None, size: int | None = None) -> tuple[DataFrame, str | None]:
    """A page of a window's occurrences and the token of the next page; a token keeps the window of the page it came with."""
    offset = 0
    if token is not None:
        offset, a, b = read_window_token(token)
        begin, until = (datetime.fromtimestamp(x, timezone.utc).replace(tzinfo=None) for x in (a, b))
    rows = expand_window(events, begin, until, zone)
    end = next_offset(offset, page_size("events", size), rows.count())
    return occurrences_page(rows, offset, size), None if end is None else window_token(end, _micros(begin) // 1_000_000, _micros(until) // 1_000_000)


def find_event(events: DataFrame, wanted: str, zone: str = "UTC") -> DataFrame:
    """The occurrence that an id names, looked for within 366 days of the time in it, else the event whose UID it is; the first feed has it.

    An override is found by its series' original time, wherever it moved to.
    """
    uid, bar, at = wanted.rpartition("|")
    try:
        when = datetime.strptime(at.removesuffix("Z"), "%Y%m%dT%H%M%S") if bar else None
    except ValueError:
        when = None
    columns = ["feed", "event_no", "uid", "id", "start_us", "end_us", "whole_day", "recurring"]
    whole = events.filter(F.col("uid") == wanted).filter("recurrence_id.wall is null") if "recurrence_id" in events.columns else events.filter(F.col("uid") == wanted)
    far = (datetime(1900, 1, 1), datetime(2201, 1, 1))
    single = whole.drop("rrule", "rdates", "exdates")
    rows = expand_window(single, *far, zone).withColumn("_way", F.lit(1))
    if when is not None:
        year = timedelta(days=366)
        rows = rows.unionByName(expand_window(events.filter(F.col("uid") == uid), when - year, when + year, zone).filter(F.col("id") == wanted).withColumn("_way", F.lit(0)))
    return rows.orderBy("_way", "feed", "event_no").limit(1).select(*columns)


def selected(calendars: DataFrame, feed_no: int | None = None) -> DataFrame:
    """All calendars, or the one asked for; ValueError if it is not there."""
    if feed_no is None:
        return calendars
    one = calendars.filter(F.col("feed_no") == feed_no)
    if one.limit(1).count() == 0:
        raise ValueError(f"there is no calendar {feed_no}")
    return one


#: Seconds that a fetched feed is good for.
FRESH_S = 15 * 60


def fetched(events: DataFrame, now: datetime, fresh_s: int = FRESH_S) -> DataFrame:
    """``feed_no``, ``fetched_at`` (the latest), ``fresh``: whether a feed need not be fetched again at ``now`` (UTC)."""
    age = F.lit(_micros(now)) - F.unix_micros("fetched_at")
    return events.groupBy("feed_no").agg(F.max("fetched_at").alias("fetched_at")).withColumn("fresh", F.coalesce(age < fresh_s * 1_000_000, F.lit(False)))


def to_utc_us(wall: Column, zone: Column) -> Column:
    """Microseconds of the instant of a wall time: the earlier of two, moved by the gap where skipped."""
    return Z.local_to_utc_us(Z.wall_us(wall), zone)


def events_page(events: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of events (``start``, ``source``, ``event_no``) by start, then source and number."""
    return events.orderBy("start", "source", "event_no").offset(offset).limit(size)


def description_text(text: Column) -> Column:
    """A description as text: HTML only if a known tag says so."""
    from almanak.functions.text import shown

    is_html = text.rlike(r"(?i)<(?:br|p|div|a|b|i|ul|ol|li|span|html|table|h[1-6])\b[^>]*>")
    return F.when(is_html, shown(text)).otherwise(text)


def ics_unescaped(text: Column) -> Column:
    """iCalendar escapes undone."""
    t = F.regexp_replace(text, r"\\\\", "\x00")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[nN]", "\n"), r"\\([,;])", "$1")
    return F.translate(t, "\x00", "\\")


def event_view(events: DataFrame, zone: str = "UTC", most: int = 300) -> DataFrame:
    """Events as a list shows them: start and end in a zone (dates as dates), the description cut, free or busy, hidden characters gone and counted."""
    from almanak.functions import text as T

    whole_day = F.col("starts.kind") == "date"
    local = lambda c: F.convert_timezone(F.coalesce(F.col(f"{c}.tz"), F.lit("UTC")), F.lit(zone), F.col(f"{c}.wall"))
    shown = lambda c: F.when(whole_day, F.date_format(f"{c}.wall", "yyyy-MM-dd")).otherwise(F.date_format(local(c), "yyyy-MM-dd'T'HH:mm:ss"))
    body = T.clean(F.col("description"))
    cut, more = T.truncated(body, most)
    status = T.one_of(F.col("status"), ["confirmed", "tentative", "cancelled"])
    return events.select("event_no", "uid", T.clean(F.col("summary")).alias("title"), shown("starts").alias("start"), shown("ends").alias("end"), cut.alias("description"), more.alias("cut"), status.alias("status"), F.when(F.col("transparent"), "free").otherwise("busy").alias("shown_as"), T.hidden_count(F.col("description")).alias("hidden"))
