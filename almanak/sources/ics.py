"""iCalendar files as rows: feeds from any file system Spark reads, parsed in Arrow batches, and the parser behind it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from almanak.functions import recurrence

TIME = "struct<kind: string, wall: timestamp_ntz, tz: string>"
PERSON = "struct<name: string, email: string, response: string>"
SCHEMA = f"feed string, event_no bigint, uid string, summary string, description string, location string, starts {TIME}, ends {TIME}, duration string, rrule string, rdates array<timestamp_ntz>, exdates array<timestamp_ntz>, recurrence_id {TIME}, status string, transparent boolean, organizer {PERSON}, attendees array<{PERSON}>, skipped boolean, rdates_sent array<{TIME}>, exdates_sent array<{TIME}>"


def unfolded(text: str) -> list[str]:
    """Content lines; a line that begins with a blank goes on the one before."""
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def content_line(line: str) -> tuple[str, dict[str, str], str] | None:
    """Name, parameters and value; quotes protect ``;`` ``:`` and ``,``."""
    m = re.match(r'([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=(?:"[^"]*"|[^";:,]*)(?:,(?:"[^"]*"|[^";:,]*))*)*):(.*)$', line, re.S)
    if not m:
        return None
    params = {k.upper(): v.strip('"') for k, v in re.findall(r';([A-Za-z0-9-]+)=("[^"]*"|[^;:]*)', m[2])}
    return m[1].upper(), params, m[3]


def plain(value: str) -> str:
    return re.sub(r"\\([nN,;\\])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def time_value(value: str, params: dict[str, str]) -> tuple[str, datetime, str | None] | None:
    """Kind (utc, zoned, floating, date), wall time and zone of a date or time."""
    v = value.strip()
    try:
        if re.fullmatch(r"\d{8}", v):
            return "date", datetime.strptime(v, "%Y%m%d"), None
        if re.fullmatch(r"\d{8}T\d{6}Z", v):
            return "utc", datetime.strptime(v, "%Y%m%dT%H%M%SZ"), "UTC"
        wall = datetime.strptime(v, "%Y%m%dT%H%M%S")
    except ValueError:
        return None
    zone = params.get("TZID")
    if zone:
        m = re.search(r"([A-Z][A-Za-z_]+/[A-Z][A-Za-z_/+-]+)$", zone)
        return "zoned", wall, m[1] if m else zone
    return "floating", wall, None


def person(params: dict[str, str], value: str) -> tuple[str | None, str | None, str | None]:
    mail = re.sub(r"(?i)^mailto:", "", value.strip())
    reply = params.get("PARTSTAT", "").lower().replace("-", "_") or None
    known = ("accepted", "declined", "tentative", "needs_action", "delegated")
    return params.get("CN") or None, mail.lower() if "@" in mail else None, reply if reply in (None, *known) else "other"


def parse(text: str, feed: str = "") -> Iterator[tuple]:
    """Rows of SCHEMA, one per VEVENT; one that lacks a UID or a readable start is only marked as skipped."""
    number, depth, event = 0, [], None
    for line in unfolded(text):
        parsed = content_line(line)
        if parsed is None:
            continue
        name, params, value = parsed
        if name == "BEGIN":
            depth.append(value.strip().upper())
            if depth[-1] == "VEVENT":
                event = {"attendees": [], "rdates": [], "exdates": []}
        elif name == "END":
            if depth and depth.pop() == "VEVENT" and event is not None:
                number += 1
                yield _row(feed, number, event)
                event = None
        elif event is not None and depth and depth[-1] == "VEVENT":
            if name in ("DTSTART", "DTEND", "RECURRENCE-ID"):
                event[name] = time_value(value, params)
            elif name in ("RDATE", "EXDATE"):
                event[name.lower() + "s"] += [t for v in value.split(",") if (t := time_value(v, params))]
            elif name == "ATTENDEE":
                event["attendees"].append(person(params, value))
            elif name == "ORGANIZER":
                event[name] = person(params, value)
            else:
                event.setdefault(name, value)


def _walls(sent: list[tuple[str, datetime, str | None]], e: dict) -> list[datetime]:
    """Times as wall times of the event's own zone, where both have one; a floating or whole-day event has the reader's, so theirs stay as sent."""
    own = e.get("DTSTART")
    if not own or own[0] not in ("utc", "zoned"):
        return [wall for _, wall, _ in sent]
    zone = recurrence.zone_info(own[2])
    known = lambda tz: tz == "UTC" or recurrence.zone_info(tz) is not None
    return [recurrence.wall_time(recurrence.instant(wall, recurrence.zone_info(tz)), zone) if tz != own[2] and known(tz) and known(own[2]) else wall for _, wall, tz in sent]


def _row(feed: str, number: int, e: dict) -> tuple:
    text = lambda k: plain(e[k]) if k in e else None
    status = (e.get("STATUS") or "").strip().lower() or None
    status = status if status in (None, "confirmed", "tentative", "cancelled") else "other"
    skipped = not e.get("UID") or not e.get("DTSTART")
    return (
        feed, number, text("UID"), text("SUMMARY"), text("DESCRIPTION"), text("LOCATION"), e.get("DTSTART"), e.get("DTEND"), e.get("DURATION"), e.get("RRULE"),
        _walls(e["rdates"], e), _walls(e["exdates"], e), e.get("RECURRENCE-ID"), status, e.get("TRANSP", "").upper() == "TRANSPARENT", e.get("ORGANIZER"), e["attendees"], skipped, e["rdates"], e["exdates"],
    )


def _as(kind, v):
    """A parsed value in the form Arrow takes: structs by name."""
    if v is None:
        return None
    if isinstance(kind, StructType):
        return dict(zip(kind.names, v))
    return [_as(kind.elementType, x) for x in v] if isinstance(kind, ArrayType) else v


def _parser(fields: list[StructField]):
    """mapInArrow function: the rows of each file."""
    schema = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                feed = path.rsplit("/", 1)[-1].removesuffix(".ics")
                rows = list(parse((content.as_py() or b"").decode("utf-8", "replace"), feed))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([_as(f.dataType, r[i]) for r in part], schema.field(i).type) for i, f in enumerate(fields)], schema.names)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ics").option("recursiveFileLookup", "true").load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events of ``*.ics`` files in and below a folder; many small files share a task."""
    return _files(spark, path).select("path", "content").mapInArrow(_parser(StructType.fromDDL(SCHEMA).fields), SCHEMA)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """``feed``, ``fetched_at``, ``error``: each feed once; one that is no calendar has an error, and the others answer all the same."""
    fine = F.col("content").cast("string").rlike(r"(?i)^\ufeff?\s*BEGIN:VCALENDAR")
    feed = F.regexp_replace(F.substring_index("path", "/", -1), r"\.ics$", "")
    return _files(spark, path).select(feed.alias("feed"), F.col("modificationTime").alias("fetched_at"), F.when(~fine, "no calendar").alias("error"))


def skipped_events(events: DataFrame) -> DataFrame:
    """``feed``, ``skipped``: how many events of each feed could not be read."""
    return events.groupBy("feed").agg(F.count_if("skipped").alias("skipped"))


def duration_s(value: str | None) -> int | None:
    """Seconds of a duration as feeds write it, a day being 24 hours; null where it is unreadable or longer than a century."""
    m = re.fullmatch(r"([+-]?)P(?:(\d+)W|(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?)", (value or "").strip().upper())
    if not m or not any(m.groups()[1:]):
        return None
    w, d, h, mi, s = (int(x or 0) for x in m.groups()[1:])
    total = (w * 7 + d) * 86400 + h * 3600 + mi * 60 + s
    return None if total > 36_600 * 86400 else -total if m[1] == "-" else total
