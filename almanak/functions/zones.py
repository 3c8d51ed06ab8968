"""Time zones: names as people write them, to IANA ids or fixed offsets; wall times to instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone names of one widespread desktop system, by the IANA id used for them.
DESKTOP_ZONES = {
    "UTC": "UTC",
    "GMT Standard Time": "Europe/London",
    "Greenwich Standard Time": "Atlantic/Reykjavik",
    "W. Europe Standard Time": "Europe/Berlin",
    "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw",
    "Romance Standard Time": "Europe/Paris",
    "GTB Standard Time": "Europe/Bucharest",
    "FLE Standard Time": "Europe/Helsinki",
    "E. Europe Standard Time": "Europe/Chisinau",
    "Turkey Standard Time": "Europe/Istanbul",
    "Russian Standard Time": "Europe/Moscow",
    "Egypt Standard Time": "Africa/Cairo",
    "South Africa Standard Time": "Africa/Johannesburg",
    "Israel Standard Time": "Asia/Jerusalem",
    "Arabian Standard Time": "Asia/Dubai",
    "Pakistan Standard Time": "Asia/Karachi",
    "India Standard Time": "Asia/Kolkata",
    "Nepal Standard Time": "Asia/Kathmandu",
    "Bangladesh Standard Time": "Asia/Dhaka",
    "SE Asia Standard Time": "Asia/Bangkok",
    "China Standard Time": "Asia/Shanghai",
    "Singapore Standard Time": "Asia/Singapore",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Korea Standard Time": "Asia/Seoul",
    "AUS Eastern Standard Time": "Australia/Sydney",
    "E. Australia Standard Time": "Australia/Brisbane",
    "Cen. Australia Standard Time": "Australia/Adelaide",
    "W. Australia Standard Time": "Australia/Perth",
    "New Zealand Standard Time": "Pacific/Auckland",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "Alaskan Standard Time": "America/Anchorage",
    "Pacific Standard Time": "America/Los_Angeles",
    "Mountain Standard Time": "America/Denver",
    "US Mountain Standard Time": "America/Phoenix",
    "Central Standard Time": "America/Chicago",
    "Eastern Standard Time": "America/New_York",
    "Atlantic Standard Time": "America/Halifax",
    "Newfoundland Standard Time": "America/St_Johns",
    "E. South America Standard Time": "America/Sao_Paulo",
    "Argentina Standard Time": "America/Buenos_Aires",
    "SA Pacific Standard Time": "America/Bogota",
}

# Zone abbreviations with one common meaning in mail and calendar text, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180,
}

BLANKS = r"[\s\u0085   -     　﻿]+"


def squeezed(c: Column) -> Column:
    """Runs of any white space become one blank; none stays outside."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def zone_key(c: Column) -> Column:
    """The form under which zone names are compared: no case, blanks for underscores."""
    return F.lower(squeezed(F.translate(c, "_", " ")))


def offset_minutes(c: Column) -> Column:
    """Minutes east of UTC of ``+01:00``, ``-0530``, ``+2``, ``UTC-08:00``, ``GMT+1`` or a known abbreviation; else null."""
    t = F.upper(squeezed(F.translate(c, "−", "-")))
    # sign, hours and minutes by one look: "-|05|30"
    parts = F.split(F.regexp_replace(t, r"^(?:UTC|GMT)? ?([+-])(\d{1,2})(?::?(\d{2}))?$", "$1|$2|$3"), r"\|")
    h, m = F.get(parts, F.lit(1)).try_cast("int"), F.coalesce(F.nullif(F.get(parts, F.lit(2)), F.lit("")), F.lit("0")).try_cast("int")
    minutes = (h * 60 + m) * F.when(F.get(parts, F.lit(0)) == "-", -1).otherwise(1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), t)
    return F.when(F.contains(t, F.lit("+")) | F.contains(t, F.lit("-")), F.when((h <= 18) & (m < 60), minutes)).otherwise(named).cast("int")


def zone_table(spark: SparkSession) -> DataFrame:
    """``zone_key`` -> ``zone``: every id the session can convert, and the desktop names.

    Bounded by the zone database (about 650 rows), hence safe to broadcast.
    """
    ids = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows = {z.lower().replace("_", " "): z for z in ids if not z.startswith("SystemV/")}
    rows |= {k.lower(): v for k, v in DESKTOP_ZONES.items()}
    return F.broadcast(spark.createDataFrame(sorted(rows.items()), "zone_key string, zone string"))


def with_zone(df: DataFrame, column: Column, into: str) -> DataFrame:
    """Adds ``into``: the IANA id that ``column`` names, null where it names none. Broadcasts the bounded zone table."""
    zones = zone_table(df.sparkSession).select(F.col("zone_key").alias("_zk"), F.col("zone").alias(into))
    return df.withColumn("_zkey", zone_key(column)).join(zones, F.col("_zkey") == F.col("_zk"), "left").drop("_zk", "_zkey")


def local_to_utc_us(local_us: Column, zone: Column) -> Column:
    """The instant in microseconds of a wall clock in a zone, given as microseconds as if it were UTC; in any session zone.

    Policy: of a wall time that occurs twice the earlier instant is taken; one
    that is skipped moves forward by the length of the skip.
    """
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def wall_us(utc_wall: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall clock without a zone, as if it were UTC, whatever the session zone is."""
    days = F.date_diff(utc_wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(utc_wall).cast("bigint") * 3600 + F.minute(utc_wall) * 60
    fraction = (F.extract(F.lit("SECOND"), utc_wall) * 1000000).cast("bigint")
    return (days * 86400 + seconds) * 1000000 + fraction


def utc_to_local_us(us: Column, zone: Column) -> Column:
    """The wall clock of an instant in a zone, as microseconds as if it were UTC; in any session zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def wall_of(local_us: Column) -> Column:
    """A wall clock given as microseconds as a timestamp without a zone."""
    days = F.floor(local_us / 86_400_000_000)
    rest = (local_us - days * 86_400_000_000).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def rfc3339(us: Column, zone: Column) -> Column:
    """An instant as RFC 3339 writes it in a zone, to the second, with its offset there."""
    local = utc_to_local_us(us, zone)
    off = F.floor((local - us) / 60_000_000).cast("int")
    size = F.abs(off)
    offset = F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(wall_of(local), "yyyy-MM-dd'T'HH:mm:ss"), offset)
