"""Spellings of one instant, policies at clock changes, refusals."""

from datetime import datetime, timezone

import pytest

from almanak.operators.timestamps import normalise_times

RAW = "raw_no bigint, feed_no bigint, start_text string, end_text string, recurrence_text string, text string, zone string, field string"
CALENDARS = "feed_no bigint, time_zone string, zone string, day_first boolean"


def read(spark, texts, zone="Europe/Berlin", others=()):
    rows = [(n, 1, t, None, None, "x", "y", "z") for n, t in enumerate(texts)] + [(1000 + n, 1, None, t, None, "", "", "") for n, t in enumerate(others)]
    out = normalise_times(spark.createDataFrame(rows, RAW), spark.createDataFrame([(1, zone, "q", True)], CALENDARS)).collect()
    return {r.raw_no: r.utc_us for r in out if r.field == "start"}


def us(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


SAME = [
    "20260504T101500Z", "2026-05-04T12:15:00+02:00", "2026-05-04 12:15", "2026/05/04 12:15:00", "2026-W19-1T10:15:00Z", "1777889700", "1777889700000", "1777889700000000",
    "2026-05-04T12:15:00[Europe/Berlin]", "2026-05-04T05:15:00-05", "20260504T1215", "TZID=America/New_York:20260504T061500", ';TZID="Eastern Standard Time":20260504T061500',
    "04.05.2026, 12:15", "4/5/2026 12:15", "04/05/2026 12:15 PM", "4/5/2026 12:15 p.m.", "4. Mai 2026, 12:15 Uhr", "4 de mayo de 2026, 12:15", "4 mai 2026 à 12h15", "May 4, 2026 12:15",
    "4 May 2026, 12:15", "Mon, 4 May 2026 12:15:00 +0200", "4 May 2026 12:15:00 CEST", "Mon May  4 12:15:00 CEST 2026", "2026-05-04 10:15:00z", "2026-05-04 10:15:00 UTC", "2026-05-04T06:15:00−04:00",
    "2026-05-04T10:15:00,000+00:00", " 20260504T101500Z\r", "2026-05-04 10:15:00+0000\xa0",
]


def test_every_spelling_is_the_same_instant(spark):
    got = read(spark, SAME, others=["25/12/2026 10:00"])
    assert got == {n: us(2026, 5, 4, 10, 15) for n in range(len(SAME))}


def test_policies(spark):
    texts = ["2026-10-25 02:30", "2026-03-29 02:30", "2026-07-01", "VALUE=DATE:20260701", "2026-07-01T24:00:00+00:00", "12/1/2026 12:05 AM", "2026-01-01T00:00:00.123456Z", "2020-12-31T23:00:00+23:00"]
    got = read(spark, texts, others=["1/13/2026 10:00"])
    assert got[0] == us(2026, 10, 25, 0, 30) and got[1] == us(2026, 3, 29, 1, 30)
    assert got[2] == got[3] == us(2026, 6, 30, 22) and got[4] == us(2026, 7, 2)
    assert read(spark, ["2026-05-04T12:15:00[America/New_York]"]) == {0: us(2026, 5, 4, 16, 15)}
    assert got[5] == us(2026, 11, 30, 23, 5) and got[6] == us(2026, 1, 1) + 123456


def test_what_is_no_time(spark):
    bad = ["", " ", "-", "tbd", "2026-02-30", "20260431", "2026-01-01T25:00:00Z", "2026-01-01T24:30:00Z", "2026-01-01 10:61", "0000-00-00T00:00:00Z", "2026-W54-1T00:00:00Z", "2025-W53-1T00:00:00Z", "13/13/2026 10:00", "13/5/2026 13:00 PM", "4 Foo 2026, 10:00", "at 2026-01-01", "2026-01-01T10:00:00 XYZ", "x" * 100_000, None, "2026-05-04T10:15:00[Mars/Base]"]
    assert read(spark, bad) == {}


@pytest.mark.parametrize("zone,hour", [(None, 12), ("", 12), ("local", 12), ("europe/BERLIN ", 10), ("America/New York", 16), ("W. Europe Standard Time", 10), ("UTC+02:00", 10), ("GMT-3", 15), ("Etc/GMT+3", 15), ("Z", 12)])
def test_default_zones(spark, zone, hour):
    assert read(spark, ["2026-05-04 12:00"], zone) == {0: us(2026, 5, 4, hour)}


def test_no_calendar_and_nothing(spark):
    raw, none = spark.createDataFrame([(1, None, "2026-05-04 12:00", None, None, "", "", ""), (2, 7, None, "2026-05-04 12:00", "junk", "", "", "")], RAW), spark.createDataFrame([], CALENDARS)
    assert {tuple(r) for r in normalise_times(raw, none).collect()} == {(1, "start", us(2026, 5, 4, 12)), (2, "end", us(2026, 5, 4, 12))}
    assert normalise_times(spark.createDataFrame([], RAW), none).collect() == []
