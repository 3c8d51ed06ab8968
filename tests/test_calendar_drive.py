"""Recurrence, overrides, windows, file trees, sources and the stream."""

import email
import email.policy
import hashlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from almanak.functions import text as T
from almanak.functions.recurrence import Rule
from almanak.operators import calendar as C
from almanak.operators import drive as D
from almanak.plans.paging import TreePlace
from almanak.sources import eml, ics, lenient
from almanak.streaming.counts import domain_counts

FAR = datetime(2100, 1, 1)


def days(rule, start, most=9):
    return [t.strftime("%m-%d") for t in Rule(rule).starts(start, None, FAR, most)]


@pytest.mark.parametrize(
    "rule,start,expected",
    [
        ("FREQ=MONTHLY;COUNT=4", datetime(2026, 1, 31, 9), ["01-31", "03-31", "05-31", "07-31"]), ("FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4", datetime(2026, 10, 26), ["10-26", "10-28", "11-02", "11-04"]),
        ("FREQ=MONTHLY;BYDAY=-1FR;COUNT=3", datetime(2026, 1, 1), ["01-30", "02-27", "03-27"]), ("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=2", datetime(2026, 1, 1), ["01-30", "02-27"]),
        ("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29;COUNT=2", datetime(2024, 2, 29), ["02-29", "02-29"]), ("FREQ=DAILY;INTERVAL=10;COUNT=3", datetime(2026, 1, 1), ["01-01", "01-11", "01-21"]),
        ("FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,TU;COUNT=4", datetime(2026, 1, 6), ["01-06", "01-18", "01-20", "02-01"]), ("FREQ=YEARLY;BYDAY=1MO;COUNT=2", datetime(2026, 1, 1), ["01-05", "01-04"]), ("FREQ=MONTHLY;BYMONTHDAY=-1;COUNT=2", datetime(2026, 2, 1), ["02-28", "03-31"]),
    ],
)
def test_rules(rule, start, expected):
    assert days(rule, start) == expected


def test_rules_end():
    assert days("FREQ=DAILY", datetime(9999, 12, 30)) == [] and days("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=30", datetime(2026, 1, 1)) == []
    for bad in ("FREQ=HOURLY", "", "FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;BYHOUR=1"):
        with pytest.raises(ValueError):
            Rule(bad)


SERIES = "key bigint, start timestamp_ntz, rrule string, rdates array<timestamp_ntz>, exdates array<timestamp_ntz>, length_s bigint"


def test_expand_and_override(spark):
    t = datetime(2026, 10, 26, 9)
    rows = [(1, t, "FREQ=WEEKLY;COUNT=4", [datetime(2026, 12, 1), t], [datetime(2026, 11, 2, 9)], 3600), (2, t, "FREQ=ODD", None, None, None), (3, None, "FREQ=DAILY", None, None, 0), (4, t, "FREQ=DAILY;UNTIL=20261028", [], [], 0)]
    out = C.expand(spark.createDataFrame(rows, SERIES), FAR)
    got = {(r.key, r.start) for r in out.collect()}
    assert got == {(1, t), (1, datetime(2026, 11, 9, 9)), (1, datetime(2026, 11, 16, 9)), (1, datetime(2026, 12, 1)), (2, t), (4, t), (4, datetime(2026, 10, 27, 9)), (4, datetime(2026, 10, 28, 9))}
    overrides = spark.createDataFrame([(1, datetime(2026, 11, 9, 9), datetime(2026, 11, 9, 11), None), (2, t, t, "Cancelled")], "key bigint, recurrence_start timestamp_ntz, start timestamp_ntz, status string")
    moved = {(r.key, r.start) for r in C.with_overrides(out, overrides).collect()}
    assert moved == (got - {(1, datetime(2026, 11, 9, 9)), (2, t)}) | {(1, datetime(2026, 11, 9, 11))}
    assert C.expand(spark.createDataFrame([], SERIES), FAR).collect() == []


def test_series_begun_long_before_its_window(spark):
    began, look_from, before = datetime(2016, 1, 4, 9), datetime(2026, 1, 5), datetime(2026, 1, 12)
    rules = ["FREQ=DAILY", "FREQ=WEEKLY;BYDAY=MO,TU,WE,TH,FR", "FREQ=DAILY;COUNT=3657", "FREQ=DAILY;UNTIL=20260106"]
    out = C.expand(spark.createDataFrame([(k, began, r, None, None, 3600) for k, r in enumerate(rules)], SERIES), before, look_from).collect()
    assert [sorted(r.start.day for r in out if r.key == k) for k in range(4)] == [[5, 6, 7, 8, 9, 10, 11], [5, 6, 7, 8, 9], [5, 6, 7], [5, 6]]


@pytest.mark.parametrize("rule", ["FREQ=DAILY;INTERVAL=3", "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,TU", "FREQ=MONTHLY;INTERVAL=5;BYDAY=-1FR", "FREQ=MONTHLY", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "FREQ=YEARLY;BYDAY=1MO,-1SU", "FREQ=DAILY;COUNT=700"])
def test_starts_since(rule):
    start, end = datetime(2016, 1, 31, 9), datetime(2022, 1, 1)
    every = list(Rule(rule).starts(start, None, end, 10**6))
    for since in (datetime(2010, 1, 1), start, datetime(2016, 3, 1, 10), datetime(2017, 12, 31, 9), datetime(2019, 6, 30), datetime(2024, 1, 1)):
        assert list(Rule(rule).starts(start, None, end, 40, since)) == [t for t in every if t >= since][:40]


SENT = "array<struct<kind: string, wall: timestamp_ntz, tz: string>>"


def test_series_in_its_own_zone(spark):
    t, ny = datetime(2026, 1, 5, 9), "America/New_York"
    at = lambda *a: datetime(2026, *a)
    rows = [
        # 09:00 there is 14:00 UTC; the last one is at UNTIL, which as wall time would let a fifth in or drop it
        (1, t, "FREQ=WEEKLY;UNTIL=20260126T140000Z", [("utc", at(2, 3, 15), "UTC")], [("utc", at(1, 12, 14), "UTC")], 0, ny), (2, t, "FREQ=WEEKLY;UNTIL=20260126T135959Z", [("zoned", at(2, 3, 9), "Europe/Berlin")], [("zoned", at(1, 12, 15), "Europe/Berlin")], 0, ny),
        # across the change of clocks: 09:00 is 13:00 UTC from 8 March on
        (3, at(3, 2, 9), "FREQ=WEEKLY;COUNT=3", [("floating", at(3, 3, 9), None)], [("utc", at(3, 9, 13), "UTC"), ("utc", at(3, 16, 14), "UTC")], 0, ny), (4, t, "FREQ=WEEKLY;COUNT=2", None, [("utc", at(1, 12, 9), "UTC")], 0, None),
        # a skipped wall time is an hour later; a local time without a zone in UNTIL is of the series
        (5, at(3, 7, 2, 30), "FREQ=DAILY;COUNT=3", None, [("utc", at(3, 8, 7, 30), "UTC")], 0, ny), (6, t, "FREQ=DAILY;UNTIL=20260106T090000", None, None, 0, ny),
        (7, t, "FREQ=DAILY;COUNT=3", None, [("zoned", at(1, 6, 14), "UTC")], 0, ny),
    ]
    schema = f"key bigint, start timestamp_ntz, rrule string, rdates {SENT}, exdates {SENT}, length_s bigint, zone string"
    got = C.expand(spark.createDataFrame(rows, schema), FAR).collect()
    assert {k: sorted(r.start for r in got if r.key == k) for k in range(1, 8)} == {
        1: [t, at(1, 19, 9), at(1, 26, 9), at(2, 3, 10)], 2: [t, at(1, 19, 9), at(2, 3, 3)], 3: [at(3, 2, 9), at(3, 3, 9), at(3, 16, 9)], 4: [t],
        5: [at(3, 7, 2, 30), at(3, 9, 2, 30)], 6: [t, at(1, 6, 9)], 7: [t, at(1, 7, 9)],
    }
    # the window is compared as instants: 9 January 09:00 in New York is 14:00 UTC
    daily = spark.createDataFrame([(1, t, "FREQ=DAILY", None, None, 0, ny)], schema)
    assert [r.start for r in C.expand(daily, at(1, 9, 14, 0, 1)).collect()][-1] == at(1, 9, 9) and [r.start for r in C.expand(daily, at(1, 9, 14)).collect()][-1] == at(1, 8, 9)


def test_ics_exceptions_in_utc(spark, tmp_path):
    feed = FEED.replace("EXDATE;TZID=Europe/Lisbon:20260512T183000", "EXDATE:20260512T173000Z,20260519T173000Z\nRDATE;TZID=Europe/Madrid:20260613T120000")
    (tmp_path / "utc.ics").write_text(feed)
    df = ics.read(spark, str(tmp_path)).filter("event_no = 1")
    a = df.collect()[0]
    assert a.exdates == [datetime(2026, 5, 12, 18, 30), datetime(2026, 5, 19, 18, 30)] and a.rdates == [datetime(2026, 6, 13, 11)] and a.exdates_sent[0].kind == "utc" and a.exdates_sent[0].wall == datetime(2026, 5, 12, 17, 30)
    for suffix in ("", "_sent"):
        series = df.select(F.col("event_no").alias("key"), F.col("starts.wall").alias("start"), "rrule", F.col("rdates" + suffix).alias("rdates"), F.col("exdates" + suffix).alias("exdates"), F.lit(0).cast("bigint").alias("length_s"), F.col("starts.tz").alias("zone"))
        assert sorted(r.start for r in C.expand(series, FAR).collect()) == [datetime(2026, 5, 5, 18, 30), datetime(2026, 5, 26, 18, 30), datetime(2026, 6, 13, 11)]


EVENTS = "feed bigint, event_no bigint, uid string, starts struct<kind: string, wall: timestamp_ntz, tz: string>, ends struct<kind: string, wall: timestamp_ntz, tz: string>, duration string, status string, rrule string, rdates array<struct<kind: string, wall: timestamp_ntz, tz: string>>, exdates array<struct<kind: string, wall: timestamp_ntz, tz: string>>, recurrence_id struct<kind: string, wall: timestamp_ntz, tz: string>, summary string"


def test_window_of_all_kinds_of_events(spark):
    at = lambda *a: datetime(2026, *a)
    z = "Pacific/Auckland"
    rows = [
        (1, 1, "a", ("utc", at(3, 1, 10), None), ("utc", at(3, 1, 9), None), "PT30M", None, None, None, None, None, ""), (1, 2, "b", ("date", at(3, 1), None), None, None, "tentative", None, None, None, None, ""),
        (1, 3, "c", ("zoned", at(3, 1, 9), z), None, None, None, "FREQ=DAILY;COUNT=5", None, [("utc", at(3, 2, 20), None)], None, ""), (1, 4, "c", ("zoned", at(3, 9, 9), z), None, "PT1H", "Confirmed", None, None, None, ("zoned", at(3, 4, 9), z), ""),
        (1, 5, "c", ("zoned", at(3, 5, 9), z), None, None, " CANCELLED ", None, None, None, ("utc", at(3, 4, 20), "UTC"), ""), (2, 3, "c", ("floating", at(3, 4, 9), None), None, "junk", None, None, [("floating", at(3, 6, 9), None)], None, None, ""),
        (2, 4, "d", None, None, None, None, None, None, None, None, ""), (2, 5, "e", ("utc", at(2, 1), None), ("utc", at(4, 1), None), None, "cancelled", None, None, None, None, ""), (None, None, "f", ("utc", at(3, 3), None), None, None, None, "FREQ=NEVER", None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    got = sorted(((r.id, r.feed, r.start_us // 3_600_000_000, (r.end_us - r.start_us) // 60_000_000) for r in C.expand_window(df, at(3, 1), at(3, 12), "Asia/Tokyo").collect()), key=str)
    hour = lambda *a: int((datetime(2026, *a) - datetime(1970, 1, 1)).total_seconds()) // 3600
    assert got == sorted([
        ("a", 1, hour(3, 1, 10), 30), ("b", 1, hour(2, 28, 15), 1440), ("c|20260301T200000Z", 1, hour(3, 1, 20), 0), ("c|20260303T200000Z", 1, hour(3, 8, 20), 60), ("c|20260304T090000", 2, hour(3, 4, 0), 0), ("c|20260306T090000", 2, hour(3, 6, 0), 0),
        ("f|20260303T000000Z", None, hour(3, 3), 0),
    ], key=str)
    assert {g[0] for g in got} == {"a", "b", "c|20260301T200000Z", "c|20260303T200000Z", "c|20260304T090000", "c|20260306T090000", "f|20260303T000000Z"}
    assert C.expand_window(df.limit(0), at(3, 1), at(3, 12)).collect() == []
    assert tuple(C.expansion_summary(C.expand_window(df, at(3, 1), at(3, 12)), 6).collect()[0]) == (7, False)
    one = C.find_event(df, "c|20260303T200000Z").collect()[0]
    assert (one.event_no, one.start_us // 3_600_000_000) == (4, hour(3, 8, 20)) and C.find_event(df, "c|20260302T200000Z").collect() == [] and C.find_event(df, "b").collect()[0].event_no == 2 and C.find_event(df, "odd|id").collect() == []


def test_pages_keep_their_window(spark):
    rows = [(1, k, f"e{k}", ("utc", datetime(2026, 3, 1 + k % 3, 10), None), None, None, None, None, None, None, None, "") for k in range(25)]
    df = spark.createDataFrame(rows, EVENTS)
    page, token = C.list_events(df, datetime(2026, 3, 1), datetime(2026, 3, 4), size=10)
    seen = [r.event_no for r in page.collect()]
    while token:
        page, token = C.list_events(df, datetime(2030, 1, 1), datetime(2030, 1, 2), token=token, size=10)
        seen += [r.event_no for r in page.collect()]
    assert seen == sorted(range(25), key=lambda k: (k % 3, k))


def test_calendars_asked_for(spark):
    calendars = spark.createDataFrame([(1, "a"), (2, "b")], "feed_no bigint, feed_name string")
    assert C.selected(calendars).count() == 2 and C.selected(calendars, 2).collect()[0].feed_name == "b"
    with pytest.raises(ValueError):
        C.selected(calendars, 3)
    now = datetime(2026, 3, 1, 12)
    stamp = lambda h, m: datetime(2026, 3, 1, h, m, tzinfo=timezone.utc)
    got = C.fetched(spark.createDataFrame([(1, stamp(11, 44)), (1, stamp(11, 46)), (2, stamp(11, 44)), (3, None)], "feed_no bigint, fetched_at timestamp"), now).collect()
    assert {r.feed_no: r.fresh for r in got} == {1: True, 2: False, 3: False}


def test_terms(spark):
    df = spark.createDataFrame([(1, "Survey map", None), (2, "survey", "map"), (3, None, "the survey map at the kiln"), (4, None, None)], "id bigint, a string, b string")
    find = lambda q: {r.id for r in df.filter(C.matches_terms([F.col("a"), F.col("b")], *C.terms(q))).collect()}
    assert find("survey map") == {1, 2, 3} and find('"survey map" -kiln') == {1} and find("-kiln") == {1, 2, 4}
    with pytest.raises(ValueError):
        C.matches_terms([F.col("a")], [], [])


TREE = [("/Maps", "folder"), ("/Maps/coast.pdf", "file"), ("/Maps/Old", "folder"), ("/Maps/Old/Über.md", "file"), ("/Maps/Old/.draft.md", "file"), ("/Taxes/2025.csv", "file"), ("/.cache/y.bin", "file"), ("/Maps!", "folder"), ("/Maps!/b.md", "file"), ("/.rc", "file")]


def tree(spark, rows=TREE):
    e = spark.createDataFrame(rows, "path string, kind string").withColumn("name", D.name(F.col("path"))).withColumn("key", T.folded("name")).withColumn("path_key", T.folded("path"))
    return e.withColumn("modified", F.lit(None).cast("timestamp_ntz")).withColumn("size", F.when(F.col("kind") == "file", 10).otherwise(0).cast("bigint"))


def test_drive(spark):
    e = tree(spark)
    names = lambda **k: {r.path for r in D.search_entries(e, **k).collect()}
    assert names(asked="*", exclude=["/taxes"]) == {p for p, _ in TREE if "/." not in p} - {"/Taxes/2025.csv"}
    assert names(asked="c?as*") == {"/Maps/coast.pdf"} and names(asked="*", top="/Maps") == {"/Maps/coast.pdf", "/Maps/Old", "/Maps/Old/Über.md"}
    for asked in ("ÜBER", "u\u0308ber", "U\u0308B", "üb*.md"):
        assert names(asked=asked) == {"/Maps/Old/Über.md"}, asked
    assert names(asked="a", after="2020-01-01") == set() and names(asked="*", exclude=["/"]) == set()
    paths = spark.createDataFrame([("/a//b/",), ("/a/../b",), ("/",)], "p string").select(D.plain_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["/a/b", None, "/"]
    assert [r.path for r in D.list_folder(e, "/").collect()] == ["/Maps", "/Maps!"] and [r.path for r in D.list_folder(e, "/maps/", offset=1, size=1).collect()] == ["/Maps/coast.pdf"]
    assert D.hidden_names(e, "/").collect()[0][0] == 1 and D.hidden_names(e, "/Maps/Old").collect()[0][0] == 1 and D.hidden_names(e, "/", ["/.rc"]).collect()[0][0] == 0
    assert tuple(D.usage(e).collect()[0]) == (7, 70)


ORDER = ["/Maps", "/Maps!", "/Maps/coast.pdf", "/Maps/Old", "/Maps/Old/Über.md", "/Maps!/b.md", "/Taxes/2025.csv"]


def test_tree_in_pages(spark):
    e = tree(spark, [r for r in TREE if "/." not in r[0]]).cache()
    assert [r.path for r in D.tree_page(e, 99).collect()] == ORDER
    for size in (1, 2, 3, 7, 8):
        place, seen = None, []
        while True:
            page = D.tree_page(e, size, place)
            rows = page.collect()
            if not rows:
                break
            assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
            seen += [r.path for r in rows]
            place = TreePlace.read(D.next_place(page, place).token("/"), "/")
        assert seen == ORDER
    for bad in ("x", "a:b:c", TreePlace("/Maps", 1).token("/Taxes")):
        with pytest.raises(ValueError):
            TreePlace.read(bad, "/")


def test_tree_that_changes_between_pages(spark):
    first = D.tree_page(tree(spark, [("/P/p1", "file"), ("/P/p2", "file"), ("/Q/q1", "file"), ("/R/r1", "file")]), 3)
    place = D.next_place(first)
    assert [r.path for r in first.collect()] == ["/P/p1", "/P/p2", "/Q/q1"] and (place.folder, place.skip) == ("/Q", 1)
    later = tree(spark, [("/P/p1", "file"), ("/Q2/new", "file"), ("/R/r1", "file")])
    assert [r.path for r in D.tree_page(later, 9, place).collect()] == ["/Q2/new", "/R/r1"]


def test_walk_and_index(spark, tmp_path):
    for p in ("a/b/c.txt", "a/d.md", ".git/x", "a/.y", "skip/z", "top.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    got = {(r.path, r.kind, r["size"]) for r in D.walk(spark, str(tmp_path), ["/Skip"]).collect()}
    assert got == {("/a", "folder", 0), ("/a/b", "folder", 0), ("/a/b/c.txt", "file", 5), ("/a/d.md", "file", 5), ("/top.pdf", "file", 5)}
    assert tuple(D.walk_complete(D.walk(spark, str(tmp_path)), 3).collect()[0]) == (7, False)
    now, made = [0.0], []
    index = D.Index(lambda: made.append(1) or spark.range(len(made)), 60, lambda: now[0])
    assert index.entries().count() == index.entries().count() == 1
    now[0] = 60.0
    assert index.entries().count() == 2


def test_manifest(spark, tmp_path):
    e, m = tree(spark), str(tmp_path / "m")
    parts = D.write_manifest(e, m).collect()
    text = b"".join(f.read_bytes() for f in sorted((tmp_path / "m").glob("*.json")))
    assert sum(r.rows for r in parts) == spark.read.json(m).count() == len(TREE) and {r.sha256 for r in parts} == {hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "m").glob("*.json")} and text.count(b"\n") == len(TREE)
    with pytest.raises(Exception, match="exist"):
        D.write_manifest(e, m)
    D.write_manifest(e, m, append=True)
    assert spark.read.json(m).count() == 2 * len(TREE)


def test_manifest_in_pages(spark, tmp_path):
    e, m, place = tree(spark, [r for r in TREE if "/." not in r[0]]), str(tmp_path / "m"), None
    for _ in range(9):
        place = D.manifest_page(e, m, 3, place)
        if place is None:
            break
    assert sorted(r.path for r in spark.read.json(m).collect()) == sorted(ORDER)


def test_reconcile(spark):
    local = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("b", "b", 3), ("c", "C", 4), ("d", "D", 5)], "key string, name string, local_id bigint")
    remote = spark.createDataFrame([("a", "a", 11), ("b", "B", 12), ("b", "bB", 13), ("c", "x", 14), ("c", "y", 15), ("z", "z", 16)], "key string, name string, remote_id bigint")
    got = {(r.local_id, r.remote_id, r.why) for r in D.reconcile(local, remote).collect()}
    assert got == {(1, 11, "matched"), (2, 12, "matched"), (3, None, "ambiguous"), (4, None, "ambiguous"), (5, None, "only local"), (None, 13, "only remote"), (None, 14, "only remote"), (None, 15, "only remote"), (None, 16, "only remote")}


FEED = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:choir-7@town.test
DTSTART;TZID=Europe/Lisbon:20260505T183000
DTEND;TZID="/maker.test/Europe/Lisbon":20260505T200000
RRULE:FREQ=WEEKLY;COUNT=4
EXDATE;TZID=Europe/Lisbon:20260512T183000
SUMMARY:Choir\\, second
  voices
ORGANIZER;CN="Prata; Rui":mailto:Rui@town.test
ATTENDEE;PARTSTAT=ACCEPTED;CN=Eva:MAILTO:eva@town.test
BEGIN:VALARM
DESCRIPTION:not this
END:VALARM
END:VEVENT
BEGIN:VEVENT
SUMMARY:nobody knows
DTSTART:20260505T090000Z
END:VEVENT
END:VCALENDAR
"""


def test_ics_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "choir.ics").write_text(FEED.replace("\n", "\r\n"))
    (tmp_path / "bad.ics").write_text("<html>not found</html>")
    df = ics.read(spark, str(tmp_path))
    a, b = df.orderBy("event_no").collect()
    assert (a.feed, a.uid, a.summary, a.starts.kind, a.ends.tz, a.skipped, b.skipped) == ("choir", "choir-7@town.test", "Choir, second voices", "zoned", "Europe/Lisbon", False, True)
    assert a.organizer.name == "Prata; Rui" and a.attendees[0].response == "accepted" and a.description is None and a.exdates == [datetime(2026, 5, 12, 18, 30)] and b.starts.kind == "utc"
    assert {(r.feed, r.error) for r in ics.sources(spark, str(tmp_path)).collect()} == {("choir", None), ("bad", "no calendar")}
    assert [tuple(r) for r in ics.skipped_events(df).collect()] == [("choir", 1)]


def test_durations():
    assert [ics.duration_s(x) for x in ("PT2H5M", "P2W", "-PT20M", "P1DT1S", "PT", "P", "2H", None, "P40000D", " pt1m ")] == [7500, 1_209_600, -1200, 86_401, None, None, None, None, None, 60]


def test_eml_source(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b'From: Eva <eva@town.test>\nTo: b@y.test, "C, D" <c@y.test>\nSubject: =?utf-8?q?Caf=C3=A9?=\nDate: Mon, 4 May 2026 12:15:00 +0200\nMessage-ID: <m1@x.test>\nReferences: <r0@x.test> <r1@x.test>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain; charset=utf-8\n\nHello\n--b\nContent-Type: application/pdf; name=a.pdf\nContent-Disposition: attachment; filename=a.pdf\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--b--\n')
    r = eml.read(spark, str(tmp_path)).collect()[0]
    assert (r.subject, r.message_id, r.body.strip(), r.to_addrs, r.ref_ids) == ("Café", "<m1@x.test>", "Hello", ["b@y.test", "c@y.test"], ["<r0@x.test>", "<r1@x.test>"])
    assert r.attachments[0].name == "a.pdf" and r.attachments[0].size == 5 and r.attachments[0].sha256.startswith("2cf24dba")


def mime(kind, *children, **headers):
    """A part as text; nested ones have the boundary of their kind."""
    head = "".join(f"{k.replace('_', '-')}: {v}\n" for k, v in headers.items())
    if not children or isinstance(children[0], str) and kind.partition("/")[0] != "multipart":
        return f"Content-Type: {kind}\n{head}\n{children[0] if children else 'x'}\n"
    mark = "=" + kind.partition("/")[2] + str(len(children))
    return f"Content-Type: {kind}; boundary=\"{mark}\"\n{head}\n" + "".join(f"--{mark}\n{c}" for c in children) + f"--{mark}--\n"


@pytest.mark.parametrize(
    "source,body,attached",
    [
        (mime("multipart/alternative", mime("text/plain", "plain"), mime("text/html", "<p>h</p>")), "plain", []), (mime("multipart/alternative", mime("text/html", "<p>h</p>"), mime("text/calendar", "cal")), "<p>h</p>", ["text/calendar"]),
        (mime("multipart/related", mime("text/html", "<img>"), mime("image/png", Content_ID="<i>")), "<img>", ["image/png"]), (mime("multipart/related", mime("text/html", "root"), mime("text/plain", "other")), "root", ["text/plain"]),
        (mime("multipart/mixed", mime("multipart/alternative", mime("text/plain", "p"), mime("multipart/related", mime("text/html", "h"), mime("image/gif"))), mime("application/pdf")), "p", ["image/gif", "application/pdf"]),
        (mime("multipart/mixed", mime("text/plain", "first"), mime("text/plain", "note", Content_Disposition="attachment; filename=n.txt"), mime("text/plain", "footer")), "first", ["text/plain", "text/plain"]),
        (mime("multipart/digest", mime("message/rfc822", "Subject: a\n\nb")), None, ["message/rfc822"]), (mime("text/html", "<b>only</b>"), "<b>only</b>", []), (mime("image/png"), None, ["image/png"]),
    ],
)
def test_what_of_a_message_is_its_body(source, body, attached):
    m = email.message_from_string("MIME-Version: 1.0\n" + source, policy=email.policy.default)
    found, others = eml.parts(m)
    assert (found.get_content().strip() if found is not None else None, [p.get_content_type() for p in others]) == (body, attached)


def test_lenient_json(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"uid": "1", "type": "folder", "name": {"ok": true, "value": "A"}, "activeRevision": 5}\n{"uid": "2", "activeRevision": {"claimedSize": "x", "claimedDigests": {"sha1": "zz"}}}\nbroken\n')
    (tmp_path / "array.json").write_text('[{"uid": "3", "type": "Folder"},\n {"uid": 7, "activeRevision": {"claimedSize": 9}}, 4]')
    (tmp_path / "one.json").write_text('{"uid": "5",\n "activeRevision": {"claimedDigests": {"sha1": "' + "AB" * 20 + '"}}}')
    assert {(r.node_id, r.kind, r["size"], r.claimed_sha1) for r in lenient.listing(spark, str(tmp_path)).collect()} == {("1", "folder", 0, None), ("2", "file", 0, None), ("3", "folder", 0, None), ("7", "file", 9, None), ("5", "file", 0, "ab" * 20)}


def test_stream_counts_like_the_table(spark, tmp_path, data):
    rows = spark.read.parquet(f"{data}/counted.parquet").limit(300)
    rows.write.parquet(str(tmp_path / "in"))
    # which of several deliveries comes first is the stream's to say, so days may differ, but not how many there are
    total = lambda df: {r.domain: r.n for r in df.groupBy("domain").agg(F.sum("messages").alias("n")).collect()}
    batch = total(domain_counts(spark.read.parquet(str(tmp_path / "in")), late="900 days"))
    stream = domain_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="900 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert total(spark.table("counts")) == batch
