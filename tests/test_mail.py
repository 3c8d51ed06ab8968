"""Collapse against a greedy pass, pages, counts, threads."""

import random

import pytest
from pyspark.sql import functions as F

from almanak.operators import mail as M
from almanak.operators.mailboxes import MailboxError, Mailboxes
from almanak.plans.paging import Cursor, offset_page, page_size, read_window_token, window_token

VIEW = "uid bigint, internal_id string, date_s bigint, thread string, copy_key struct<mid: string, frm: string, subject: string>, seen boolean, flagged boolean"


def greedy(hits, size):
    rows, by_copy, by_thread = [], {}, {}
    for uid, _, _, thread, key, seen, flagged in sorted(hits, key=lambda h: (h[2], h[0]), reverse=True):
        row = by_copy.get(key) if key else None
        if row is not None:
            row["copies"] += 1
        elif (row := by_thread.get(thread)) is not None:
            row["matching"] += 1
        else:
            if len(rows) == size:
                break
            row = {"thread": thread, "uid": uid, "matching": 1, "copies": 0, "unread": False, "starred": False}
            rows.append(row)
            by_thread[thread] = row
        if key:
            by_copy.setdefault(key, row)
        row["unread"] |= not seen
        row["starred"] |= flagged
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_collapse_equals_a_greedy_pass(spark, seed):
    r = random.Random(seed)
    hits = [(n, f"i{n}", r.randrange(30), f"t{r.randrange(12)}", r.choice([None, (f"m{r.randrange(15)}", "a", "b")]), r.random() < 0.5, r.random() < 0.2) for n in range(60)]
    for size in (1, 4, 50):
        got = [r.asDict() for r in M.collapse(spark.createDataFrame(hits, VIEW), size).orderBy("row_no").collect()]
        assert [{k: v for k, v in g.items() if k != "row_no"} for g in got] == greedy(hits, size)


def test_pages_cover_every_hit_once(spark):
    r = random.Random(9)
    hits = [(n, f"i{n}", r.randrange(9), "t", None, True, False) for n in range(45)]
    view = spark.createDataFrame(hits, VIEW).cache()
    for newest in (True, False):
        cursor, seen = None, []
        for _ in range(9):
            page = M.search_page(view, 7, newest, cursor)
            rows = page.collect()
            if not rows:
                assert M.next_cursor(page, newest) is None
                break
            assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
            seen += [p.uid for p in rows]
            cursor = Cursor.read(M.next_cursor(page, newest).token())
            assert (cursor.date_s, cursor.uid) == (rows[-1].date_s, rows[-1].uid)
        assert seen == [h[0] for h in sorted(hits, key=lambda h: (h[2], h[0]), reverse=newest)]


def test_tokens():
    assert read_window_token(window_token(5, 10, 20)) == (5, 10, 20) and page_size("mail", 999) == 50 and page_size("mail", None) == 20 and page_size("tree", 0) == 1
    for bad in ("", "n.1.2", "x.1.2.3", "n.a.2.3"):
        with pytest.raises(ValueError):
            Cursor.read(bad)
    with pytest.raises(ValueError):
        Cursor(True, 1, 5, 5).after(F.lit(1), F.lit(1), False, 1)
    assert M.size_batches([(1, 5), (2, 5), (3, 1), (4, 99), (5, 1)], 10) == [[1, 2], [3], [4], [5]]


COUNTED = "delivery_no bigint, id string, copy_of struct<mid: string, from_addr: string, subject: string>, sent_s bigint, from_addr string, to_addrs array<string>"


def test_grouped_count(spark):
    rows = [
        (1, "a", ("m1", "x", "s"), 10, "Ann@X.test", ["b@y.test", "B@Y.TEST ", None]), (2, "b", ("m1", "x", "s"), 20, "ann@x.test", []), (3, "c", (None, "x", "s"), None, None, None),
        (4, "d", None, 5, "nodomain", ["c@z.test"]), (5, "e", ("m2", None, "s"), 7, "ann@x.test", ["c@z.test", "d@z.test"]),
    ]
    df = spark.createDataFrame(rows, COUNTED)
    assert {(r.key, r.messages, r.newest_no, r.oldest_no) for r in M.grouped_count(df, "from", "count").collect()} == {("ann@x.test", 2, 2, 5), ("(none)", 1, 3, 3), ("nodomain", 1, 4, 4)}
    assert {(r.key, r.messages) for r in M.grouped_count(df, "toDomain", "newest").collect()} == {("(none)", 2), ("z.test", 2)}
    assert [r.key for r in M.grouped_count(df, "from", "oldest").collect()] == ["(none)", "nodomain", "ann@x.test"]
    assert M.grouped_count(df.limit(0), "to", "count").collect() == []


def test_thread_pages(spark):
    rows = [(n, f"i{n}", n, "t", ("m", "a", "b") if n in (2, 4) else None, True, False) for n in range(60)]
    got = {r.uid: (r.copies, r.pos) for r in M.thread_messages(spark.createDataFrame(rows, VIEW)).collect()}
    assert len(got) == 50 and min(got) == 10
    few = {r.uid: (r.copies, r.pos) for r in M.thread_messages(spark.createDataFrame(rows[:6], VIEW)).collect()}
    assert few == {0: (0, 1), 1: (0, 2), 2: (1, 3), 3: (0, 4), 5: (0, 5)}
    pages = spark.createDataFrame([("t", n, 600) for n in range(5)] + [("u", 0, 9999), ("u", 1, 1)], "thread string, pos bigint, chars bigint")
    assert sorted((r.thread, r.pos) for r in M.character_pages(pages, "thread", "pos", F.col("chars"), 1000).collect()) == [("t", 0), ("t", 1), ("u", 0)]


def test_all_pages_of_a_thread(spark):
    rows = spark.createDataFrame([(n, 700) for n in range(1, 6)], "pos bigint, chars bigint")
    start, seen = 0, []
    while start is not None:
        page, start = M.thread_page(rows, "pos", F.col("chars"), start, 1000)
        seen.append([r.pos for r in page.orderBy("pos").collect()])
    assert seen == [[1, 2], [3, 4], [5]]
    assert M.thread_page(rows, "pos", F.col("chars"), 5, 1000)[0].collect() == []
    with pytest.raises(ValueError, match="past"):
        M.thread_page(rows, "pos", F.col("chars"), 6, 1000)


def test_text_page_past_the_end(spark):
    from almanak.plans.paging import character_page

    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string")
    assert [tuple(r) for r in df.select(*character_page(F.col("t"), 3, 2, strict=False)).collect()] == [("de", 5, 6), ("", None, 3), (None, None, None)]
    one = spark.createDataFrame([("abcdef",)], "t string")
    assert one.select(character_page(F.col("t"), 6)[0]).collect()[0][0] == ""
    with pytest.raises(Exception, match="past the end"):
        one.select(character_page(F.col("t"), 7)[0]).collect()


def boxes(spark, extra=()):
    listing = [("INBOX", "inbox", True), ("All", "all", True), ("Bin", "trash", True), ("Junk", "spam", True), ("Stars", "starred", True), ("Labels", None, False), ("Labels/Trips", None, True), ("Folders/Bills", None, True), *extra]
    within = [("All", "abcd"), ("INBOX", "a"), ("Bin", "b"), ("Junk", "c"), ("Stars", "bd"), ("Labels/Trips", "abc"), ("Folders/Bills", "d")]
    return Mailboxes(spark.createDataFrame(listing, "mailbox string, role string, selectable boolean"), spark.createDataFrame([(m, x) for m, ids in within for x in ids], "mailbox string, internal_id string"))


def test_scopes(spark):
    from datetime import date

    from almanak.plans.querylang import parse

    messages = spark.createDataFrame([(n, x, ["Flagged"] if x in "bd" else [], ["cy@far.test"] if x == "d" else None) for n, x in enumerate("abcd", 1)], "msg_no bigint, internal_id string, flags array<string>, cc_addrs array<string>")
    for c, t in (("message_id", "string"), ("from_addr", "string"), ("to_addrs", "array<string>"), ("subject", "string"), ("internaldate", "timestamp"), ("thread_id", "string"), ("content_type", "string")):
        messages = messages.withColumn(c, F.lit(None).cast(t))
    view, b = M.message_view(messages), boxes(spark)
    ids = lambda q, **how: "".join(sorted(r.internal_id for r in M.search(view, parse(q, date(2026, 1, 1)), b, **how).collect()))
    assert ids("") == ids("in:anywhere") == ids("in:all") == "ad" and ids("", include_trash=True) == "abcd"
    assert ids("in:trash") == "b" and ids("in:spam") == "c" and ids("in:starred") == "d" and ids("in:starred", include_trash=True) == "bd" and ids("in:inbox") == "a"
    assert ids("label:trips") == ids("label:LABELS/Trips") == "a" and ids("label:Bills") == "d" and ids("cc:CY@") == "d" and ids("bcc:x") == ""
    total = lambda q: M.estimated_total(view, parse(q, date(2026, 1, 1)), b).collect()[0][0]
    assert (total(""), total("label:trips"), total("in:starred"), total("has:attachment")) == (2, 3, 2, None)
    for bad in ("label:nowhere", "label:Labels", "in:sent"):
        with pytest.raises(MailboxError):
            ids(bad)
    twice = boxes(spark, [("Labels/Bills", None, True)])
    with pytest.raises(MailboxError, match="label:Folders/Bills or label:Labels/Bills"):
        twice.of(parse("label:bills", date(2026, 1, 1)))
    assert twice.of(parse("label:folders/bills", date(2026, 1, 1))) == "Folders/Bills"


def test_words_are_looked_for_in_parts(spark):
    from datetime import date

    from almanak.plans.querylang import parse

    view = spark.createDataFrame([(1, "ann", "Plan"), (2, "bob", None), (3, None, None)], "uid bigint, from_addr string, subject string")
    view = view.withColumns({"to_addrs": F.array().cast("array<string>"), "cc_addrs": F.array().cast("array<string>"), "bcc_addrs": F.array().cast("array<string>"), "sent": F.lit(None).cast("timestamp"), "seen": F.lit(True), "flagged": F.lit(False), "attachments": F.lit(0)})
    parts = spark.createDataFrame([(1, "The KILN is hot."), (1, None), (2, "plan of the kiln"), (2, "and more"), (9, "kiln")], "msg_no bigint, text string")
    uids = lambda q: sorted(r.uid for r in M.search(view, parse(q, date(2026, 1, 1)), parts=parts).collect())
    assert uids("kiln") == [1, 2] and uids("kiln plan") == [1, 2] and uids("-kiln") == [3] and uids("more OR from:ann") == [1, 2] and uids('"kiln and"') == [] and uids("kiln -more") == [1]


def test_result_rows(spark):
    view = spark.createDataFrame([(1, 5, "I" * 30, "t", "Ann\u200b <a@x.test>", ["1", "2", "3", "4", "5"], [], "S\u202e", True, False, 2), (2, 6, "J" * 30, "u", None, None, ["c"], None, False, True, 0)], "uid bigint, date_s bigint, internal_id string, thread string, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, seen boolean, flagged boolean, attachments int")
    a, b = M.result_rows(view).orderBy("uid").collect()
    assert (a.message_id, a["from"], a.to, a.to_more, a.cc, a.cc_more, a.subject, a.unread, a.hidden) == ("I" * 16, "Ann <a@x.test>", ["1", "2", "3"], 2, None, None, "S", False, 2)
    assert (b.to, b.to_more, b.cc, b.cc_more, b.subject, b.unread, b.starred, b.hidden) == (None, None, ["c"], None, None, True, True, 0)
    assert M.hidden_sum(M.result_rows(view)).collect()[0][0] == 2 and M.hidden_sum(M.result_rows(view.limit(0))).collect()[0][0] == 0


def test_offset_pages(spark):
    df = spark.range(10)
    assert [r.id for r in offset_page(df, [F.col("id")], 8, 5).collect()] == [8, 9] and offset_page(df, [F.col("id")], 50, 5).collect() == []


def test_dates_reach_the_scan(spark, data):
    from datetime import date

    from almanak.plans.querylang import parse
    from almanak.session import table

    view = M.message_view(table(spark, data, "messages"))
    plan = M.search(view, parse("after:2026-01-01 before:2026-03-01", date(2026, 6, 1))).select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(internaldate" in plan and "Or(LessThan(int" in plan


def test_one_message_and_its_attachment(spark):
    a = "name: string, content: binary"
    df = spark.createDataFrame([("A" * 20, [("x/ré\x07port.pdf", b"%PDF-1.7")]), ("A" * 16 + "B", None), ("C" * 30, [])], f"internal_id string, attachments array<struct<{a}>>")
    got = M.attachment(df, "A" * 17, 0).collect()[0]
    assert (got.name, got.type, got["size"], got.content) == ("0-réport.pdf", "application/pdf", 8, "JVBERi0xLjc=")
    assert M.attachment(df, "C" * 16, 0).collect() == []
    for bad in ("A" * 16, "D" * 16, "A" * 5):
        with pytest.raises(ValueError):
            M.message_by_id(df, bad)


def test_names_and_pages(spark):
    from almanak.functions import text as T

    df = spark.createDataFrame([("a\n\fb\f", ".."), ("", "a/b"), ("x", "ok")], "t string, n string")
    assert [(r[0], r[1], r[2]) for r in df.select(T.pages(F.col("t")), T.page_starts(T.pages(F.col("t"))), T.one_name(F.col("n"))).collect()] == [(["a", "b"], [0, 2], None), ([""], [0], None), (["x"], [0], "ok")]
    assert [r[0] for r in spark.createDataFrame([("a" * 22 + "~" + "b" * 88,), ("a~b",)], "s string").select(T.uid_shaped(F.col("s"))).collect()] == [True, False]
