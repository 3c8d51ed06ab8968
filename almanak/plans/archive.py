"""Queries over the archive's own operators, each with its SQL: name -> (plan, SQL or None)."""

from __future__ import annotations

from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import text as T
from almanak.functions import zones as Z
from almanak.operators import calendar as C
from almanak.operators import drive as D
from almanak.operators import mail as M
from almanak.operators import mailboxes
from almanak.operators.mailboxes import Mailboxes
from almanak.plans import querylang
from almanak.plans.paging import Cursor, TreePlace, character_page, window_token
from almanak.session import table
from almanak.sources import lenient
from almanak.streaming.counts import domain_counts

TODAY = date(2026, 6, 1)

_VIEW = """v AS (SELECT msg_no AS uid, internal_id, coalesce(epoch(internaldate)::BIGINT, 0) AS date_s, from_addr, to_addrs, subject, content_type,
  coalesce(list_contains(flags, 'Seen'), false) AS seen, coalesce(list_contains(flags, 'Flagged'), false) AS flagged, coalesce(thread_id, internal_id) AS thread,
  nullif(trim(message_id), '') AS mid FROM messages)"""
_BODY = """t AS (SELECT v.*, concat_ws(chr(10), from_addr, array_to_string(to_addrs, ', '), subject) AS headers FROM v)"""


def _view(s: SparkSession, d: str, body: bool = False) -> DataFrame:
    return M.message_view(table(s, d, "messages"), table(s, d, "parts") if body else None)


def _lang(text: str, body: bool = False):
    return lambda s, d: M.search(_view(s, d), querylang.parse(text, TODAY), parts=table(s, d, "parts") if body else None).select("uid", "date_s")


def _lang_sql(where: str) -> str:
    return f"WITH {_VIEW}, {_BODY} SELECT uid, date_s FROM t WHERE {where}"


_FROM = "coalesce(contains(lower(from_addr), '{}'), false)"
_SUBJECT = "coalesce(contains(lower(subject), '{}'), false)"
_EVERY = "(coalesce(contains(lower(headers), '{0}'), false) OR uid IN (SELECT msg_no FROM parts WHERE contains(lower(text), '{0}')))"

_KEPT = """m AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN copy_of.mid IS NOT NULL THEN copy_of END,
  CASE WHEN copy_of.mid IS NULL THEN delivery_no END ORDER BY coalesce(sent_s, -4611686018427387904) DESC, delivery_no DESC) AS n FROM counted) WHERE n = 1)"""


def _groups_sql(by: str, order: str) -> str:
    source = "[from_addr]" if by.startswith("from") else "to_addrs"
    key = "regexp_extract(lower(trim(a)), '[^@]*$')" if by.endswith("Domain") else "lower(trim(a))"
    orders = {"count": "messages DESC, newest_s DESC, key", "newest": "newest_s DESC, key", "oldest": "oldest_s, key"}
    return f"""WITH {_KEPT}, e AS (SELECT delivery_no, coalesce(sent_s, 0) AS date_s, list_distinct(list_transform(list_filter(coalesce({source}, []), lambda a: a IS NOT NULL AND trim(a) <> ''), lambda a: {key})) AS keys FROM m),
 x AS (SELECT date_s, delivery_no, unnest(CASE WHEN len(keys) > 0 THEN keys ELSE ['(none)'] END) AS key FROM e),
 g AS (SELECT key, count(*) AS messages, max(row(date_s, delivery_no)) AS n, min(row(date_s, delivery_no)) AS o FROM x GROUP BY key),
 f AS (SELECT key, messages, n[1] AS newest_s, n[2] AS newest_no, o[1] AS oldest_s, o[2] AS oldest_no FROM g)
 SELECT * FROM f ORDER BY {orders[order]} LIMIT 100"""


def _groups(by: str, order: str):
    return (lambda s, d: M.grouped_count(table(s, d, "counted"), by, order), _groups_sql(by, order))


def _page(newest: bool, cursor: Cursor | None = None, validity: int = 1):
    return lambda s, d: M.search_page(_view(s, d), 50, newest, cursor, validity).select("row_no", "uid", "date_s", "subject")


def _page_sql(newest: bool, where: str = "true") -> str:
    way = "DESC" if newest else "ASC"
    return f"WITH {_VIEW} SELECT row_number() OVER (ORDER BY date_s {way}, uid {way}) AS row_no, uid, date_s, subject FROM v WHERE {where} ORDER BY date_s {way}, uid {way} LIMIT 50"


_COLLAPSE_SQL = f"""WITH {_VIEW}, k AS (SELECT *, CASE WHEN mid IS NOT NULL THEN row(mid, coalesce(from_addr, ''), coalesce(subject, '')) END AS ck, CASE WHEN mid IS NULL THEN uid END AS alone FROM v),
 p AS (SELECT *, first_value(thread) OVER w AS rep, row_number() OVER w = 1 AS is_first FROM k WINDOW w AS (PARTITION BY ck, alone ORDER BY date_s DESC, uid DESC)),
 o AS (SELECT rep, max(row(date_s, uid)) AS op FROM p GROUP BY rep), r AS (SELECT *, row_number() OVER (ORDER BY op DESC) AS row_no FROM o), cut AS (SELECT max(op) AS c FROM r WHERE row_no = 51)
 SELECT row_no, rep AS thread, max(op[2]) AS uid, count(*) FILTER (WHERE is_first) AS matching, count(*) FILTER (WHERE NOT is_first) AS copies, bool_or(NOT seen) AS unread, bool_or(flagged) AS starred
 FROM p JOIN r USING (rep), cut WHERE row_no <= 50 AND (c IS NULL OR row(date_s, uid) > c) GROUP BY row_no, rep"""


def _boxes(s: SparkSession, d: str) -> Mailboxes:
    """Mailboxes by what messages are: HTML ones lie in Trash, those without a subject in Spam, each in the label of its sender's domain, answered ones also in a folder of that name."""
    m = table(s, d, "messages").withColumn("domain", T.domain(T.bare_address(F.col("from_addr"))))
    flag = lambda name: F.coalesce(F.array_contains("flags", name), F.lit(False))
    names = [
        F.lit("All Mail"), F.when(~flag("Answered"), "INBOX"), F.when(flag("Flagged"), "Starred"), F.when(F.col("content_type") == "text/html", "Trash"), F.when(F.col("subject").isNull(), "Spam"),
        F.concat(F.lit("Labels/"), "domain"), F.when(flag("Answered") & F.col("domain").endswith(".test"), F.concat(F.lit("Folders/"), "domain")),
    ]
    membership = m.select("internal_id", F.explode(F.array_compact(F.array(*names))).alias("mailbox"))
    roles = {"All Mail": "all", "INBOX": "inbox", "Starred": "starred", "Trash": "trash", "Spam": "spam", "Drafts": "drafts", "Sent": "sent", "Archive": "archive"}
    system = s.createDataFrame([(name, role, True) for name, role in roles.items()] + [("Labels", None, False), ("Folders", None, False)], "mailbox string, role string, selectable boolean")
    named = membership.filter("mailbox like 'Labels/%' or mailbox like 'Folders/%'").select("mailbox", F.lit(None).cast("string").alias("role"), F.lit(True).alias("selectable")).distinct()
    return Mailboxes(system.unionByName(named), membership)


_BOXES = """x AS (SELECT internal_id, nullif(regexp_extract(lower(trim(CASE WHEN regexp_matches(from_addr, '<[^<>]+>\\s*$') THEN regexp_extract(from_addr, '<([^<>]*)>\\s*$', 1) ELSE from_addr END)), '[^@]*$'), '') AS domain, flags, content_type, subject FROM messages),
 mm AS (SELECT internal_id, 'All Mail' AS mailbox FROM x UNION ALL SELECT internal_id, 'INBOX' FROM x WHERE NOT coalesce(list_contains(flags, 'Answered'), false) UNION ALL SELECT internal_id, 'Starred' FROM x WHERE list_contains(flags, 'Flagged')
  UNION ALL SELECT internal_id, 'Trash' FROM x WHERE content_type = 'text/html' UNION ALL SELECT internal_id, 'Spam' FROM x WHERE subject IS NULL UNION ALL SELECT internal_id, 'Labels/' || domain FROM x WHERE domain IS NOT NULL
  UNION ALL SELECT internal_id, 'Folders/' || domain FROM x WHERE list_contains(flags, 'Answered') AND ends_with(domain, '.test')),
 mb AS (SELECT DISTINCT mailbox FROM mm WHERE mailbox LIKE 'Labels/%' OR mailbox LIKE 'Folders/%' UNION ALL SELECT unnest(['All Mail', 'INBOX', 'Starred', 'Trash', 'Spam', 'Drafts', 'Sent', 'Archive', 'Labels', 'Folders']))"""
_NO_TRASH = "internal_id NOT IN (SELECT internal_id FROM mm WHERE mailbox IN ('Trash', 'Spam'))"


def _scoped(text: str, **how):
    return lambda s, d: M.search(_view(s, d), querylang.parse(text, TODAY), _boxes(s, d), **how).select("uid", "date_s")


def _scoped_sql(mailbox: str, where: str = "true") -> str:
    return f"WITH {_VIEW}, {_BOXES} SELECT uid, date_s FROM v WHERE internal_id IN (SELECT internal_id FROM mm WHERE mailbox = '{mailbox}') AND {where}"


# six messages of one account, two of them copies of one, one also in Trash
_FEW = [
    (1, "K" * 20, "<k1@post.test>", "Lena <lena@post.test>", "Boat hire", "2026-04-02 08:00:00", []), (2, "L" * 20, "<k2@post.test>", "Omar <omar@quay.test>", "Re: Boat hire", "2026-04-02 09:30:00", ["Seen"]),
    (3, "M" * 20, "<k1@post.test>", "Lena <lena@post.test>", "Boat hire", "2026-04-03 07:00:00", ["Seen"]), (4, "N" * 20, "<k3@post.test>", "Pia <pia@quay.test>", "Keys", "2026-04-04 10:00:00", ["Seen", "Flagged"]),
    (5, "O" * 20, "<k4@post.test>", "Rui <rui@far.test>", "Prize draw", "2026-04-05 06:00:00", []), (6, "P" * 20, "<k5@post.test>", "Sam <sam@far.test>", "Old plan", "2026-04-06 11:00:00", ["Seen", "Flagged"]),
]
_FEW_IN = {"INBOX": "KN", "Starred": "NP", "Trash": "P", "Spam": "O", "All Mail": "KLMNOP", "Labels/Boats": "KLP", "Labels/Old": "P", "Folders/Keys": "N", "Labels/keys": "N"}
_FEW_ASKED = ["", "in:anywhere", "in:inbox", "in:starred", "in:trash", "label:boats", "label:Old", "label:folders/KEYS", "in:all is:unread", "boat -from:omar"]


def _few(s: SparkSession, d: str) -> DataFrame:
    """What each search finds in a small account, with its place in the result."""
    m = s.createDataFrame([(*x[:5], datetime.fromisoformat(x[5] + "+00:00"), x[6]) for x in _FEW], "msg_no bigint, internal_id string, message_id string, from_addr string, subject string, internaldate timestamp, flags array<string>")
    view = M.message_view(m.withColumn("to_addrs", F.array().cast("array<string>")).withColumn("thread_id", F.lit(None).cast("string")).withColumn("content_type", F.lit("text/plain")))
    roles = {"INBOX": "inbox", "Starred": "starred", "Trash": "trash", "Spam": "spam", "All Mail": "all"}
    boxes = Mailboxes(s.createDataFrame([(n, roles.get(n), True) for n in _FEW_IN], "mailbox string, role string, selectable boolean"), s.createDataFrame([(n, x * 20) for n, ids in _FEW_IN.items() for x in ids], "mailbox string, internal_id string"))
    pages = [M.search_page(M.search(view, querylang.parse(q, TODAY), boxes), 5).select(F.lit(q).alias("asked"), "row_no", "uid") for q in _FEW_ASKED]
    return reduce(DataFrame.unionByName, pages)


_FEW_FOUND = {"": [4, 3, 2, 1], "in:anywhere": [4, 3, 2, 1], "in:inbox": [4, 1], "in:starred": [4], "in:trash": [6], "label:boats": [2, 1], "label:Old": [], "label:folders/KEYS": [4], "in:all is:unread": [1], "boat -from:omar": [3, 1]}


def _values(rows: list[tuple], names: list[str]) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def _chars(s: SparkSession, d: str) -> DataFrame:
    size = table(s, d, "parts").groupBy(F.col("msg_no").alias("uid")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    rows = M.thread_messages(_view(s, d)).join(size, "uid", "left").fillna(0, ["chars"])
    return M.character_pages(rows, "thread", "pos", F.col("chars"), 2000).select("thread", "pos", "uid", "chars", "chars_before")


_THREADS_SQL = f"""WITH {_VIEW}, k AS (SELECT *, CASE WHEN mid IS NOT NULL THEN row(mid, coalesce(from_addr, ''), coalesce(subject, '')) END AS ck, CASE WHEN mid IS NULL THEN uid END AS alone FROM v),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY uid DESC) AS n FROM k) WHERE n <= 50),
 c AS (SELECT *, count(*) OVER (PARTITION BY thread, ck, alone) - 1 AS copies, row_number() OVER (PARTITION BY thread, ck, alone ORDER BY date_s, uid) AS r FROM l),
 th AS (SELECT thread, uid, copies, row_number() OVER (PARTITION BY thread ORDER BY date_s, uid) AS pos FROM c WHERE r = 1)"""


def _second_chars(s: SparkSession, d: str) -> DataFrame:
    """The second page of each thread that has one: it begins where the first ends."""
    size = table(s, d, "parts").groupBy(F.col("msg_no").alias("uid")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    rows = M.thread_messages(_view(s, d)).join(size, "uid", "left").fillna(0, ["chars"]).select("thread", "pos", "uid", "chars")
    ends = M.character_pages(rows, "thread", "pos", F.col("chars"), 2000).groupBy("thread").agg(F.count("*").alias("start"))
    return M.character_pages(rows.join(ends, "thread"), "thread", "pos", F.col("chars"), 2000, F.col("start")).select("thread", "pos", "uid", "chars", "chars_before")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """The drive: documents as files in their folders, and the folders."""
    docs = table(s, d, "documents").filter("folder is not null")
    files = docs.select(F.concat("folder", F.lit("/"), F.coalesce("title", F.lit("untitled")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("file").alias("kind"), F.coalesce("n_chars", F.lit(0).cast("bigint")).alias("size"), F.col("modified_at").cast("timestamp_ntz").alias("modified"))
    folders = docs.select(F.col("folder").alias("path")).distinct().select("path", F.lit("folder").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp_ntz").alias("modified"))
    e = files.unionByName(folders)
    return e.withColumn("name", D.name(F.col("path"))).withColumn("key", T.folded("name")).withColumn("path_key", T.folded("path"))


_ENTRIES = """f AS (SELECT folder || '/' || coalesce(title, 'untitled') || '-' || doc_id || '.txt' AS path, 'file' AS kind, coalesce(n_chars, 0) AS size, modified_at::TIMESTAMP AS modified FROM documents WHERE folder IS NOT NULL
  UNION ALL SELECT DISTINCT folder, 'folder', 0, NULL FROM documents WHERE folder IS NOT NULL),
 e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS key, lower(path) AS path_key FROM f)"""


_TREE_SQL = f"""WITH {_ENTRIES}, z AS (SELECT *, list_filter(string_split(regexp_extract(path_key, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') AS a, list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') AS b, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM e),
 t AS (SELECT path, folder, a, row_number() OVER (ORDER BY list_zip(a, b), key, path) AS n, row_number() OVER (PARTITION BY folder ORDER BY key, path) AS k FROM z) SELECT n AS row_no, path, folder FROM t"""


def _search_entries(**how):
    return lambda s, d: D.search_entries(_entries(s, d), **how).select("path", "kind", "size")


def _listings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(s, d, "part").select(F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("key"), F.col("p_partkey").alias("id"), "p_retailprice")
    return p.filter("p_retailprice < 1500").select("key", "name", F.col("id").alias("local_id")), p.filter("p_retailprice > 1200").select("key", "name", F.col("id").alias("remote_id"))


_RECONCILE_SQL = """WITH p AS (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, lower(concat_ws(' ', p_name, p_brand, p_type)) AS key, p_partkey AS id, p_retailprice AS price FROM part),
 l AS (SELECT key, name, id AS local_id, row_number() OVER (PARTITION BY key ORDER BY name, id) AS rk, row_number() OVER (PARTITION BY key, name ORDER BY id) AS xr FROM p WHERE price < 1500),
 r AS (SELECT key, name, id AS remote_id, count(*) OVER (PARTITION BY key) AS nr, count(*) OVER (PARTITION BY key, name) AS nx FROM p WHERE price > 1200),
 m AS (SELECT l.key, local_id, coalesce((SELECT max(remote_id) FROM r WHERE r.key = l.key AND nr = 1 AND rk = 1), (SELECT max(remote_id) FROM r WHERE r.key = l.key AND r.name = l.name AND nr > 1 AND nx = 1 AND xr = 1)) AS remote_id, (SELECT max(nr) FROM r WHERE r.key = l.key) AS nr FROM l)
 SELECT key, local_id, remote_id, CASE WHEN remote_id IS NOT NULL THEN 'matched' WHEN nr > 1 THEN 'ambiguous' ELSE 'only local' END AS why FROM m
 UNION ALL SELECT key, NULL, remote_id, 'only remote' FROM r WHERE remote_id NOT IN (SELECT remote_id FROM m WHERE remote_id IS NOT NULL)"""


def _occurrences(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("start"), F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts").cast("timestamp_ntz")).alias("end"))


_OCC = "o AS (SELECT event_id, ts AS start, ts + to_minutes(floor(value)::BIGINT) AS \"end\" FROM events)"


def _window(s: SparkSession, d: str, a: str, b: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return _occurrences(s, d).filter(C.overlaps(F.col("start"), F.col("end"), at(a), at(b))).select("event_id", "start", "end")


def _series(s: SparkSession, d: str) -> DataFrame:
    freq = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DAILY").when(F.col("o_orderpriority") == "3-MEDIUM", "WEEKLY").otherwise("MONTHLY")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"), freq.alias("freq"))


_SERIES = """s AS (SELECT o_orderkey AS key, o_orderdate::TIMESTAMP AS start, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DAILY' WHEN o_orderpriority = '3-MEDIUM' THEN 'WEEKLY' ELSE 'MONTHLY' END AS freq FROM orders)"""
_STARTS = """x AS (SELECT key, start + to_days(CASE freq WHEN 'DAILY' THEN 1 ELSE 7 END * k::INTEGER) AS start FROM s, range(4) AS r(k) WHERE freq <> 'MONTHLY'
  UNION ALL SELECT key, moment FROM (SELECT key, start + to_months(k::INTEGER) AS moment, row_number() OVER (PARTITION BY key ORDER BY k) AS n FROM s, range(25) AS r(k) WHERE freq = 'MONTHLY' AND day(start + to_months(k::INTEGER)) = day(start)) WHERE n <= 4)"""


_TIMES = "array<timestamp_ntz>"


def _ruled(s: SparkSession, d: str, rule: Column, rdates: Column | None = None, exdates: DataFrame | None = None, hours: int = 0, zone: str = "UTC") -> DataFrame:
    """``key``, ``start`` of a series for each order: its rule, extra dates and exceptions."""
    none = F.array().cast(_TIMES)
    rows = _series(s, d).withColumn("start", F.timestamp_add("HOUR", F.lit(hours), "start"))
    rows = rows.withColumn("exdates", none) if exdates is None else rows.join(exdates, "key", "left").withColumn("exdates", F.coalesce("exdates", none))
    return C.expand(rows.select("key", "start", rule.alias("rrule"), (none if rdates is None else rdates).alias("rdates"), "exdates", F.lit(0).cast("bigint").alias("length_s"), F.lit(zone).alias("zone")), datetime(2100, 1, 1))


def _starts(s: SparkSession, d: str) -> DataFrame:
    return _ruled(s, d, F.concat(F.lit("FREQ="), "freq", F.lit(";COUNT=4")))


def _ships(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set(F.col("l_shipdate").cast("timestamp_ntz")).alias("exdates"))


def _later(unit: str, n: int) -> Column:
    return F.timestamp_add(unit, F.lit(n), F.col("start"))


def _single_events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vevents").withColumnRenamed("feed_no", "feed")


# window of UTC times that the registered queries look at
_FROM_UTC, _UNTIL_UTC = datetime(2026, 2, 1), datetime(2026, 2, 15)
_WHEN = """e AS (SELECT *, epoch_us(starts.wall AT TIME ZONE coalesce(starts.tz, 'UTC')) AS b, epoch_us(ends.wall AT TIME ZONE coalesce(ends.tz, 'UTC')) AS x,
  regexp_extract(upper(trim(coalesce(duration, ''))), '^\\+?P(?:(\\d+)W|(?:(\\d+)D)?(?:T(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?)?)$', ['w', 'd', 'h', 'm', 's']) AS p FROM vevents WHERE starts.wall IS NOT NULL AND NOT coalesce(lower(trim(status)) = 'cancelled', false)),
 l AS (SELECT *, nullif(((coalesce(try_cast(p.w AS BIGINT), 0) * 7 + coalesce(try_cast(p.d AS BIGINT), 0)) * 24 + coalesce(try_cast(p.h AS BIGINT), 0)) * 3600 + coalesce(try_cast(p.m AS BIGINT), 0) * 60 + coalesce(try_cast(p.s AS BIGINT), 0), 0) AS dur FROM e),
 o AS (SELECT feed_no AS feed, event_no, uid, uid AS id, b AS start_us, CASE WHEN starts.kind = 'date' THEN epoch_us((starts.wall + CASE WHEN x > b THEN ends.wall - starts.wall ELSE to_seconds(coalesce(dur, 86400)) END) AT TIME ZONE coalesce(starts.tz, 'UTC')) WHEN x > b THEN x ELSE b + coalesce(dur, 0) * 1000000 END AS end_us, starts.kind = 'date' AS whole_day FROM l),
 w AS (SELECT * FROM o WHERE start_us < epoch_us(TIMESTAMP '2026-02-15') AND (end_us > epoch_us(TIMESTAMP '2026-02-01') OR (end_us = start_us AND start_us >= epoch_us(TIMESTAMP '2026-02-01'))))"""

# a feed as it is sent: a weekly series with an exception, an extra date, a moved and a cancelled occurrence, a whole day, a floating series, a cancelled event and one without a UID
_FEED = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:rowing
DTSTART;TZID=Europe/Lisbon:20260305T180000
DTEND;TZID=Europe/Lisbon:20260305T193000
RRULE:FREQ=WEEKLY;UNTIL=20260402T170000Z
EXDATE:20260312T180000Z
RDATE;TZID=Europe/Lisbon:20260307T100000
END:VEVENT
BEGIN:VEVENT
UID:rowing
RECURRENCE-ID:20260319T180000Z
DTSTART;TZID=Europe/Lisbon:20260320T170000
DURATION:PT45M
END:VEVENT
BEGIN:VEVENT
UID:rowing
RECURRENCE-ID;TZID=Europe/Lisbon:20260326T180000
DTSTART;TZID=Europe/Lisbon:20260326T180000
STATUS:CANCELLED
END:VEVENT
BEGIN:VEVENT
UID:regatta
DTSTART;VALUE=DATE:20260328
DTEND;VALUE=DATE:20260330
END:VEVENT
BEGIN:VEVENT
UID:stretch
DTSTART:20260328T070000
RRULE:FREQ=DAILY;COUNT=3
DURATION:PT15M
END:VEVENT
BEGIN:VEVENT
UID:dropped
DTSTART:20260310T120000Z
STATUS:cancelled
END:VEVENT
BEGIN:VEVENT
DTSTART:20260310T120000Z
SUMMARY:nobody knows
END:VEVENT
END:VCALENDAR
"""


def _feed_events(s: SparkSession) -> DataFrame:
    from almanak.sources import ics

    return s.createDataFrame(list(ics.parse(_FEED, "boats")), ics.SCHEMA).filter("not skipped").drop("rdates", "exdates").withColumnsRenamed({"rdates_sent": "rdates", "exdates_sent": "exdates"})


def _feed_window(zone: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = C.expand_window(_feed_events(s), datetime(2026, 3, 1), datetime(2026, 4, 10), zone)
        return C.occurrences_page(rows, 0, 50).select("row_no", "id", Z.rfc3339(F.col("start_us"), F.lit(zone)).alias("start"), Z.rfc3339(F.col("end_us"), F.lit(zone)).alias("end"), "whole_day")

    return run


# clocks go forward on 29 March
_FEED_LISBON = [
    (1, "rowing|20260305T180000Z", "2026-03-05T18:00:00+00:00", "2026-03-05T19:30:00+00:00", False), (2, "rowing|20260307T100000Z", "2026-03-07T10:00:00+00:00", "2026-03-07T11:30:00+00:00", False), (3, "rowing|20260319T180000Z", "2026-03-20T17:00:00+00:00", "2026-03-20T17:45:00+00:00", False),
    (4, "regatta", "2026-03-28T00:00:00+00:00", "2026-03-30T00:00:00+01:00", True), (5, "stretch|20260328T070000", "2026-03-28T07:00:00+00:00", "2026-03-28T07:15:00+00:00", False), (6, "stretch|20260329T070000", "2026-03-29T07:00:00+01:00", "2026-03-29T07:15:00+01:00", False),
    (7, "stretch|20260330T070000", "2026-03-30T07:00:00+01:00", "2026-03-30T07:15:00+01:00", False), (8, "rowing|20260402T170000Z", "2026-04-02T18:00:00+01:00", "2026-04-02T19:30:00+01:00", False),
]


def _overridden(s: SparkSession, d: str) -> DataFrame:
    o = _series(s, d).filter("freq = 'WEEKLY'").select("key", F.timestamp_add("WEEK", F.lit(1), "start").alias("recurrence_start"), F.timestamp_add("HOUR", F.lit(170), "start").alias("start"), F.when(F.dayofmonth("start") > 20, "cancelled").otherwise("confirmed").alias("status"))
    return C.with_overrides(_starts(s, d), o).select("key", "start")


def _file_name() -> Column:
    """A name whose ending goes by the part's size; some have none or one in capitals."""
    endings = ["", *T.MEDIA_TYPES, "xml", "", "PDF"]
    ending = F.coalesce(F.get(F.array(*map(F.lit, endings)), F.col("p_size")), F.lit(""))
    return F.when(ending == "", F.col("p_name")).otherwise(F.concat("p_name", F.lit("."), ending))


def _json(s: SparkSession, d: str) -> DataFrame:
    """Nodes of a listing made of events: some fields of another type than they should have."""
    node = F.concat(F.lit('{"uid": "'), F.col("event_id").cast("string"), F.lit('", "type": "'), "event_type", F.lit('", "activeRevision": {"claimedSize": '), F.when(F.col("value") < 50, F.floor("value").cast("string")).otherwise(F.lit('"much"')), F.lit('}, "name": {"value": "'), "event_type", F.lit('"}}'))
    n = lenient.nodes(F.when(F.col("value") > 95, "broken").otherwise(node))
    return table(s, d, "events").select("event_id", n.alias("n")).select("event_id", *lenient.node_columns(F.col("n"))[:4])


def _clean_rows(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").filter("text is not null").select("doc_id", T.hidden_count(t).cast("bigint").alias("removed"), F.md5(T.clean(t).cast("binary")).alias("cleaned"))


# the same classes in RE2's spelling; a lone variation selector and a lone filler are not in the tables
_HIDDEN_RE2 = "[\\x{AD}\\x{61C}\\x{17B4}-\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}\\x{200E}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{1BCA0}-\\x{1BCA3}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E00FF}\\x{E01F0}-\\x{E0FFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]"


def _text_page(s: SparkSession, d: str) -> DataFrame:
    page, after, total = character_page(F.col("text"), 1000, 500, strict=False)
    return table(s, d, "documents").select("doc_id", page.alias("page"), after.cast("bigint").alias("next_offset"), total.cast("bigint").alias("total"))


def _quotes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "parts").filter("text is not null and content_type = 'text/plain'")
    return p.select("part_no", T.without_quotes("text", F.lit(False)).alias("r")).select("part_no", "r.text", "r.removed")


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """Each part as it reads without quotations, how many lines went, and the snippet of it."""
    m = table(s, d, "messages").select("msg_no", "subject")
    p = table(s, d, "parts").select("part_no", "msg_no", "content_type", "text").join(m, "msg_no", "left")
    p = p.select("part_no", T.readable_body("text", F.coalesce(F.col("content_type") == "text/html", F.lit(False)), "subject").alias("b"))
    return p.select("part_no", F.col("b.removed").alias("removed"), T.snippet(F.col("b.text")).alias("snippet"))


QUERIES_AND_SQL = {
    "count_total_distinct": (
        lambda s, d: M.distinct_messages(table(s, d, "counted")).agg(F.count("*").alias("messages")),
        f"WITH {_KEPT} SELECT count(*) AS messages FROM m",
    ),
    "count_by_from": _groups("from", "count"),
    "count_by_from_domain": _groups("fromDomain", "count"),
    "count_by_to": _groups("to", "count"),
    "count_by_to_domain": _groups("toDomain", "count"),
    "groups_newest": _groups("from", "newest"),
    "groups_oldest": _groups("toDomain", "oldest"),
    "search_page_newest": (_page(True), _page_sql(True)),
    "search_page_oldest": (_page(False), _page_sql(False)),
    "search_resume_cursor": (_page(True, Cursor(True, 1, 1760000000, 300)), _page_sql(True, "date_s < 1760000000 OR (date_s = 1760000000 AND uid < 300)")),
    "search_resume_renumbered": (_page(True, Cursor(True, 7, 1760000000, 300)), _page_sql(True, "date_s <= 1760000000")),
    "thread_collapse_page": (lambda s, d: M.collapse(_view(s, d), 50), _COLLAPSE_SQL),
    "exclude_trash": (_scoped("is:unread"), _scoped_sql("All Mail", "NOT seen AND " + _NO_TRASH)),
    "include_trash": (_scoped("in:anywhere is:unread", include_trash=True), _scoped_sql("All Mail", "NOT seen")),
    "search_starred": (_scoped("in:starred -is:unread"), _scoped_sql("Starred", "seen AND " + _NO_TRASH)),
    "search_inbox": (_scoped("in:inbox is:starred"), _scoped_sql("INBOX", "flagged")),
    "search_label": (_scoped("label:Labels/TARNHUB.example is:unread"), _scoped_sql("Labels/tarnhub.example", "NOT seen AND " + _NO_TRASH)),
    "search_label_unprefixed": (_scoped("label:Tarnhub.Example"), _scoped_sql("Labels/tarnhub.example", _NO_TRASH)),
    "small_account": (_few, _values([(q, k, uid) for q, uids in _FEW_FOUND.items() for k, uid in enumerate(uids, 1)], ["asked", "row_no", "uid"])),
    "estimated_total": (
        lambda s, d: M.estimated_total(_view(s, d), querylang.parse("is:unread", TODAY), _boxes(s, d)),
        f"WITH {_VIEW}, {_BOXES} SELECT count(*) AS estimated_total FROM v WHERE NOT seen AND {_NO_TRASH}",
    ),
    "estimated_total_label": (
        lambda s, d: M.estimated_total(_view(s, d), querylang.parse("label:tarnhub.example", TODAY), _boxes(s, d)),
        f"WITH {_VIEW}, {_BOXES} SELECT count(*) AS estimated_total FROM mm WHERE mailbox = 'Labels/tarnhub.example'",
    ),
    "result_rows": (
        lambda s, d: M.result_rows(M.search_page(_view(s, d), 50)).select("uid", "message_id", "from", "to", "to_more", "cc", "subject", "unread", "starred", "hidden"),
        f"""WITH {_VIEW}, c AS (SELECT *, list_transform(to_addrs, lambda a: regexp_replace(a, '{_HIDDEN_RE2}', '', 'g')) AS ct, regexp_replace(from_addr, '{_HIDDEN_RE2}', '', 'g') AS cf, regexp_replace(subject, '{_HIDDEN_RE2}', '', 'g') AS cs FROM v ORDER BY date_s DESC, uid DESC LIMIT 50)
 SELECT uid, substr(internal_id, 1, 16) AS message_id, cf AS "from", CASE WHEN len(ct) > 0 THEN ct[1:3] END AS "to", CASE WHEN len(ct) > 3 THEN len(ct) - 3 END AS to_more, NULL::VARCHAR[] AS cc, cs AS subject, NOT seen AS unread, flagged AS starred,
 coalesce(length(subject) - length(cs), 0) + coalesce(length(from_addr) - length(cf), 0) + coalesce(length(array_to_string(to_addrs, '')) - length(array_to_string(ct, '')), 0) AS hidden FROM c""",
    ),
    "hidden_sum": (
        lambda s, d: M.hidden_sum(M.result_rows(_view(s, d))),
        f"WITH {_VIEW} SELECT sum(coalesce(length(subject) - length(regexp_replace(subject, '{_HIDDEN_RE2}', '', 'g')), 0) + coalesce(length(from_addr) - length(regexp_replace(from_addr, '{_HIDDEN_RE2}', '', 'g')), 0) + coalesce(length(array_to_string(to_addrs, '')) - length(regexp_replace(array_to_string(to_addrs, ''), '{_HIDDEN_RE2}', '', 'g')), 0))::BIGINT AS hidden FROM v",
    ),
    "groups_total": (lambda s, d: M.groups_total(table(s, d, "counted"), "toDomain"), _groups_sql("toDomain", "count").rsplit("SELECT * FROM f", 1)[0] + "SELECT count(*) AS groups_total FROM f"),
    "thread_members": (
        lambda s, d: M.thread_members(table(s, d, "messages")),
        r"""WITH i AS (SELECT DISTINCT msg_no, unnest(list_filter(string_split_regex(concat_ws(' ', message_id, array_to_string(ref_ids, ' '), in_reply_to), '[\s<>]+'), lambda x: x <> '')) AS root FROM messages),
 k AS (SELECT coalesce(list_filter(string_split_regex(concat_ws(' ', array_to_string(ref_ids, ' '), in_reply_to), '[\s<>]+'), lambda x: x <> '' AND NOT ends_with(x, '@internal.invalid'))[1], trim(translate(message_id, '<>', '  '))) AS root FROM messages),
 r AS (SELECT DISTINCT root FROM k WHERE regexp_matches(root, '^[\x21\x23-\x5B\x5D-\x7E]{1,300}$') AND NOT regexp_matches(root, '[()<>\[\]]')) SELECT root, msg_no FROM i JOIN r USING (root)""",
    ),
    "mailbox_listing": (
        lambda s, d: _boxes(s, d).shown(),
        f"WITH {_BOXES} SELECT mailbox, CASE WHEN mailbox LIKE 'Labels/%' THEN 'label' WHEN mailbox LIKE 'Folders/%' THEN 'folder' ELSE 'system' END AS kind, CASE mailbox WHEN 'All Mail' THEN 'all' WHEN 'INBOX' THEN 'inbox' WHEN 'Starred' THEN 'starred' WHEN 'Trash' THEN 'trash' WHEN 'Spam' THEN 'spam' WHEN 'Drafts' THEN 'drafts' WHEN 'Sent' THEN 'sent' WHEN 'Archive' THEN 'archive' END AS role, mailbox NOT IN ('Labels', 'Folders') AS selectable FROM mb",
    ),
    "lang_words": (_lang("lease survey", True), _lang_sql(_EVERY.format("lease") + " AND " + _EVERY.format("survey"))),
    "lang_phrase": (_lang('"survey map"', True), _lang_sql(_EVERY.format("survey map"))),
    "lang_fields": (_lang("from:ann subject:lease"), _lang_sql(_FROM.format("ann") + " AND " + _SUBJECT.format("lease"))),
    "lang_or": (_lang("from:ann OR from:uwe subject:re"), _lang_sql("(" + _FROM.format("ann") + " OR " + _FROM.format("uwe") + ") AND " + _SUBJECT.format("re"))),
    "lang_not": (_lang("-is:read -from:ann"), _lang_sql("NOT seen AND NOT " + _FROM.format("ann"))),
    "lang_dates": (_lang("after:2026-01-01 before:2026/03/01"), _lang_sql("NOT date_s < epoch(TIMESTAMP '2026-01-01') AND date_s < epoch(TIMESTAMP '2026-03-01')")),
    "lang_relative": (_lang("newer_than:90d -older_than:2m"), _lang_sql("NOT date_s < epoch(TIMESTAMP '2026-03-03') AND NOT date_s < epoch(TIMESTAMP '2026-04-02')")),
    "lang_flags": (_lang("is:unread is:starred"), _lang_sql("NOT seen AND flagged")),
    "has_attachment": (_lang("has:attachment"), _lang_sql("content_type LIKE 'multipart/mixed%'")),
    "not_has_attachment": (_lang("-has:attachment"), _lang_sql("NOT coalesce(content_type LIKE 'multipart/mixed%', false)")),
    "label_counts": (
        lambda s, d: M.label_counts(_boxes(s, d).listing, _boxes(s, d).membership, _view(s, d)).withColumn("kind", mailboxes.kind(F.col("mailbox"))),
        f"WITH {_VIEW}, {_BOXES} SELECT mb.mailbox, count(v.uid) AS messages, count(v.uid) FILTER (WHERE NOT v.seen) AS unread, CASE WHEN mb.mailbox LIKE 'Labels/%' THEN 'label' WHEN mb.mailbox LIKE 'Folders/%' THEN 'folder' ELSE 'system' END AS kind FROM mb LEFT JOIN mm ON mm.mailbox = mb.mailbox LEFT JOIN v ON v.internal_id = mm.internal_id GROUP BY mb.mailbox",
    ),
    "thread_read": (lambda s, d: M.thread_messages(_view(s, d)).select("thread", "uid", "copies", "pos"), _THREADS_SQL + " SELECT thread, uid, copies, pos FROM th"),
    "thread_char_pages": (
        _chars,
        _THREADS_SQL + ", z AS (SELECT msg_no AS uid, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM parts GROUP BY 1), q AS (SELECT thread, pos, uid, coalesce(chars, 0) AS chars FROM th LEFT JOIN z USING (uid)), a AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY thread ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM q) SELECT thread, pos, uid, chars, chars_before FROM a WHERE chars_before < 2000",
    ),
    "thread_char_pages_second": (
        _second_chars,
        _THREADS_SQL + ", z AS (SELECT msg_no AS uid, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM parts GROUP BY 1), q AS (SELECT thread, pos, uid, coalesce(chars, 0) AS chars FROM th LEFT JOIN z USING (uid)), a AS (SELECT *, coalesce(sum(chars) OVER w, 0) AS bf FROM q WINDOW w AS (PARTITION BY thread ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "n AS (SELECT * EXCLUDE (bf) FROM a WHERE bf >= 2000), g AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY thread ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM n) SELECT * FROM g WHERE chars_before < 2000",
    ),
    "thread_keys": (
        lambda s, d: table(s, d, "messages").select("msg_no", T.thread_key(F.col("message_id"), F.col("ref_ids"), F.col("in_reply_to")).alias("root"), T.short_id(F.col("internal_id")).alias("short_id"), T.bare_address(F.col("from_addr")).alias("sender")),
        "SELECT msg_no, coalesce(list_filter(string_split_regex(concat_ws(' ', array_to_string(ref_ids, ' '), in_reply_to), '[\\s<>]+'), lambda x: x <> '')[1], trim(translate(message_id, '<>', '  '))) AS root, substr(internal_id, 1, 16) AS short_id, nullif(lower(trim(CASE WHEN regexp_matches(from_addr, '<[^<>]+>\\s*$') THEN regexp_extract(from_addr, '<([^<>]*)>\\s*$', 1) ELSE from_addr END)), '') AS sender FROM messages",
    ),
    "snippet_200": (
        lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", T.snippet(F.col("text")).alias("snippet")),
        f"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '{_HIDDEN_RE2}', '', 'g'), '\\s+', ' ', 'g')), 1, 200) AS snippet FROM documents WHERE text IS NOT NULL",
    ),
    "clean_hidden": (_clean_rows, f"SELECT doc_id, length(text) - length(regexp_replace(text, '{_HIDDEN_RE2}', '', 'g')) AS removed, md5(regexp_replace(text, '{_HIDDEN_RE2}', '', 'g')) AS cleaned FROM documents WHERE text IS NOT NULL"),
    "text_page_offset": (_text_page, "SELECT doc_id, CASE WHEN length(text) >= 1000 THEN text[1001:1500] END AS page, CASE WHEN length(text) > 1500 THEN 1500 END AS next_offset, length(text) AS total FROM documents"),
    "doc_copies": (
        lambda s, d: table(s, d, "documents").filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), (F.count("*") - 1).alias("copies")),
        "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) - 1 AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    ),
    "doc_terms_all_none": (
        lambda s, d: table(s, d, "documents").filter(C.matches_terms([F.col("text"), F.col("title")], ["lease", "the"], ["kiln"])).select("doc_id"),
        "SELECT doc_id FROM documents WHERE " + " AND ".join(f"(coalesce(contains(lower(text), '{t}'), false) OR coalesce(contains(lower(title), '{t}'), false))" for t in ("lease", "the")) + " AND NOT (coalesce(contains(lower(text), 'kiln'), false) OR coalesce(contains(lower(title), 'kiln'), false))",
    ),
    "digest_docs": (
        lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), D.folder_print(F.coalesce("folder", F.lit("/"))).alias("folder_print")),
        "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha256(coalesce(folder, '/')), 1, 16) AS folder_print FROM documents WHERE text IS NOT NULL",
    ),
    "digest_claim_match": (
        lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", D.digest_matches(F.col("text"), F.when(F.col("lang") == "en", F.upper(F.sha1(F.col("text").cast("binary")))).otherwise(F.sha1(F.lit("x").cast("binary")))).alias("same")),
        "SELECT doc_id, lang = 'en' AND lang IS NOT NULL AS same FROM documents WHERE text IS NOT NULL",
    ),
    "glob_names": (
        lambda s, d: table(s, d, "part").filter(D.name_matches(F.lower("p_name"), "*a?e*")).select("p_partkey", "p_name"),
        "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(lower(p_name), '(?s).*a.e.*')",
    ),
    "substring_names": (lambda s, d: table(s, d, "part").filter(D.name_matches(F.lower("p_name"), "RED")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')"),
    "path_scope_exclude": (
        _search_entries(asked="e", top="/archive", exclude=["/Archive/Lease"]),
        f"WITH {_ENTRIES} SELECT path, kind, size FROM e WHERE contains(key, 'e') AND starts_with(path_key, '/archive/') AND NOT (path_key = '/archive/lease' OR starts_with(path_key, '/archive/lease/')) AND NOT regexp_matches(path, '(^|/)\\.')",
    ),
    "kind_and_modified": (
        _search_entries(asked="*.txt", kind="file", after="2026-01-01", before="2026-07-01"),
        f"WITH {_ENTRIES} SELECT path, kind, size FROM e WHERE ends_with(key, '.txt') AND kind <> 'folder' AND modified >= TIMESTAMP '2026-01-01' AND modified < TIMESTAMP '2026-07-01' AND NOT regexp_matches(path, '(^|/)\\.')",
    ),
    "folder_listing": (
        lambda s, d: D.list_folder(_entries(s, d), "/Archive", ["/archive/lease"], 0, 200).select("row_no", "path", "kind", "size"),
        f"WITH {_ENTRIES} SELECT row_number() OVER (ORDER BY CASE WHEN kind = 'folder' THEN 0 ELSE 1 END, key, path) AS row_no, path, kind, size FROM e WHERE regexp_extract(path_key, '^(.*)/[^/]*$', 1) = '/archive' AND path_key <> '/archive/lease' AND NOT starts_with(name, '.') ORDER BY 1 LIMIT 200",
    ),
    "hidden_names": (
        lambda s, d: D.hidden_names(_entries(s, d), "/Archive"),
        f"WITH {_ENTRIES} SELECT count(*) AS hidden_names FROM e WHERE regexp_extract(path_key, '^(.*)/[^/]*$', 1) = '/archive' AND starts_with(name, '.')",
    ),
    "tree_listing_page": (lambda s, d: D.tree_page(_entries(s, d), 200).select("row_no", "path", "folder"), _TREE_SQL + " WHERE n <= 200"),
    "tree_listing_next_page": (
        lambda s, d: D.tree_page(_entries(s, d), 100, TreePlace("/Archive", 7)).select("row_no", "path", "folder"),
        _TREE_SQL.replace("SELECT n AS row_no", "SELECT row_number() OVER (ORDER BY n) AS row_no") + " WHERE n > (SELECT coalesce(max(n), 0) FROM t WHERE a < ['archive'] OR (folder = '/Archive' AND k <= 7)) ORDER BY n LIMIT 100",
    ),
    "usage": (lambda s, d: D.usage(_entries(s, d)), "SELECT count(*) AS files, coalesce(sum(coalesce(n_chars, 0)), 0)::BIGINT AS bytes FROM documents WHERE folder IS NOT NULL"),
    "entry_list": (
        lambda s, d: D.entry_view(_entries(s, d), {".note": "note"}),
        f"WITH {_ENTRIES} SELECT path, name, kind, CASE WHEN kind <> 'folder' THEN size END AS size, strftime(modified, '%Y-%m-%dT%H:%M:%SZ') AS modified, CASE WHEN ends_with(lower(path), '.note') THEN 'note' END AS stands_for FROM e",
    ),
    "reconcile_listings": (lambda s, d: D.reconcile(*_listings(s, d)), _RECONCILE_SQL),
    "name_collisions": (lambda s, d: D.collisions(table(s, d, "part").select(F.lower("p_name").alias("key"))), "SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1"),
    "mime_types": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.mime_type(_file_name()).alias("type")),
        "SELECT p_partkey, CASE p_size " + " ".join(f"WHEN {k} THEN '{T.MEDIA_TYPES.get(e.lower(), 'application/octet-stream')}'" for k, e in enumerate([*T.MEDIA_TYPES, "xml", "", "PDF"], 1)).replace("'' THEN", "") + " ELSE 'application/octet-stream' END AS type FROM part",
    ),
    "window_overlap": (
        lambda s, d: _window(s, d, "2024-01-10 00:00:00", "2024-01-12 12:00:00"),
        f"WITH {_OCC} SELECT event_id, start, \"end\" FROM o WHERE start < TIMESTAMP '2024-01-12 12:00:00' AND (\"end\" > TIMESTAMP '2024-01-10' OR (\"end\" = start AND start >= TIMESTAMP '2024-01-10'))",
    ),
    "zero_length_overlap": (
        lambda s, d: _occurrences(s, d).withColumn("end", F.col("start")).filter(C.overlaps(F.col("start"), F.col("end"), F.date_trunc("day", "start").cast("timestamp_ntz"), F.col("start"))).select("event_id").unionByName(_occurrences(s, d).withColumn("end", F.col("start")).filter(C.overlaps(F.col("start"), F.col("end"), F.col("start"), F.timestamp_add("SECOND", F.lit(1), "start"))).select("event_id")),
        "SELECT event_id FROM events",
    ),
    "expand_starts": (_starts, f"WITH {_SERIES}, {_STARTS} SELECT key, start FROM x"),
    "expand_rules": (
        lambda s, d: _ruled(s, d, F.concat(F.lit("FREQ="), "freq", F.lit(";COUNT=4")), F.array(_later("DAY", 2), _later("DAY", 400), F.col("start")), _ships(s, d)),
        f"WITH {_SERIES}, {_STARTS}, y AS (SELECT key, start FROM x UNION SELECT key, start + INTERVAL 2 DAY FROM s UNION SELECT key, start + INTERVAL 400 DAY FROM s) SELECT key, start FROM y WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = key AND l_shipdate::TIMESTAMP = start)",
    ),
    "expand_byday_until": (
        lambda s, d: _ruled(s, d, F.concat(F.lit("FREQ=WEEKLY;BYDAY=MO,TH;UNTIL="), F.date_format(_later("DAY", 30), "yyyyMMdd'T'HHmmss"))),
        f"WITH {_SERIES} SELECT key, start + to_days(k::INTEGER) AS start FROM s, range(31) AS r(k) WHERE isodow(start + to_days(k::INTEGER)) IN (1, 4)",
    ),
    "expand_bysetpos": (
        lambda s, d: _ruled(s, d, F.lit("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=3")),
        f"WITH {_SERIES}, m AS (SELECT key, start, last_day(date_trunc('month', start) + to_months(k::INTEGER)) AS l FROM s, range(5) AS r(k)), y AS (SELECT key, start AS first, l - (CASE isodow(l) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END)::INTEGER AS day FROM m), "
        "z AS (SELECT key, day::TIMESTAMP + (first - date_trunc('day', first)) AS start, row_number() OVER (PARTITION BY key ORDER BY day) AS n FROM y WHERE day::TIMESTAMP + (first - date_trunc('day', first)) >= first) SELECT key, start FROM z WHERE n <= 3",
    ),
    "expand_interval": (
        lambda s, d: _ruled(s, d, F.lit("FREQ=WEEKLY;INTERVAL=2;COUNT=3")),
        f"WITH {_SERIES} SELECT key, start + to_days((14 * k)::INTEGER) AS start FROM s, range(3) AS r(k)",
    ),
    "expand_zone_until": (
        lambda s, d: _ruled(s, d, F.concat(F.lit("FREQ=DAILY;UNTIL="), F.date_format(Z.wall_of(Z.local_to_utc_us(Z.wall_us(_later("DAY", 3)), F.lit("America/Los_Angeles")) - 1_000_000), "yyyyMMdd'T'HHmmss'Z'")), hours=1, zone="America/Los_Angeles"),
        f"WITH {_SERIES} SELECT key, start + INTERVAL 1 HOUR + to_days(k::INTEGER) AS start FROM s, range(3) AS r(k)",
    ),
    "feed_window": (_feed_window("Europe/Lisbon"), _values(_FEED_LISBON, ["row_no", "id", "start", '"end"', "whole_day"])),
    "feed_find": (
        lambda s, d: reduce(DataFrame.unionByName, [C.find_event(_feed_events(s), i, "Europe/Lisbon").select("id", "start_us", "end_us") for i in ("rowing|20260319T180000Z", "regatta")]),
        _values([("rowing|20260319T180000Z", 1774026000000000, 1774028700000000), ("regatta", 1774656000000000, 1774825200000000)], ["id", "start_us", "end_us"]),
    ),
    "window_occurrences": (
        lambda s, d: C.expand_window(_single_events(s, d), _FROM_UTC, _UNTIL_UTC).select("feed", "event_no", "id", "start_us", "end_us", "whole_day"),
        f"WITH {_WHEN} SELECT feed, event_no, id, start_us, end_us, whole_day FROM w",
    ),
    "window_occurrences_page": (
        lambda s, d: C.list_events(_single_events(s, d), datetime(1970, 1, 1), datetime(1970, 1, 2), token=window_token(20, int(_FROM_UTC.replace(tzinfo=timezone.utc).timestamp()), int(_UNTIL_UTC.replace(tzinfo=timezone.utc).timestamp())), size=40)[0].select("row_no", "event_no", "start_us"),
        f"WITH {_WHEN} SELECT row_number() OVER (ORDER BY start_us, feed, event_no, id) AS row_no, event_no, start_us FROM w ORDER BY start_us, feed, event_no, id LIMIT 40 OFFSET 20",
    ),
    "window_complete": (lambda s, d: C.expansion_summary(C.expand_window(_single_events(s, d), _FROM_UTC, _UNTIL_UTC), 50), f"WITH {_WHEN} SELECT count(*) AS occurrences, count(*) <= 50 AS complete FROM w"),
    "feeds_fetched": (
        lambda s, d: C.fetched(table(s, d, "vevents"), datetime(2026, 6, 1), 90 * 86400),
        "SELECT feed_no, max(fetched_at) AS fetched_at, coalesce(epoch_us(TIMESTAMP '2026-06-01') - epoch_us(max(fetched_at)) < 90 * 86400 * 1000000::BIGINT, false) AS fresh FROM vevents GROUP BY feed_no",
    ),
    "event_times": (
        lambda s, d: table(s, d, "vevents").filter("starts.wall is not null").select("event_no", Z.rfc3339(C.to_utc_us(F.col("starts.wall"), F.coalesce("starts.tz", F.lit("UTC"))), F.lit("Asia/Kolkata")).alias("at")),
        "SELECT event_no, strftime((starts.wall AT TIME ZONE coalesce(starts.tz, 'UTC')) AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%dT%H:%M:%S') || '+05:30' AS at FROM vevents WHERE starts.wall IS NOT NULL",
    ),
    "expand_override": (
        _overridden,
        f"WITH {_SERIES}, {_STARTS}, v AS (SELECT key, start + INTERVAL 7 DAY AS r, start + INTERVAL 170 HOUR AS moved, day(start) > 20 AS gone FROM s WHERE freq = 'WEEKLY') SELECT key, start FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.key = x.key AND v.r = x.start) UNION ALL SELECT key, moved FROM v WHERE NOT gone",
    ),
    "events_union_sorted_page": (
        lambda s, d: C.events_page(_starts(s, d).select("start", F.lit(1).alias("source"), F.col("key").alias("event_no")).unionByName(_occurrences(s, d).select("start", F.lit(2).alias("source"), F.col("event_id").alias("event_no"))), 100, 250),
        f"WITH {_SERIES}, {_STARTS}, {_OCC} SELECT start, source, event_no FROM (SELECT start, 1 AS source, key AS event_no FROM x UNION ALL SELECT start, 2, event_id FROM o) ORDER BY start, source, event_no LIMIT 250 OFFSET 100",
    ),
    "occurrence_ids": (
        lambda s, d: _starts(s, d).select("key", "start", C.occurrence_id(F.concat(F.lit("order-"), F.col("key").cast("string")), F.col("start"), F.dayofmonth("start") > 15, F.lit(True)).alias("id")),
        f"WITH {_SERIES}, {_STARTS} SELECT key, start, 'order-' || key || '|' || strftime(start, '%Y%m%dT%H%M%S') || CASE WHEN day(start) > 15 THEN 'Z' ELSE '' END AS id FROM x",
    ),
    "local_to_utc": (
        lambda s, d: table(s, d, "vevents").filter("starts.wall is not null").select("event_no", C.to_utc_us(F.col("starts.wall"), F.coalesce("starts.tz", F.lit("UTC"))).alias("utc_us")),
        "SELECT event_no, epoch_us(starts.wall AT TIME ZONE coalesce(starts.tz, 'UTC')) AS utc_us FROM vevents WHERE starts.wall IS NOT NULL",
    ),
    "props_lenient_json": (
        _json,
        "SELECT event_id, CASE WHEN value <= 95 THEN event_id::VARCHAR END AS node_id, CASE WHEN value <= 95 THEN event_type END AS name, CASE WHEN value <= 95 AND contains(lower(event_type), 'folder') THEN 'folder' ELSE 'file' END AS kind, CASE WHEN value < 50 THEN floor(value)::BIGINT ELSE 0 END AS size FROM events",
    ),
    "event_terms": (
        lambda s, d: table(s, d, "vevents").filter(C.matches_terms([F.col("summary"), F.col("description"), F.col("location")], *C.terms('"survey map" -kiln'))).select("event_no"),
        "SELECT event_no FROM vevents WHERE contains(lower(concat_ws(chr(1), summary, description, location)), 'survey map') AND NOT contains(lower(concat_ws(chr(1), summary, description, location)), 'kiln')",
    ),
    "daily_domain_counts": (
        lambda s, d: domain_counts(table(s, d, "counted")),
        None,
    ),
    "quote_strip": (_quotes, None),
    "html_quote_strip": (lambda s, d: table(s, d, "parts").filter("text is not null and content_type = 'text/html'").select("part_no", T.shown_without_quotes("text").alias("text")), None),
    "mail_bodies": (_bodies, None),
    "html_text": (lambda s, d: table(s, d, "parts").filter("text is not null and content_type = 'text/html'").select("part_no", T.shown("text").alias("text")), None),
    "fold_names": (lambda s, d: _entries(s, d).select("path", T.folded("name").alias("folded"), T.unescaped(T.escaped("name")).alias("same")), f"WITH {_ENTRIES} SELECT path, key AS folded, name AS same FROM e"),
    "event_list": (
        lambda s, d: C.event_view(table(s, d, "vevents")).select("event_no", "start", "cut", "status", "shown_as"),
        "SELECT event_no, CASE WHEN starts.kind = 'date' THEN strftime(starts.wall, '%Y-%m-%d') ELSE strftime((starts.wall AT TIME ZONE coalesce(starts.tz, 'UTC')) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS start, "
        f"length(regexp_replace(description, '{_HIDDEN_RE2}', '', 'g')) > 300 AS cut, CASE WHEN status IS NULL THEN NULL WHEN lower(status) IN ('confirmed', 'tentative', 'cancelled') THEN lower(status) ELSE 'other' END AS status, CASE WHEN transparent THEN 'free' ELSE 'busy' END AS shown_as FROM vevents",
    ),
    "page_starts": (
        lambda s, d: table(s, d, "documents").filter(F.contains("text", F.lit("\f"))).select("doc_id", T.page_starts(T.pages(F.col("text"))).alias("starts")).select("doc_id", F.posexplode("starts").alias("page", "start")),
        "WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\x0C$', ''), chr(12)), lambda x: regexp_replace(x, '\\n+$', '')) AS parts FROM documents WHERE contains(text, chr(12))), x AS (SELECT doc_id, parts, unnest(range(len(parts))) AS page FROM p) "
        "SELECT doc_id, page::INTEGER AS page, coalesce(list_sum(list_transform(parts[1:page], lambda x: length(x) + 1)), 0)::INTEGER AS start FROM x",
    ),
    "uri_paths": (lambda s, d: _entries(s, d).select("path", T.uri_path(F.col("path")).alias("uri")), f"WITH {_ENTRIES} SELECT path, replace(url_encode(path), '%2F', '/') AS uri FROM e"),
}
