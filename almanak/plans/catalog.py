"""The queries of the core by name, and their SQL."""

from __future__ import annotations

import re

from almanak.functions import zones as Z
from almanak.operators import deliveries, intervals, timestamps
from almanak.plans.archive import QUERIES_AND_SQL
from almanak.session import table

FLAGSHIP = "thread_collapse_page"

QUERIES = {
    "p2_found": lambda s, d: deliveries.repeated_deliveries(table(s, d, "counted")),
    "p2_kept": lambda s, d: deliveries.without_repeats(table(s, d, "counted")).select("delivery_no", "id", "sent_s", "from_addr"),
    "p3_found": lambda s, d: intervals.busy_periods(table(s, d, "vevents")),
    "p5_found": lambda s, d: timestamps.normalise_times(table(s, d, "raw_vevents"), table(s, d, "calendars")),
} | {name: plan for name, (plan, _) in QUERIES_AND_SQL.items()}

_CLEAN = "nullif(regexp_replace(regexp_replace({}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'), '')"
_DELIVERIES = f"""WITH RECURSIVE c AS (SELECT delivery_no AS no, {_CLEAN.format("id")} AS id, {_CLEAN.format("copy_of.mid")} AS mid, {_CLEAN.format("copy_of.from_addr")} AS f, {_CLEAN.format("copy_of.subject")} AS s FROM counted),
 k AS (SELECT no, row('i', id, '', '') AS key FROM c WHERE id IS NOT NULL UNION ALL SELECT no, row('c', mid, coalesce(f, chr(1)), coalesce(s, chr(1))) FROM c WHERE mid IS NOT NULL),
 e AS (SELECT DISTINCT a.no AS a, b.no AS b FROM k a JOIN k b ON a.key = b.key WHERE a.no <> b.no),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
 found AS (SELECT min(b) AS first_no, a AS repeat_no FROM reach GROUP BY a HAVING min(b) < a)"""
_SPANS = """e AS (SELECT feed_no, starts.kind AS kind, starts.wall AS w, coalesce(starts.tz, 'UTC') AS tz, epoch_us(starts.wall AT TIME ZONE coalesce(starts.tz, 'UTC')) AS b, epoch_us(ends.wall AT TIME ZONE coalesce(ends.tz, 'UTC')) AS x,
  regexp_extract(upper(trim(coalesce(duration, ''))), '^\\+?P(?:(\\d+)W|(?:(\\d+)D)?(?:T(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?)?)$', ['w', 'd', 'h', 'm', 's']) AS p FROM vevents WHERE starts.wall IS NOT NULL AND feed_no IS NOT NULL),
 l AS (SELECT *, nullif(((coalesce(try_cast(p.w AS BIGINT), 0) * 7 + coalesce(try_cast(p.d AS BIGINT), 0)) * 24 + coalesce(try_cast(p.h AS BIGINT), 0)) * 3600 + coalesce(try_cast(p.m AS BIGINT), 0) * 60 + coalesce(try_cast(p.s AS BIGINT), 0), 0) AS dur FROM e),
 i AS (SELECT feed_no, b // 1000000 AS b, (CASE WHEN x > b THEN x WHEN kind = 'date' THEN epoch_us((w + to_seconds(coalesce(dur, 86400))) AT TIME ZONE tz) ELSE b + dur * 1000000 END) // 1000000 AS u FROM l)"""



def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


def _times_sql() -> str:
    """Times by the same anchored patterns, in plain order; dates, zones and clock changes by DuckDB's own functions."""
    blank = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
    tidy = lambda c: f"trim(regexp_replace(translate({c}, '−', '-'), '{blank}', ' ', 'g'))"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(t, {quoted(pattern)}) THEN regexp_replace(t, {quoted(pattern)}, {quoted(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], parts))})" for _, pattern, parts in timestamps.CASCADE)
    months = _values([(name, n) for n, names in enumerate(timestamps.MONTHS, 1) for name in names], "word, n")
    desktop = _values([(k.lower(), v) for k, v in Z.DESKTOP_ZONES.items()], "k, zone")
    short = _values(list(Z.ABBREVIATIONS.items()), "word, n")
    shape = "'^(?:UTC|GMT)? ?([+-])(\\d{1,2})(?::?(\\d{2}))?$'"
    sign, hours, minutes = (f"regexp_extract(upper(z), {shape}, {k})" for k in (1, 2, 3))
    offset = f"CASE WHEN regexp_matches(upper(z), {shape}) THEN CASE WHEN try_cast({hours} AS INT) <= 18 AND coalesce(try_cast({minutes} AS INT), 0) < 60 THEN (try_cast({hours} AS INT) * 60 + coalesce(try_cast({minutes} AS INT), 0)) * CASE {sign} WHEN '-' THEN -1 ELSE 1 END END ELSE (SELECT n FROM short WHERE word = upper(z)) END"
    return f"""WITH months AS (SELECT * FROM {months}), short AS (SELECT * FROM {short}), zones AS (SELECT k, max(zone) AS zone FROM (SELECT * FROM {desktop} UNION ALL SELECT lower(replace(name, '_', ' ')), name FROM pg_timezone_names() WHERE lower(replace(name, '_', ' ')) NOT IN (SELECT k FROM {desktop})) GROUP BY k),
 r AS (SELECT raw_no, feed_no, 'start' AS field, start_text AS x FROM raw_vevents UNION ALL SELECT raw_no, feed_no, 'end', end_text FROM raw_vevents UNION ALL SELECT raw_no, feed_no, 'recurrence_id', recurrence_text FROM raw_vevents),
 t AS (SELECT *, {tidy("x")} AS t FROM r WHERE regexp_matches(x, '\\d')),
 votes AS (SELECT feed_no, sum(CASE WHEN a BETWEEN 13 AND 31 AND b <= 12 THEN 1 WHEN b BETWEEN 13 AND 31 AND a <= 12 THEN -1 ELSE 0 END) >= 0 AS day_first FROM (SELECT feed_no, try_cast(regexp_extract(t, '^(\\d{{1,2}})/(\\d{{1,2}})/\\d{{4}}(?:\\D|$)', 1) AS INT) AS a, try_cast(regexp_extract(t, '^(\\d{{1,2}})/(\\d{{1,2}})/\\d{{4}}(?:\\D|$)', 2) AS INT) AS b FROM t) GROUP BY feed_no),
 cal AS (SELECT feed_no, zone, CASE WHEN zone IS NULL THEN {offset} END AS off FROM (SELECT feed_no, {tidy("time_zone")} AS z, (SELECT zone FROM zones WHERE k = lower(replace({tidy("time_zone")}, '_', ' '))) AS zone FROM calendars)),
 c AS (SELECT *, string_split(CASE {cases} END, '|') AS p FROM t),
 n AS (SELECT raw_no, field, t, coalesce(cal.zone, 'UTC') AS feed_zone, cal.off AS feed_off, coalesce(day_first, true) AS day_first, try_cast(p[1] AS INT) AS y, lower(p[2]) AS w, try_cast(p[3] AS INT) AS d, coalesce(try_cast(p[4] AS INT), 0) AS h, coalesce(try_cast(p[5] AS INT), 0) AS mi, coalesce(try_cast(p[6] AS INT), 0) AS s, try_cast(rpad(coalesce(nullif(p[7], ''), '0'), 6, '0') AS BIGINT) AS f, upper(nullif(p[8], '')) AS half, nullif(p[9], '') AS z FROM c LEFT JOIN cal USING (feed_no) LEFT JOIN votes USING (feed_no)),
 q AS (SELECT *, CASE WHEN w[1] = 's' THEN try_cast(w[2:] AS INT) END AS one, CASE WHEN w[1] = 'w' THEN try_cast(w[2:] AS INT) END AS wk, coalesce(try_cast(w AS INT), (SELECT n FROM months WHERE word = w)) AS mo, CASE WHEN half IS NULL THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END AS hh FROM n),
 g AS (SELECT *, CASE WHEN y < 1 THEN NULL WHEN wk IS NOT NULL THEN CASE WHEN wk BETWEEN 1 AND weekofyear(make_date(y, 12, 28)) AND d BETWEEN 1 AND 7 THEN make_date(y, 1, 4) - (isodow(make_date(y, 1, 4)) - 1)::INT + ((wk - 1) * 7 + d - 1)::INT END
   ELSE try_cast(printf('%04d-%02d-%02d', y, CASE WHEN one IS NULL THEN mo WHEN day_first THEN d ELSE one END, CASE WHEN one IS NOT NULL AND day_first THEN one ELSE d END) AS DATE) END AS day,
  (hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59) OR (hh = 24 AND mi = 0 AND s = 0 AND f = 0 AND half IS NULL) AS fine, CASE WHEN z IS NOT NULL THEN {offset} END AS own_off, (SELECT zone FROM zones WHERE k = lower(replace(z, '_', ' '))) AS own_zone FROM q),
 l AS (SELECT *, day::TIMESTAMP + to_microseconds(((hh * 60 + mi) * 60 + s)::BIGINT * 1000000 + f) AS wall, CASE WHEN z IS NULL THEN feed_off ELSE own_off END AS off, CASE WHEN z IS NULL THEN feed_zone ELSE own_zone END AS zone FROM g WHERE fine AND day IS NOT NULL),
 i AS (SELECT raw_no, field, wall, zone, off, CASE WHEN off IS NULL THEN wall AT TIME ZONE zone END AS inst FROM l),
 u AS (SELECT raw_no, field, CASE WHEN off IS NOT NULL THEN epoch_us(wall) - off::BIGINT * 60000000 WHEN timezone(zone, inst - INTERVAL 1 HOUR) = wall THEN epoch_us(inst - INTERVAL 1 HOUR) WHEN timezone(zone, inst - INTERVAL 30 MINUTE) = wall THEN epoch_us(inst - INTERVAL 30 MINUTE) ELSE epoch_us(inst) END AS utc_us FROM i
  UNION ALL SELECT raw_no, field, try_cast(rpad(t, 16, '0') AS BIGINT) FROM t WHERE regexp_matches(t, '^\\d{{10}}(?:\\d{{3}}){{0,2}}$'))
 SELECT raw_no, field, utc_us FROM u WHERE utc_us IS NOT NULL"""


ORACLE = {
    "p5_found": _times_sql(),
    "p2_found": _DELIVERIES + " SELECT first_no, repeat_no FROM found",
    "p2_kept": _DELIVERIES + " SELECT delivery_no, id, sent_s, from_addr FROM counted WHERE delivery_no NOT IN (SELECT repeat_no FROM found)",
    "p3_found": f"""WITH {_SPANS}, o AS (SELECT *, max(u) OVER (PARTITION BY feed_no ORDER BY b, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i WHERE u > b),
 g AS (SELECT *, count(*) FILTER (WHERE r IS NULL OR b > r) OVER (PARTITION BY feed_no ORDER BY b, u ROWS UNBOUNDED PRECEDING) AS n FROM o), p AS (SELECT feed_no, n, min(b) AS begin_s, max(u) AS until_s FROM g GROUP BY feed_no, n)
 SELECT feed_no, 'period' AS what, begin_s, until_s FROM p UNION ALL SELECT a.feed_no, 'gap', a.until_s, b.begin_s FROM p a JOIN p b ON a.feed_no = b.feed_no AND b.n = a.n + 1""",
    "daily_domain_counts": f"""WITH c AS (SELECT {_CLEAN.format("id")} AS id, received_at, CASE WHEN from_addr IS NULL THEN '(none)' ELSE regexp_extract(lower(from_addr), '[^@]*$') END AS domain FROM counted),
 f AS (SELECT id, min(row(received_at, domain)) AS first FROM c GROUP BY id) SELECT date_trunc('day', first[1]) AS day, first[2] AS domain, count(*) AS messages FROM f GROUP BY 1, 2""",
} | {name: sql for name, (_, sql) in QUERIES_AND_SQL.items() if sql}
