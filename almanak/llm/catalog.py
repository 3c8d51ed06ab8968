"""The queries of the subpackage llm by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.llm import authored, encode, mix, pieces, pii, spans
from almanak.session import table


def _mail(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(s, d, "parts"), table(s, d, "messages"), table(s, d, "thread_requests")


def _round_trip(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``bytes``, ``digest`` of what the ids of each document decode to."""
    back = encode.encode_corpus(documents).select("doc_id", encode.decode(F.col("ids")).alias("text"))
    return back.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _targets_kept(m: mix.Mix) -> DataFrame:
    """What each mix was to keep: no document above its cap, every source within a block of its goal."""
    off = F.col("tokens_used") - F.col("goal_share") * F.sum("tokens_used").over(W.partitionBy("mix_no"))
    return m.shares().select("mix_no", "source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (F.abs(off) <= m.block).alias("near_goal"))


QUERIES = {
    "p1_found": lambda s, d: pii.found_spans(table(s, d, "vevents"), table(s, d, "parts")),
    "p1_masked": lambda s, d: pii.masked_texts(table(s, d, "vevents"), table(s, d, "parts")),
    "p1_faults": lambda s, d: pii.span_faults(table(s, d, "vevents"), table(s, d, "parts")),
    "p4_found": lambda s, d: authored.not_written_lines(*_mail(s, d)),
    "p4_authored": lambda s, d: authored.authored_text(*_mail(s, d)),
    "p4_steps": lambda s, d: authored.decided_lines(*_mail(s, d)).groupBy("step").agg(F.count("*").alias("lines")),
    "p4_faults": lambda s, d: authored.line_faults(*_mail(s, d)),
    "p4_whole": lambda s, d: authored.whole_texts(*_mail(s, d)),
    "p6_found": lambda s, d: pieces.oversized_pages(table(s, d, "documents"), table(s, d, "read_requests")),
    "p6_pieces": lambda s, d: pieces.request_pieces(table(s, d, "documents"), table(s, d, "read_requests")),
    "p6_faults": lambda s, d: pieces.piece_faults(table(s, d, "documents"), table(s, d, "read_requests")),
    "p7_ids": lambda s, d: encode.encode_corpus(table(s, d, "documents")),
    "p7_round_trip": lambda s, d: _round_trip(table(s, d, "documents")),
    "p8_schedule": lambda s, d: mix.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).schedule(),
    "p8_shares": lambda s, d: mix.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).shares(),
    "p8_deviation": lambda s, d: mix.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).deviation(),
    "p8_kept": lambda s, d: _targets_kept(mix.Mix(table(s, d, "documents"), table(s, d, "mix_targets"))),
    "p9_found": lambda s, d: spans.shared_pairs(table(s, d, "documents")),
    "p9_classes": lambda s, d: spans.shared_classes(table(s, d, "documents")),
    "p9_shares": lambda s, d: spans.document_amounts(table(s, d, "documents")),
    "p9_spans": lambda s, d: spans.shared_spans(table(s, d, "documents")),
}

_LIMITS = "r AS (SELECT req_no, doc_id, greatest(1, least(40000, coalesce(max_chars, 20000))) AS most FROM read_requests)"
_RAW = "SELECT thread_id FROM thread_requests WHERE raw AND thread_id IS NOT NULL"
# every span of 180 code points of every text, compared as it stands
_WINDOWS = """d AS (SELECT min(doc_id) AS t, text FROM documents WHERE length(text) >= 180 GROUP BY text),
 w AS (SELECT t, i, text[i:i + 179] AS span FROM (SELECT t, text, unnest(range(1, length(text) - 178)) AS i FROM d)),
 g AS (SELECT span, list_sort(list_distinct(list(t))) AS ts FROM w GROUP BY span HAVING min(t) <> max(t)),
 p AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(ts) AS b FROM (SELECT ts, unnest(ts) AS a FROM (SELECT DISTINCT ts FROM g))) WHERE a < b),
 m AS (SELECT doc_id, length(text) AS n, min(doc_id) OVER (PARTITION BY text) AS t, count(*) OVER (PARTITION BY text) - 1 AS copies FROM documents WHERE length(text) >= 180)"""

#: What SQL can say of whole tables. Of p1, p4, p6 and p8 it checks what every result must keep; the rest is compared with brute force, exact round trips and held-out accuracy in tests.
ORACLE: dict[str, str] = {
    "p1_faults": "SELECT tbl, row_no, length(text) AS n_chars, 0 AS outside, 0 AS overlapping, 0 AS altered FROM (SELECT 'vevents' AS tbl, event_no AS row_no, description AS text FROM vevents UNION ALL SELECT 'parts', part_no, text FROM parts) WHERE text IS NOT NULL AND text <> ''",
    "p4_faults": "SELECT part_no, len(string_split(text, chr(10))) AS n_lines, 0 AS outside, 0 AS blank, 0 AS \"raw\" FROM parts WHERE text IS NOT NULL AND text <> ''",
    "p4_whole": f"SELECT part_no, text FROM parts JOIN messages USING (msg_no) WHERE thread_id IN ({_RAW})",
    "p6_found": f"""WITH {_LIMITS}, d AS (SELECT doc_id, text, coalesce(list_sort(list_distinct(list_filter(page_starts, lambda s: s IS NOT NULL AND s >= 0 AND s <= length(text)))), []) AS given FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, text, given, string_split(text, chr(12)) AS fed FROM d),
 b AS (SELECT doc_id, text, CASE WHEN len(given) > 0 THEN given::BIGINT[] ELSE list_transform(range(1, len(fed) + 1), lambda k: coalesce(list_sum(list_transform(fed[1:k - 1], lambda x: length(x) + 1)), 0)::BIGINT) END AS starts FROM c),
 p AS (SELECT doc_id, text, starts, unnest(range(1, len(starts) + 1)) AS page_no FROM b),
 z AS (SELECT doc_id, page_no, CASE WHEN page_no = len(starts) THEN length(text) - starts[page_no] ELSE starts[page_no + 1] - starts[page_no] - CASE WHEN text[starts[page_no + 1]:starts[page_no + 1]] = chr(12) THEN 1 ELSE 0 END END AS size FROM p)
 SELECT req_no, page_no FROM r JOIN z USING (doc_id) WHERE size > most""",
    "p6_faults": f"WITH {_LIMITS} SELECT req_no, length(text) AS chars, 0 AS begin_at, length(text) AS end_at, 0 AS over, 0 AS apart, 0 AS odd FROM r JOIN documents USING (doc_id) WHERE length(text) > 0",
    "p7_round_trip": "SELECT doc_id, coalesce(strlen(text), 0) AS bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_kept": """WITH t AS (SELECT mix_no, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS weight, max(greatest(coalesce(max_repeats, 1), 0)) AS max_repeats FROM mix_targets WHERE mix_no IS NOT NULL AND trim(source) <> '' GROUP BY 1, 2)
 SELECT mix_no, source, round(CASE WHEN sum(weight) OVER m > 0 THEN weight / sum(weight) OVER m ELSE 0 END, 6) AS target_share, max_repeats, true AS within_cap, true AS near_goal FROM t WINDOW m AS (PARTITION BY mix_no)""",
    "p9_found": f"WITH {_WINDOWS} SELECT least(x.doc_id, y.doc_id) AS doc_a, greatest(x.doc_id, y.doc_id) AS doc_b FROM p JOIN m x ON x.t = a JOIN m y ON y.t = b UNION ALL SELECT x.doc_id, y.doc_id FROM m x JOIN m y ON x.t = y.t AND x.doc_id < y.doc_id",
    "p9_classes": f"WITH {_WINDOWS}, l AS (SELECT t, count(*) AS links FROM (SELECT a AS t FROM p UNION ALL SELECT b FROM p) GROUP BY t) SELECT doc_id, t AS class_id, copies, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (t)",
    "p9_shares": f"""WITH {_WINDOWS}, x AS (SELECT t, i, lead(i) OVER (PARTITION BY t ORDER BY i) AS nx FROM w JOIN g USING (span)), y AS (SELECT t, sum(least(180, coalesce(nx - i, 180))) AS c FROM x GROUP BY t),
 z AS (SELECT doc_id, n, copies, CASE WHEN copies > 0 THEN n ELSE coalesce(c, 0) END AS shared FROM m LEFT JOIN y USING (t))
 SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared, 0) AS shared_chars, round(coalesce(shared / n, 0), 6) AS share, coalesce(copies, 0) AS copies FROM documents d LEFT JOIN z USING (doc_id)""",
}
