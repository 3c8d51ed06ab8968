"""Oversized texts in pieces under a limit, cut at natural boundaries and overlapping (problem 6).

Agglomerative merging: a text is first taken apart into atoms that fit, at page
ends, then paragraph, sentence and word ends, and anywhere only within a run
without any. A heap holds the boundaries between neighbours; the weakest whose
two sides fit together with the overlap merge first, so that what remains are
the strongest.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.llm.screen import Screen, only
from almanak.session import checkpoint

DEFAULT_CHARS, MOST_CHARS = 20_000, 40_000
NOWHERE, WORD, SENTENCE, PARAGRAPH, PAGE = range(5)

_LINE = r"(?:\r\n|[\n\r  ])"
_ENDS = {
    PARAGRAPH: re.compile(rf"{_LINE}[^\S\r\n\f]*{_LINE}\s*"),
    SENTENCE: re.compile(rf"[.!?…][\"'’”»)\]]*\s+|[。！？][\"'’”」』）]*\s*|{_LINE}\s*|\f"),
    WORD: re.compile(r"\s+"),
}


def page_spans(text: str, page_starts: list[int] | None) -> list[tuple[int, int]]:
    """Where each page begins and ends.

    Pages begin at the distinct values of ``page_starts`` in rising order,
    values outside the text left out; without any, form feeds alone part them.
    A page ends before the form feed that parts it from the next.
    """
    starts = sorted({s for s in page_starts or [] if s is not None and 0 <= s <= len(text)})
    if not starts:
        starts = [0] + [m.end() for m in re.finditer("\f", text)]
    ends = [n - 1 if n > s and text[n - 1] == "\f" else n for s, n in zip(starts, starts[1:])]
    return list(zip(starts, ends + [len(text)]))


def _atoms(text: str, cuts: list[int], limit: int) -> tuple[list[int], list[int]]:
    """Ends of atoms of at most ``limit`` code points, and how strong each end is."""
    ends, strengths = [], []
    found: dict[int, list[int]] = {PAGE: cuts}

    def split(a: int, b: int, level: int, strength: int) -> None:
        if b - a <= limit:
            ends.append(b)
            strengths.append(strength)
            return
        if level == NOWHERE:
            for e in range(a + limit, b, limit):
                ends.append(e)
                strengths.append(NOWHERE)
            ends.append(b)
            strengths.append(strength)
            return
        if level not in found:
            found[level] = [m.end() for m in _ENDS[level].finditer(text)]
        at = found[level]
        inside = at[bisect_right(at, a) : bisect_left(at, b)]
        for e in inside:
            split(a, e, level - 1, level)
            a = e
        split(a, b, level - 1, strength)

    split(0, len(text), PAGE, PAGE)
    return ends, strengths


def split_text(text: str, pages: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``own``, ``begin``, ``end`` of each piece: code points from ``own`` on are new, those from ``begin`` repeat the piece before."""
    if not text:
        return []
    ends, strengths = _atoms(text, sorted({s for s, _ in pages if 0 < s < len(text)}), max(1, limit - overlap))
    n = len(ends)
    begins = [0, *ends[:-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[i], ends[i + 1] - begins[i], i, ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, until = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != until or until - begins[i] != size:
            continue  # one side has grown since
        if size + (overlap if begins[i] else 0) > limit:
            continue  # sizes only grow, so this boundary stays
        ends[i], after[i], strengths[i], alive[j] = ends[j], after[j], strengths[j], False
        if after[j] < n:
            before[after[j]] = i
            heapq.heappush(heap, (strengths[i], ends[after[j]] - begins[i], i, ends[after[j]]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (strengths[p], ends[i] - begins[p], p, ends[i]))
    out, last = [], 0
    for i in range(n):
        if alive[i]:
            last = max(last, begins[i] - overlap) if begins[i] else 0
            out.append((begins[i], last, ends[i]))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "max_chars", "overlap_chars", "piece_no", "begin_at", "end_at", "own_at", "page_no", "page_chars"]
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c) for c in ("doc_id", "text", "page_starts", "max_chars", "overlap_chars")]
        for doc, text, starts, limit, overlap in zip(*columns):
            text, limit, overlap = text.as_py(), limit.as_py(), overlap.as_py()
            pages = page_spans(text, starts.as_py())
            firsts = [s for s, _ in pages]
            key = (doc.as_py(), limit, overlap)
            for no, (own, begin, end) in enumerate(split_text(text, pages, limit, overlap), 1):
                # the pages that this piece's new text touches; 0 for text before the first
                a, b = bisect_right(firsts, own) - 1, bisect_left(firsts, end) - 1
                for p in range(a, b + 1):
                    rows.append((*key, no, begin, end, own, p + 1, pages[p][1] - pages[p][0] if p >= 0 else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def limits(requests: DataFrame) -> DataFrame:
    """``req_no``, ``doc_id``, ``max_chars``, ``overlap_chars`` as they hold.

    ``max_chars``: null means 20,000, above 40,000 means 40,000, below 1 means
    1. ``overlap_chars``: null or negative means 0, and it stays below
    ``max_chars``.
    """
    most = F.greatest(F.lit(1), F.least(F.lit(MOST_CHARS), F.coalesce("max_chars", F.lit(DEFAULT_CHARS))))
    r = requests.select("req_no", "doc_id", most.cast("bigint").alias("max_chars"), F.col("overlap_chars").cast("bigint").alias("o"))
    return r.select("req_no", "doc_id", "max_chars", F.greatest(F.lit(0), F.least(F.coalesce("o", F.lit(0)), F.col("max_chars") - 1)).alias("overlap_chars"))


def piece_pages(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pieces of documents for each distinct limit and overlap wanted, one row per page that a piece touches.

    Pieces come in order, cover the whole text, and each repeats
    ``overlap_chars`` code points of the one before (fewer only if that one has
    fewer). Null and empty texts have none; a text within the limit is one.
    A document asked for very often is split once for each distinct pair.
    """
    d = documents.select("doc_id", "text", F.col("page_starts").cast("array<bigint>").alias("page_starts")).filter("text is not null")
    w = wanted.select("doc_id", "max_chars", "overlap_chars").distinct()
    rows = w.join(d, "doc_id").select("doc_id", "text", "page_starts", "max_chars", "overlap_chars")
    return rows.mapInArrow(_pieces, "doc_id bigint, max_chars bigint, overlap_chars bigint, piece_no bigint, begin_at bigint, end_at bigint, own_at bigint, page_no bigint, page_chars bigint")


def request_pieces(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """``req_no``, ``piece_no``, ``begin_at``, ``end_at``: every request's pieces."""
    r = limits(requests)
    p = piece_pages(documents, r).select("doc_id", "max_chars", "overlap_chars", "piece_no", "begin_at", "end_at").distinct()
    return r.join(p, ["doc_id", "max_chars", "overlap_chars"]).select("req_no", "piece_no", "begin_at", "end_at")


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``max_chars``, ``page_no``: pages that the merging cannot put into one piece."""
    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        for doc, text, starts, limits in zip(*(batch.column(c) for c in ("doc_id", "text", "page_starts", "limits"))):
            text = text.as_py()
            pages = page_spans(text, starts.as_py())
            for limit in limits.as_py():
                rows += [(doc.as_py(), limit, no) for no, (a, b) in enumerate(pages, 1) if len(split_text(text[a:b], [(0, b - a)], limit, 0)) > 1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "max_chars", "page_no"])


def oversized_pages(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """``req_no``, ``page_no``: pages of the requested document with more code points than the request allows.

    Such a page is one that stays in several pieces when its atoms have been
    merged under the limit. Only texts longer than a limit asked of them move:
    lengths and limits are compared first, and a document asked for with
    several limits moves once. Null and empty texts have none.
    """
    r = limits(requests).select("req_no", "doc_id", "max_chars")
    lengths = documents.select("doc_id", F.length("text").alias("n")).filter("n > 1")
    wanted = r.select("doc_id", "max_chars").distinct().join(lengths, "doc_id").filter("n > max_chars").groupBy("doc_id").agg(F.collect_set("max_chars").alias("limits"))
    wanted = checkpoint(wanted)
    d = documents.select("doc_id", "text", F.col("page_starts").cast("array<bigint>").alias("page_starts")).filter("text is not null and doc_id is not null")
    d = d.mapInArrow(only(Screen(wanted.select("doc_id"))), "doc_id bigint, text string, page_starts array<bigint>")
    p = d.join(wanted, "doc_id").select("doc_id", "text", "page_starts", "limits").mapInArrow(_cut_pages, "doc_id bigint, max_chars bigint, page_no bigint").distinct()
    return r.join(p, ["doc_id", "max_chars"]).select("req_no", "page_no")


def piece_faults(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """What the pieces of all requests keep: one row per ``req_no`` that has pieces, each column as it must be for every text.

    ``chars`` of the whole text; ``begin_at``, ``end_at`` of all
    together; ``over``, pieces above the limit; ``apart``, places where a piece
    does not go on from the one before; ``odd``, pieces that repeat another
    number of code points than asked for, where the one before has as many.
    """
    r = limits(requests)
    along = W.partitionBy("req_no").orderBy("piece_no")
    p = request_pieces(documents, requests).join(r, "req_no")
    p = p.withColumn("last_begin", F.lag("begin_at").over(along)).withColumn("last_end", F.lag("end_at").over(along))
    repeats = F.col("last_end") - F.col("begin_at")
    asked = F.least(F.col("overlap_chars"), F.col("last_end") - F.col("last_begin"))
    out = p.groupBy("req_no", "doc_id").agg(
        F.min("begin_at").alias("begin_at"), F.max("end_at").alias("end_at"), F.count_if(F.col("end_at") - F.col("begin_at") > F.col("max_chars")).alias("over"),
        F.count_if((F.col("begin_at") > F.col("last_end")) | (F.col("end_at") <= F.col("last_end"))).alias("apart"), F.count_if(repeats != asked).alias("odd"))
    return out.join(documents.select("doc_id", F.length("text").cast("bigint").alias("chars")), "doc_id").drop("doc_id")
