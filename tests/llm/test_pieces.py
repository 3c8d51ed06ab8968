"""Pieces: limits, order, cover, overlap, boundaries; pages."""

import random

import pytest

from almanak.llm.pieces import oversized_pages, page_spans, request_pieces, split_text

DOCS = "doc_id bigint, text string, page_starts array<int>, max_chars string, req_no string, overlap_chars string"
REQS = "req_no bigint, doc_id bigint, max_chars int, overlap_chars int, text string, page_starts string"


def holds(text, pieces, limit, overlap):
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    last_begin = last_end = 0
    for own, begin, end in pieces:
        assert own == last_end and 0 < end - begin <= limit and end > own
        assert begin == (max(last_begin, own - overlap) if own else 0)
        last_begin, last_end = begin, end


@pytest.mark.parametrize("seed", range(6))
def test_cover_order_limit_overlap(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "longerword ", "end. ", "x" * r.randrange(1, 90), "\n\n", "\r\n", "\f", "é漢字。", "😀 ", " \n"]) for _ in range(r.randrange(1, 400)))
    for limit, overlap in ((1, 0), (7, 3), (60, 10), (300, 299), (10_000, 5)):
        pages = page_spans(text, None)
        holds(text, split_text(text, pages, limit, overlap), limit, overlap)


def test_strongest_boundaries_stay():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven.\n\nTwelve."
    ends = [text[own:end] for own, _, end in split_text(text, [(0, len(text))], 40, 0)]
    assert ends == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven.\n\nTwelve."[:31], "Twelve."] or ends[0].endswith("\n\n")
    assert all(e.endswith(("\n\n", "Twelve.")) for e in ends)
    words = split_text("alpha beta gamma delta", [(0, 22)], 11, 0)
    assert all("alpha beta gamma delta"[end - 1 : end] in (" ", "a") for _, _, end in words)


def test_pages():
    assert page_spans("ab\fcd\f", None) == [(0, 2), (3, 5), (6, 6)]
    assert page_spans("ab\fcd", [3, 0, 3, 99, -1, None]) == [(0, 2), (3, 5)]
    assert page_spans("abcd", [2, 0]) == [(0, 2), (2, 4)] and page_spans("", []) == [(0, 0)] and page_spans("a", []) == [(0, 1)]


def test_requests(spark):
    long = "A sentence here. " * 3000
    docs = spark.createDataFrame([(1, "abc\fdefgh", None, "", "", ""), (2, None, [0], "", "", ""), (3, "", [], "", "", ""), (4, long, None, "", "", ""), (5, "x" * 90_000, [0, 45_000], "", "", "")], DOCS)
    reqs = [(1, 1, 4, 1), (2, 1, 4, 1), (3, 2, 4, 0), (4, 3, None, None), (5, 4, None, None), (6, 4, 99_999, None), (7, 9, 5, 0), (8, None, 5, 0), (9, 1, -3, 99), (10, 5, None, 10)]
    requests = spark.createDataFrame([(*r, "t", "p") for r in reqs], REQS)
    assert {tuple(r) for r in oversized_pages(docs, requests).collect()} == {(1, 2), (2, 2), (5, 1), (6, 1), (9, 1), (9, 2), (10, 1), (10, 2)}
    pieces = request_pieces(docs, requests).collect()
    assert max(r.end_at - r.begin_at for r in pieces if r.req_no == 5) <= 20_000 and max(r.end_at for r in pieces if r.req_no == 6) == len(long)
    assert {r.req_no for r in pieces} == {1, 2, 5, 6, 9, 10}
    assert oversized_pages(docs.limit(0), requests).collect() == [] and request_pieces(docs, requests.limit(0)).collect() == []
