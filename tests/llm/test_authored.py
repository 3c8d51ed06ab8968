"""Lines of mail: marks, boxes, places, threads and senders."""

from datetime import datetime, timedelta, timezone

import pytest

from almanak.llm.authored import authored_text, decided_lines, not_written_lines
from almanak.llm.lines import label_lines

PARTS = "part_no bigint, msg_no bigint, part_index int, content_type string, text string, thread string, label string"
MESSAGES = "msg_no bigint, thread_id string, from_addr string, internaldate timestamp, message_id string, label string, text string"
REQUESTS = "req_no bigint, thread_id string, raw boolean, label string"


def new(text, is_html=False):
    return [n for n, _, label in label_lines(text, is_html) if label in ("text", "closing")]


def test_marks_and_signatures():
    assert new("Hi Ann,\n\nYes.\n\nBest regards,\nBob\n+1 303 555 0101\n\nOn 2026-01-02 10:00, Ann <a@x.test> wrote:\n> No?\n>\n> Ann") == [1, 3]
    assert new("On 2026-01-02 10:00, Ann <a@x.test> wrote:\n> First?\nYes.\n> Second?\nNo.\n\nBob") == [3, 5]
    assert new("Fine.\n-- \nBob | Desk\n\n-----Original Message-----\nFrom: Ann <a@x.test>\nSent: today\nTo: Bob\n\nHello") == [1]
    assert new("Fine.\n\nFrom: Ann <a@x.test>\nSent: today\nTo: Bob\nSubject: x\n\nHello") == [1]
    assert new("A> b\nAB> old\n| older\n > indented\nNew text here.") == [5]
    assert new("2026-01-02 10:00, Ann <a@x.test>:\n    Old words one.\n    Old words two.\nNew words.") == [4]


def test_what_only_looks_like_it():
    for line in ("From: the side door you can see it already.", "To: do before Friday, from: my own list", "-- and then there is the matter of the keys", "-> move the boxes first", "This stays confidential between us until the vote.", "Best regards to the whole choir from me, they earned it.", "On the whole, what the committee wrote:", "Sent: two crates. Received: one crate."):
        assert new(f"Hello,\n{line}\nMore text follows here.") == [1, 2, 3], line


def test_html():
    text = '<html><body>\n<p>Yes, I do.</p>\n<br>\n<p>&nbsp;</p>\n<div class="gmail_signature">\n<p>Bob</p>\n</div>\n<div class="gmail_quote">\n<p>On Monday Ann wrote:</p>\n<blockquote>old</blockquote>\n</div>\n<p>And this.</p>\n</body></html>'
    assert [(n, label) for n, _, label in label_lines(text, True)] == [(2, "closing"), (6, "signature"), (9, "quote"), (10, "quote"), (12, "closing")]
    assert label_lines("<p></p>\n<!-- x\n -->\n<style>\np{}\n</style>", True) == []


def frames(spark, bodies, requests=(), thread="t"):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    parts = spark.createDataFrame([(n, n, 0, "text/plain", b, "", "") for n, (_, b) in enumerate(bodies)], PARTS)
    messages = spark.createDataFrame([(n, thread, who, start + timedelta(days=n), f"<{n}>", "", "") for n, (who, _) in enumerate(bodies)], MESSAGES)
    return parts, messages, spark.createDataFrame(list(requests), REQUESTS)


def test_unmarked_quotation_is_known_by_the_thread(spark):
    first = "The harbour survey was moved to the second week of May."
    args = frames(spark, [("a", f"{first}\n\nAnn"), ("b", f"Thanks, noted.\n\n{first}\n")])
    assert {tuple(r) for r in not_written_lines(*args).collect()} == {(0, 3), (1, 3)}
    assert {r.part_no: r.text for r in authored_text(*args).collect()} == {0: first, 1: "Thanks, noted."}


@pytest.mark.parametrize("threads", [1, 4, 100])
def test_an_unmarked_sentence_is_a_quotation_however_many_threads_have_it(spark, threads):
    first = "The harbour survey was moved to the second week of May."
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(2 * k + later, f"t{k}", later) for k in range(threads) for later in (0, 1)]
    parts = spark.createDataFrame([(n, n, 0, "text/plain", f"Noted, number {n}.\n{first}" if later else f"{first}\nA line of {n}.", "", "") for n, _, later in rows], PARTS)
    messages = spark.createDataFrame([(n, t, f"{n}@x.test", start + timedelta(days=n), f"<{n}>", "", "") for n, t, _ in rows], MESSAGES)
    got = {tuple(r) for r in decided_lines(parts, messages, spark.createDataFrame([], REQUESTS)).collect()}
    assert got == {(n, 2, "rank") for n, _, later in rows if later}


def test_marks_are_not_needed_where_the_thread_holds_the_original(spark):
    original = "Hi Ann,\nThe pump in hall four was mended on Monday.\nThe bill comes next week, says the works office.\nBob"
    args = frames(spark, [("b", original), ("a", "Good news, I will tell the others.\n\n" + original), ("c", "Hi Ann,\nThe lift is a different matter altogether, sorry.")])
    got = {tuple(r) for r in decided_lines(*args).collect()}
    assert got == {(1, n, "rank") for n in (3, 4, 5, 6)} | {(0, 4, "form")}


def test_signatures_of_any_length(spark):
    contact = [f"Room {n}, North Hall" for n in range(40)]
    assert new("All is well here, thanks to you.\n\nBest regards,\nBob\n" + "\n".join(contact)) == [1]
    assert new("All is well here, thanks to you.\n-- \nBob\n" + "\n".join(contact)) == [1]


def test_one_senders_closing_line_is_no_other_senders(spark):
    bodies = [("z@x.test", f"Text number {n} is here for you.\nup and onward, always!") for n in range(3)] + [(f"{n}@x.test", f"So I said it to number {n}.\nup and onward, always!") for n in range(5)]
    assert {tuple(r) for r in decided_lines(*frames(spark, bodies, thread=None)).collect()} == {(n, 2, "recur") for n in range(3)}


def test_a_senders_closing_line_is_known_by_its_recurring(spark):
    bodies = [("z@x.test", f"Text number {n} is here for you.\nup and onward, always!") for n in range(4)] + [("q@x.test", "up and onward, always!\nOther things are said after it.")]
    gone = {tuple(r) for r in not_written_lines(*frames(spark, bodies, thread=None)).collect()}
    assert gone == {(n, 2) for n in range(4)}


def test_raw_threads_nulls_and_nothing(spark):
    parts, messages, requests = frames(spark, [("a", "Hi.\n> old"), ("a", None), (None, ""), ("a", "x" * 50_000 + "\n> old")], [(1, "t", True, ""), (2, "t", False, ""), (3, None, True, ""), (4, "u", None, "")])
    assert not_written_lines(parts, messages, requests).collect() == []
    assert {r.part_no: r.text for r in authored_text(parts, messages, requests).collect()}[0] == "Hi.\n> old"
    got = {tuple(r) for r in not_written_lines(parts, messages.limit(0), requests).collect()}
    assert got == {(0, 2), (3, 2)}
    assert not_written_lines(parts.limit(0), messages, requests.limit(0)).collect() == []
