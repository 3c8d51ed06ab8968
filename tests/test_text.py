"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from almanak.functions import text as T

CLEAN = [
    ("hi\U000e0078‮ok⁩ 👨‍👩", "hiok 👨‍👩", 3), ("pa​ss⁠wo﻿rd­‎ \x1b[31mred\x07", "password [31mred", 7), ("a\tb\r\nc\xa0d‌e ❤️", "a\tb\r\nc\xa0d‌e ❤️", 0),
    ("❤️", "❤️", 0), ("葛\U000e0100", "葛\U000e0100", 0), ("1️⃣", "1️⃣", 0), ("👁️‍🗨️", "👁️‍🗨️", 0), ("가", "가", 0), ("ᅟᅡ", "ᅟᅡ", 0), ("ᄀᅠᆨ", "ᄀᅠᆨ", 0),
    ("a\U000e0141\U000e0142\U000e0143b", "a\U000e0141b", 2), ("❤️︎", "❤️", 1), ("️x", "x", 1), (" \U000e0100", " ", 1), ("a\n️", "a\n", 1), ("👨‍️", "👨‍", 1), ("a​️", "a", 2),
    ("aᅟb", "ab", 1), ("aᅠb", "ab", 1), ("ᅠxᅟ", "x", 2), ("", "", 0),
]


def test_clean(spark):
    rows = spark.createDataFrame([(a,) for a, _, _ in CLEAN], "s string").select(T.clean(F.col("s")), T.hidden_count(F.col("s"))).collect()
    for (s, kept, gone), got in zip(CLEAN, rows):
        assert (got[0], got[1]) == (kept, gone), ascii(s)


@pytest.mark.parametrize(
    "text,out,gone",
    [
        ("Yes.\n\nOn Monday, Ann wrote:\n> a\n> b\n", "Yes.", 3), ("On Friday, Ann <\na@x.test> wrote:\n> a\nAnswer\n> b", "Answer", 4), ("Hi\n-----Original Message-----\nold", "Hi", 2),
        ("Hi\nFrom: a\nTo: b\nSent: c\nold", "Hi", 4), ("He wrote:\nmore", "He wrote:\nmore", 0), ("a\n\n\n\nb", "a\n\nb", 0), ("", "", 0),
    ],
)
def test_quotes(text, out, gone):
    assert T.unquoted(text) == (out, gone)


def test_a_forward_keeps_its_original():
    assert T.unquoted("FYI\n-----Original Message-----\nold", True) == ("FYI\n-----Original Message-----\nold", 0)


def test_html():
    assert T.html_text("<p>a &amp; b</p><style>x</style><p>c<br>d</p>") == "a & b\n\nc\nd"
    assert T.html_text('<p>new</p><blockquote>old <blockquote>older</blockquote> old</blockquote><div class="gmail_quote">x</div><p>end</p>', True) == "new\n\nend"


def test_readable_bodies(spark):
    rows = [("Fine by me.\n\nOn Monday, Lena wrote:\n> Is it?\n> Yes?", False, "Re: x"), ("<p>Fine.</p><blockquote>old</blockquote>", True, None), ("See below.\n-----Original Message-----\nold", False, "WG: x"), (None, False, "x"), ("", True, "")]
    got = spark.createDataFrame(rows, "b string, h boolean, s string").select(T.readable_body("b", "h", "s").alias("r")).collect()
    assert [tuple(x.r) for x in got] == [("Fine by me.", 3), ("Fine.", 1), ("See below.\n-----Original Message-----\nold", 0), (None, None), ("", 0)]
    assert T.readable("a\n> b  \n", False, None, quotes_removed=False) == ("a\n> b", 0)


def test_snippets(spark):
    texts = ["a  b\n\nc ", " " * 5000 + "late " + "x" * 900, "w " * 700, "\u200b" * 3000 + "seen", "y" * 199 + " " + " " * 900, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.snippet(F.col("t"))).collect()]
    assert got == ["a b c", ("late " + "x" * 900)[:200], ("w " * 700)[:200], "seen", "y" * 199, "", None]


def test_markers_and_placeholders(spark):
    df = spark.createDataFrame([(" import ", "a.ONLINE"), ("else", "b.txt"), (None, None)], "v string, n string")
    assert [tuple(r) for r in df.select(T.marker(F.col("v"), ["import", "bridge"]), T.placeholder_class(F.col("n"), {".online": "doc", ".grid": "sheet"})).collect()] == [("import", "doc"), ("other", None), (None, None)]
    names = spark.createDataFrame([("a.PDF",), ("pdf",), ("x.heic",), ("x.xml",), ("",), (None,)], "n string").select(T.mime_type(F.col("n"))).collect()
    assert [r[0] for r in names] == ["application/pdf", "application/octet-stream", "image/heic", "application/octet-stream", "application/octet-stream", "application/octet-stream"]


def test_roots_of_threads(spark):
    df = spark.createDataFrame([("<m@x.test>", None, "<p1@x.test><p2@x.test>"), ("<m@x.test>", [], " \n<p1@x.test> <p2@x.test>"), ("<m@x.test>", ["<r@x.test>"], None), ("<m@x.test>", None, None)], "mid string, refs array<string>, reply string")
    assert [r[0] for r in df.select(T.thread_key(F.col("mid"), F.col("refs"), F.col("reply"))).collect()] == ["p1@x.test", "p1@x.test", "r@x.test", "m@x.test"]


def test_names_and_ids(spark):
    df = spark.createDataFrame([("Café.TXT", "<m1@x.test>", ["<r0@x.test>"], None, "Ann <Ann@X.test>"), ("café.txt", " ", [], "<p@internal.invalid>", "ann@x.test"), ("a​b\\u{41}", None, None, "<q@x.test>", None)], "name string, mid string, refs array<string>, reply string, sender string")
    got = df.select(T.folded("name").alias("f"), T.escaped("name").alias("e"), T.unescaped(T.escaped("name")).alias("u"), T.thread_key(F.col("mid"), F.col("refs"), F.col("reply")).alias("k"), T.bare_address(F.col("sender")).alias("a"), F.col("name")).collect()
    assert got[0].f == got[1].f == "café.txt" and got[2].e == "a\\u{200B}b\\u{5C}u{41}" and all(r.u == r.name for r in got)
    assert [r.k for r in got] == ["r0@x.test", None, "q@x.test"] and [r.a for r in got] == ["ann@x.test", "ann@x.test", None]


def test_bytes(spark):
    df = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n..", "a"), (b"%PDF-1.7", "b"), (b"x", "c.docx"), (b"RIFF1234WEBP", "d"), (b"caf\xe9", "e"), (b"\xff\xfea\x00", "f"), (b"a\x00\xe9", "g"), (b"na\xefve \x93x\x94 \x81 \xe9", "h")], "content binary, name string")
    rows = df.select(T.sniffed(F.col("content"), F.col("name")), T.decoded("content")).collect()
    assert [r[0] for r in rows[:5]] == ["image/png", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/webp", "text/plain"]
    assert [r[1] for r in rows[4:]] == ["café", "a", None, "naïve “x” \x81 é"]
