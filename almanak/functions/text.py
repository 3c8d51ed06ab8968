"""Text functions as Columns; those that no built-in expresses as Arrow-batched UDFs."""

from __future__ import annotations

import codecs
import html
import html.parser
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

_SELECTORS = r"︀-️\x{E0100}-\x{E01EF}"
# Ranges of characters that show as nothing and serve no script.
_IGNORABLE = r"­؜឴-឵᠋-᠏​‎-‏‪-‮⁠-⁯ㅤ﻿ﾠ￰-￸\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E00FF}\x{E01F0}-\x{E0FFF}"
_CONTROLS = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"


def clean(text: Column) -> Column:
    """The text without hidden characters and controls.

    A variation selector stays only as the first one right after a character
    that it can vary; a Hangul filler only beside the letter it fills in for.
    """
    doubtful = rf"[{_IGNORABLE}{_CONTROLS}{_SELECTORS}\u115F\u1160]"  # most texts hold none and skip the costly patterns
    one = F.regexp_replace(text, f"([{_SELECTORS}])[{_SELECTORS}]+", "$1")
    hidden = rf"[{_IGNORABLE}{_CONTROLS}]"
    lone = rf"(?<![^\s‌‍͏{_IGNORABLE}{_CONTROLS}])[{_SELECTORS}]"
    fillers = r"ᅟ(?![ᅠ-ᆧힰ-ퟆ])|(?<![ᄀ-ᅟꥠ-ꥼ])ᅠ"
    return F.when(text.rlike(doubtful), F.regexp_replace(one, f"{hidden}|{lone}|{fillers}", "")).otherwise(text)


def hidden_count(text: Column) -> Column:
    """How many characters ``clean`` takes away."""
    return F.length(text) - F.length(clean(text))


def snippet(text: Column, size: int = 200) -> Column:
    """The start of a text on one line.

    Looked for in its first characters; only where these collapse to too few
    the whole text is read.
    """
    line = lambda t: F.trim(F.regexp_replace(clean(t), r"\s+", " "))
    # what the last characters of a head are may hang on what follows it
    enough = (F.length(text) <= 4 * size) | (F.length(line(F.substring(text, 1, 4 * size - 8))) > size)
    return F.substring(F.when(enough, line(F.substring(text, 1, 4 * size))).otherwise(line(text)), 1, size)


def truncated(text: Column, size: int) -> tuple[Column, Column]:
    """The first ``size`` characters, and whether more were there."""
    return F.substring(text, 1, size), F.length(text) > size


def short_id(full: Column) -> Column:
    return F.substring(full, 1, 16)


def id_matches(full: Column, prefix: str) -> Column:
    """Whether an id is meant by a prefix of at least 16 characters."""
    if len(prefix) < 16:
        raise ValueError("an id has at least 16 characters")
    return F.startswith(full, F.lit(prefix))


def domain(address: Column) -> Column:
    """What follows the last @; the whole where there is none."""
    return F.substring_index(address, "@", -1)


def bare_address(address: Column) -> Column:
    """The address in small letters, without display name and angle brackets; null for none."""
    inner = F.regexp_extract(address, r"<([^<>]*)>\s*$", 1)
    return F.nullif(F.lower(F.trim(F.when(F.coalesce(inner, F.lit("")) != "", inner).otherwise(address))), F.lit(""))


def thread_key(message_id: Column, references: Column, in_reply_to: Column, internal: str = "@internal.invalid") -> Column:
    """The root of a thread: first usable id of References (an array), then In-Reply-To, else the message's own; null if that root is unfit."""
    # several ids may stand in one header, with blanks or brackets between
    ids = F.split(F.concat_ws(" ", references, in_reply_to), r"[\s<>]+")
    ids = F.filter(ids, lambda x: (x != "") & ~x.endswith(internal))
    root = F.coalesce(F.get(ids, 0), F.trim(F.translate(message_id, "<>", "  ")))
    return F.when(root.rlike(r"^[\x21\x23-\x5B\x5D-\x7E]{1,300}$") & ~root.rlike(r"[()<>\[\]]"), root)


def one_of(value: Column, known: list[str]) -> Column:
    """A closed choice: unknown values are 'other', null stays null."""
    small = F.lower(value)
    return F.when(value.isNull(), None).when(small.isin(known), small).otherwise("other")


def mime_type(name: Column) -> Column:
    """The media type by a file name's ending."""
    pairs = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))), F.lit("application/octet-stream"))


# Media types by ending; of documents also those that only a look at their bytes leaves undecided.
MEDIA_TYPES = {
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "zip": "application/zip",
}
DOCUMENT_TYPES = {"docx": MEDIA_TYPES["docx"], "doc": "application/msword", "rtf": "application/rtf", "odt": "application/vnd.oasis.opendocument.text"}


def placeholder_class(name: Column, endings: dict[str, str]) -> Column:
    """What an online document's placeholder stands for, by the ending of its file name, case aside; null for other files."""
    out = F.lit(None).cast("string")
    for ending, kind in endings.items():
        out = F.when(F.lower(name).endswith(ending.lower()), kind).otherwise(out)
    return out


def marker(value: Column, known: list[str]) -> Column:
    """A header that marks a message with one of the ``known`` values, blanks aside; another value is 'other', none is null."""
    v = F.trim(value)
    return F.when(v.isNull(), None).when(v.isin(known), v).otherwise("other")


def sniffed(content: Column, name: Column) -> Column:
    """What bytes are, by their first ones, else by the name's ending, else text."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(8) == "89504E470D0A1A0A", "image/png").when(head(3) == "FFD8FF", "image/jpeg").when(head(6).isin("474946383761", "474946383961"), "image/gif")
        .when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp").when(head(5) == "255044462D", "application/pdf")
        .otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv]), F.lower(F.substring_index(name, ".", -1))), F.lit("text/plain")))
    )


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes: by byte order mark, UTF-8, else Windows-1252 if it holds no NUL and few controls; else null."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for mark, kind in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if b.startswith(mark):
                return b[len(mark) :].decode(kind, "replace")
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            controls = len(b) - len(b.translate(None, _BYTE_CONTROLS))
            return None if 0 in b or controls * 100 > len(b) else b.decode("cp1252", "same-code")

    return content.map(one)


_BYTE_CONTROLS = bytes(x for x in range(32) if x not in (9, 10, 12, 13))
# bytes that the code page leaves out stand for the control characters of the same number
codecs.register_error("same-code", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))


@F.pandas_udf(StringType())
def folded(name: pd.Series) -> pd.Series:
    """The form under which names are the same: composed, in small letters."""
    return name.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).lower())


_INVISIBLE = re.compile("[\x00-\x1f\x7f-\x9f\xa0\xad͏؜ᅟᅠ ឴឵᠋-᠏ -‏ -  -⁯⠀　ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff]")


@F.pandas_udf(StringType())
def escaped(name: pd.Series) -> pd.Series:
    """A name with what can't be seen or typed as \\u{...}; a backslash that would begin such an escape as \\u{5C}."""
    return name.map(lambda s: None if s is None else _INVISIBLE.sub(lambda m: f"\\u{{{ord(m[0]):X}}}", re.sub(r"\\(?=u\{)", r"\\u{5C}", s)))


@F.pandas_udf(StringType())
def unescaped(shown: pd.Series) -> pd.Series:
    """The name that an escaped one stands for."""

    def back(m: re.Match) -> str:
        n = int(m[1], 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return shown.map(lambda s: None if s is None else re.sub(r"\\u\{([0-9A-Fa-f]{1,6})\}", back, s))


# Endings of lines that introduce a quotation.
ATTRIBUTIONS = ("wrote:", "a écrit :", "a écrit:", "schrieb:", "escribió:")


def unquoted(text: str, forward: bool = False) -> tuple[str, int]:
    """A plain body without quoted replies, and how many lines that showed something went.

    Lines marked ``>`` go with the line that introduces them; an original that
    a mail program put below goes to the end, except in a forward. Answers
    between quoted lines stay.
    """
    lines = re.split(r"\r?\n", text)
    marked = [x.lstrip().startswith(">") for x in lines]

    def original(i: int) -> bool:
        bare = lines[i].strip()
        return bare.startswith("--") and bare.strip("-").strip().lower() == "original message" or bare.startswith("From:") and any(x.lstrip().startswith("Sent:") for x in lines[i + 1 : i + 4])

    end = len(lines) if forward else next((i for i in range(len(lines)) if original(i)), len(lines))
    gone = set(range(end, len(lines))) | {i for i in range(end) if marked[i]}
    for i in range(end):
        if not marked[i] and lines[i].rstrip().endswith(ATTRIBUTIONS):
            later = [j for j in range(i + 1, end) if lines[j].strip()]
            if not later or marked[later[0]]:
                gone.add(i)
                if i and lines[i - 1].lstrip().startswith("On "):
                    gone.add(i - 1)
    kept = [x for i, x in enumerate(lines) if i not in gone]
    kept = [x for i, x in enumerate(kept) if x.strip() or i == 0 or kept[i - 1].strip()]
    return "\n".join(kept).rstrip(), sum(bool(lines[i].strip()) for i in gone)


@F.pandas_udf(StructType().add("text", StringType()).add("removed", LongType()))
def without_quotes(text: pd.Series, forward: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else unquoted(t, bool(f)) for t, f in zip(text, forward)]
    return pd.DataFrame(rows, columns=["text", "removed"])


class _Shown(html.parser.HTMLParser):
    """Visible text of HTML, block elements on lines of their own; quotations left out on demand."""

    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "hr", "pre"}
    VOID = {"br", "hr", "img", "meta", "link", "input", "wbr"}

    def __init__(self, drop_quotes: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped: list[str] = []
        self.drop_quotes = drop_quotes

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            if tag == self.skipped[0] and tag not in self.VOID:
                self.skipped.append(tag)
            return
        kind = dict(attrs).get("class") or ""
        quote = self.drop_quotes and (tag == "blockquote" or tag == "div" and ("_quote" in kind or "cite-prefix" in kind))
        if tag in ("script", "style", "head", "title") or quote:
            self.skipped = [tag]
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
        elif tag in self.BLOCKS and tag != "br":
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(source: str, drop_quotes: bool = False) -> str:
    p = _Shown(drop_quotes)
    p.feed(source)
    p.close()
    lines = [x.strip() for x in "".join(p.out).split("\n")]
    return "\n".join(x for i, x in enumerate(lines) if x or (i and lines[i - 1])).strip()


@F.pandas_udf(StringType())
def shown(source: pd.Series) -> pd.Series:
    """The visible text of HTML."""
    return source.map(lambda s: None if s is None else html_text(s))


@F.pandas_udf(StringType())
def shown_without_quotes(source: pd.Series) -> pd.Series:
    """The visible text of HTML outside quotations; of the whole if nothing else is left."""
    return source.map(lambda s: None if s is None else html_text(s, True) or html_text(s))


# How the subject of a forwarded message begins.
FORWARDS = ("fw:", "fwd:", "tr:", "wg:")


def readable(body: str, is_html: bool, subject: str | None, quotes_removed: bool = True) -> tuple[str, int]:
    """A body as text, and how many lines that showed something went with its quotations; those of a forward's original stay."""
    text = (html_text(body) if is_html else body).rstrip()
    if not quotes_removed:
        return text, 0
    lines = lambda t: sum(bool(x.strip()) for x in t.splitlines())
    kept, _ = unquoted(html_text(body, True) if is_html else text, (subject or "").lower().startswith(FORWARDS))
    return kept, max(0, lines(text) - lines(kept))


@F.pandas_udf(StructType().add("text", StringType()).add("removed", LongType()))
def readable_body(body: pd.Series, is_html: pd.Series, subject: pd.Series) -> pd.DataFrame:
    """``text`` without quotations, ``removed`` lines; null for null."""
    rows = [(None, None) if b is None else readable(b, bool(h), s) for b, h, s in zip(body, is_html, subject)]
    return pd.DataFrame(rows, columns=["text", "removed"])


def uri_path(path: Column) -> Column:
    """A path for a URI: everything but ASCII letters, digits, ``-._~`` and ``/`` percent-encoded."""
    out = F.url_encode(path)
    for found, put in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def pages(text: Column) -> Column:
    """The pages that form feeds part; a last form feed opens none, line feeds at a page's end go."""
    return F.transform(F.split(F.regexp_replace(text, "\f$", ""), "\f"), lambda p: F.regexp_replace(p, "\n+$", ""))


def page_starts(parts: Column) -> Column:
    """The offset of each page when pages are joined by one character."""
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p) + 1))


def saved_name(index: Column, name: Column) -> Column:
    """What an attachment is saved as: its index, then the last part of its name without controls, at most 120 characters, escaped."""
    base = F.regexp_extract(F.coalesce(name, F.lit("attachment")), r"([^/\\]*)$", 1)
    return F.concat(index.cast("string"), F.lit("-"), escaped(F.substring(F.regexp_replace(base, r"\p{Cc}", ""), 1, 120)))


def one_name(name: Column) -> Column:
    """A name that can stand in a folder; null for an empty one, ``.``, ``..`` and one with a slash."""
    return F.when((name != "") & ~name.isin(".", "..") & ~name.contains("/"), name)


def uid_shaped(text: Column) -> Column:
    """Whether a text has the form of a node's uid: two ids of 22 or 88 to 108 characters with a tilde between."""
    # Fixed value: the form of such an id
    part = "([a-zA-Z0-9=_-]{88,108}|[a-zA-Z0-9_-]{22})"
    return text.rlike(f"^{part}~{part}$")
