"""Cursors and page tokens: where a list goes on, as a short text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least, usual and greatest page sizes by list.
SIZES = {"mail": (1, 20, 50), "events": (1, 50, 250), "files": (1, 25, 100), "folder": (1, 100, 200), "tree": (1, 100, 200), "groups": (1, 100, 1000), "text": (1, 20_000, 40_000)}


def page_size(kind: str, asked: int | None) -> int:
    least, usual, most = SIZES[kind]
    return usual if asked is None else max(least, min(most, asked))


@dataclass(frozen=True)
class Cursor:
    """A place in a list of messages in total order (date, uid)."""

    newest_first: bool
    validity: int
    date_s: int
    uid: int

    def token(self) -> str:
        return f"{'n' if self.newest_first else 'o'}.{self.validity}.{self.date_s}.{self.uid}"

    @classmethod
    def read(cls, token: str) -> Cursor:
        try:
            order, *numbers = token.split(".")
            validity, date_s, uid = map(int, numbers)
        except ValueError:
            raise ValueError(f"{token!r} is no page token") from None
        if order not in ("n", "o"):
            raise ValueError(f"{token!r} is no page token")
        return cls(order == "n", validity, date_s, uid)

    def after(self, date_s: Column, uid: Column, newest_first: bool, validity: int) -> Column:
        """What comes after this place. Under other uids (validity changed) its second comes again: rows may repeat, none is skipped."""
        if newest_first != self.newest_first:
            raise ValueError("a page token holds for the order it was made in")
        beyond = date_s < self.date_s if newest_first else date_s > self.date_s
        same = date_s == self.date_s
        if validity != self.validity:
            return beyond | same
        return beyond | (same & ((uid < self.uid) if newest_first else (uid > self.uid)))


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in order; past the end an empty page."""
    return df.orderBy(*order).offset(offset).limit(size)


def next_offset(offset: int, size: int, total: int) -> int | None:
    """Where the next page begins; none once a page reaches the end."""
    return offset + size if offset + size < total else None


def window_token(offset: int, from_s: int, to_s: int) -> str:
    """A page of events with its window, so that later pages keep it."""
    return f"{offset}.{from_s}.{to_s}"


def read_window_token(token: str) -> tuple[int, int, int]:
    try:
        offset, a, b = map(int, token.split("."))
    except ValueError:
        raise ValueError(f"{token!r} is no page token") from None
    return offset, a, b


def character_page(text: Column, offset: int, most: int | None = None, strict: bool = True) -> tuple[Column, Column, Column]:
    """Text of a page by characters, the offset of the next page or null, and the length of the whole.

    An offset past the end of the text is an error; with ``strict`` false the
    page is null instead, as for many texts at once.
    """
    size = page_size("text", most)
    total = F.length(text)
    past = F.raise_error(F.concat(F.lit(f"{offset} is past the end of a text of "), total.cast("string"), F.lit(" characters"))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(total < offset, past).otherwise(F.substring(text, offset + 1, size)), F.when(total > offset + size, F.lit(offset + size)), total


@dataclass(frozen=True)
class TreePlace:
    """A place in a tree in depth-first order: the folder whose entries come next, and how many of them have come."""

    folder: str
    skip: int

    def token(self, top: str) -> str:
        """As text, with a print of the folder that the listing covers and the place's folder in hexadecimal."""
        return f"{_print(top)}:{self.folder.encode().hex()}:{self.skip}"

    @classmethod
    def read(cls, token: str, top: str) -> TreePlace:
        try:
            of, folder, skip = token.split(":")
            place = cls(bytes.fromhex(folder).decode(), int(skip))
        except ValueError:
            raise ValueError(f"{token!r} is no page token") from None
        if of != _print(top) or place.skip < 0:
            raise ValueError("a page token holds for the folder that its listing began with")
        return place


def _print(folder: str) -> str:
    return hashlib.sha256(folder.encode()).hexdigest()[:16]
