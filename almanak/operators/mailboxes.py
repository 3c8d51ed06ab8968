"""Mailboxes: their listing, which one a search covers, and what Trash and Spam take from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanak.plans.querylang import Query

#: Roles that ``in:`` names; ``all`` is the mailbox that holds every message.
ROLES = ("inbox", "sent", "drafts", "archive", "starred", "spam", "trash", "all")
#: Where labels and folders stand.
PREFIXES = ("Labels/", "Folders/")
#: Mailboxes that an account may have at most, for their names come to the driver.
MOST_MAILBOXES = 100_000


class MailboxError(ValueError):
    """A search names a mailbox that is not there, or more than one."""


def kind(mailbox: Column) -> Column:
    return F.when(mailbox.startswith(PREFIXES[0]), "label").when(mailbox.startswith(PREFIXES[1]), "folder").otherwise("system")


class Mailboxes:
    """``listing`` (``mailbox``, ``role``, ``selectable``) and ``membership`` (``mailbox``, ``internal_id``).

    A mailbox without a role has null; one that is not selectable only holds
    others and is never searched. The listing is small by nature (bounded by
    MOST_MAILBOXES, beyond which it is refused); the membership is not.
    """

    def __init__(self, listing: DataFrame, membership: DataFrame):
        self.listing, self.membership = listing, membership
        self._rows: list[tuple[str, str | None]] | None = None

    def _names(self) -> list[tuple[str, str | None]]:
        if self._rows is None:
            rows = self.listing.filter("mailbox is not null and coalesce(selectable, true)").select("mailbox", F.lower("role").alias("role")).limit(MOST_MAILBOXES + 1).collect()
            if len(rows) > MOST_MAILBOXES:
                raise MailboxError(f"an account has at most {MOST_MAILBOXES} mailboxes")
            self._rows = [(r.mailbox, r.role) for r in rows]
        return self._rows

    def by_role(self, role: str) -> str:
        found = [name for name, r in self._names() if r == role]
        if not found:
            raise MailboxError(f"there is no mailbox for {role}")
        return found[0]

    def label(self, asked: str) -> str:
        """The one label or folder of a name, case aside, given with its prefix or without."""
        low = asked.lower()
        found = [name for name, _ in self._names() if name.startswith(PREFIXES) and low in (name.lower(), name.split("/", 1)[1].lower())]
        if not found:
            raise MailboxError(f"{asked!r} is no label and no folder")
        if len(found) > 1:
            raise MailboxError(f"{asked!r} is a label and a folder; say which: {' or '.join('label:' + x for x in sorted(found))}")
        return found[0]

    def of(self, query: Query) -> str:
        """The mailbox that a query covers."""
        return self.label(query.label) if query.scope == "label" else self.by_role(query.scope)

    def members(self, mailbox: str) -> DataFrame:
        return self.membership.filter(F.col("mailbox") == mailbox).select("internal_id").distinct()

    def trash_and_spam(self) -> DataFrame:
        """The ids of all messages in Trash or Spam."""
        return self.membership.filter(F.col("mailbox").isin(self.by_role("trash"), self.by_role("spam"))).select("internal_id").distinct()

    def shown(self) -> DataFrame:
        """``mailbox``, ``kind``, ``role``, ``selectable`` of every mailbox."""
        return self.listing.select("mailbox", kind(F.col("mailbox")).alias("kind"), F.lower("role").alias("role"), F.coalesce("selectable", F.lit(True)).alias("selectable"))
