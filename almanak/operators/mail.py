"""Messages: scope, search pages, collapsed copies and threads, counts, labels and threads read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import text as T
from almanak.operators.mailboxes import Mailboxes
from almanak.plans import querylang
from almanak.plans.paging import Cursor, page_size

#: Messages of a thread that are read at most, and characters of a page of it.
THREAD_MOST, THREAD_CHARS = 50, 30_000


def message_view(messages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Messages as the search reads them: ``uid``, ``date_s``, flags, bare addresses, copy key, thread, attachments.

    Messages without a date come last by date; those without a thread are a
    thread of their own; those without a Message-Id are no copies of any.
    """
    mid = F.nullif(F.trim("message_id"), F.lit(""))
    has = lambda flag: F.coalesce(F.array_contains("flags", flag), F.lit(False))
    m = messages.select(
        F.col("msg_no").alias("uid"), F.col("internal_id"), F.coalesce(F.unix_seconds(F.col("internaldate").cast("timestamp")), F.lit(0)).alias("date_s"), F.col("internaldate").alias("sent"),
        F.col("from_addr"), F.col("to_addrs"), F.col("subject"), has("Seen").alias("seen"), has("Flagged").alias("flagged"),
        T.bare_address(F.col("from_addr")).alias("sender"), F.coalesce("thread_id", "internal_id").alias("thread"),
        F.when(mid.isNotNull(), F.struct(mid.alias("mid"), F.coalesce("from_addr", F.lit("")).alias("frm"), F.coalesce("subject", F.lit("")).alias("subject"))).alias("copy_key"),
        (F.col("attachments") if "attachments" in messages.columns else F.when(F.col("content_type").startswith("multipart/mixed"), 1).otherwise(0)).cast("int").alias("attachments"),
        *[(F.col(c) if c in messages.columns else F.lit(None).cast("array<string>")).alias(c) for c in ("cc_addrs", "bcc_addrs")],
    )
    if parts is None:
        return m
    body = parts.groupBy(F.col("msg_no").alias("uid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return m.join(body, "uid", "left")


def with_body_hits(view: DataFrame, parts: DataFrame, query: querylang.Query) -> tuple[DataFrame, dict[str, Column]]:
    """A view with one flag for each word or phrase of a query: whether a part of the message holds it.

    The parts are tested beside their scan; what moves is a row of flags for
    each message with any, never a text. Phrases don't reach from one part
    into the next.
    """
    words = sorted({t.value for t in querylang.terms(query) if t.what == "text"})
    if not words:
        return view, {}
    holds = {w: F.coalesce(F.contains(F.lower("text"), F.lit(w.lower())), F.lit(False)) for w in words}
    flags = parts.select(F.col("msg_no").alias("uid"), *[c.alias(f"_w{k}") for k, c in enumerate(holds.values())])
    flags = flags.filter(" or ".join(f"_w{k}" for k in range(len(words)))).groupBy("uid").agg(*[F.max(f"_w{k}").alias(f"_w{k}") for k in range(len(words))])
    return view.join(flags, "uid", "left"), {w: F.coalesce(f"_w{k}", F.lit(False)) for k, w in enumerate(words)}


def columns(view: DataFrame, in_body: dict[str, Column] | None = None) -> querylang.MailColumns:
    """Where a message view keeps what the search language asks about."""
    c = F.col
    listed = lambda name: F.array_join(name, ", ")
    headers = F.concat_ws("\n", c("from_addr"), listed("to_addrs"), listed("cc_addrs"), c("subject"))
    return querylang.MailColumns(
        date=c("sent"), seen=c("seen"), flagged=c("flagged"), attachments=c("attachments"),
        fields={"from": c("from_addr"), "to": listed("to_addrs"), "cc": listed("cc_addrs"), "bcc": listed("bcc_addrs"), "subject": c("subject")},
        text=F.concat_ws("\n", headers, c("body")) if "body" in view.columns else headers, in_body=in_body or {},
    )


def search(view: DataFrame, query: querylang.Query, boxes: Mailboxes | None = None, parts: DataFrame | None = None, include_trash: bool = False) -> DataFrame:
    """The messages of a query's scope that meet it.

    Without ``boxes`` the view is the mailbox searched, and only ``starred``
    narrows it. With them ``in:`` and ``label:`` name a mailbox (an error if
    none or several have the name), and the scopes all, starred and label leave
    out what is in Trash or Spam too, unless asked not to. ``parts`` are the
    texts that words and phrases are looked for in.
    """
    df, in_body = with_body_hits(view, parts, query) if parts is not None else (view, {})
    if boxes is None:
        if query.scope == "label":
            raise ValueError("a label needs the mailboxes")
        df = df.filter("flagged") if query.scope == "starred" else df
    else:
        df = df.join(boxes.members(boxes.of(query)), "internal_id", "left_semi")
        if leaves_trash_out(query, include_trash):
            df = without(df, boxes.trash_and_spam())
    return df.filter(querylang.plan(query, columns(df, in_body))).select(*view.columns)


def leaves_trash_out(query: querylang.Query, include_trash: bool = False) -> bool:
    """All, starred and label hold copies of what is in Trash or Spam; other mailboxes don't."""
    return not include_trash and query.scope in ("all", "starred", "label")


def estimated_total(view: DataFrame, query: querylang.Query, boxes: Mailboxes, parts: DataFrame | None = None, include_trash: bool = False) -> DataFrame:
    """``estimated_total``, one row: the hits, less those in Trash and Spam where all is searched; null with an attachment test.

    A guide to a result's size, as a mail server gives it before any message is
    read: of a label's or the starred hits those in Trash and Spam stay in.
    """
    if query.attachment is not None:
        return view.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("estimated_total"))
    left = include_trash or query.scope != "all"
    return search(view, query, boxes, parts, include_trash=left).agg(F.count("*").alias("estimated_total"))


#: Addresses that a result row lists before it only counts the rest.
ROW_ADDRESSES = 3


def result_rows(view: DataFrame) -> DataFrame:
    """Hits as a result shows them: short id, first addresses and how many more, clean subject; unset and empty lists are null.

    ``hidden`` counts the characters that cleaning took from the row.
    """
    first = lambda c: F.nullif(F.slice(c, 1, ROW_ADDRESSES), F.array().cast("array<string>"))
    more = lambda c: F.nullif(F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))) - ROW_ADDRESSES, F.lit(0)), F.lit(0)).cast("bigint")
    clean = lambda c: F.transform(c, T.clean)
    length = lambda c: F.coalesce(F.length(F.array_join(c, "")), F.lit(0))
    to, cc = F.col("to_addrs"), F.col("cc_addrs")
    hidden = F.coalesce(T.hidden_count(F.col("subject")), F.lit(0)) + F.coalesce(T.hidden_count(F.col("from_addr")), F.lit(0)) + length(to) - length(clean(to)) + length(cc) - length(clean(cc))
    return view.select(
        "uid", "date_s", T.short_id(F.col("internal_id")).alias("message_id"), "thread", T.clean(F.col("from_addr")).alias("from"), first(clean(to)).alias("to"), more(to).alias("to_more"),
        first(clean(cc)).alias("cc"), more(cc).alias("cc_more"), T.clean(F.col("subject")).alias("subject"), (~F.col("seen")).alias("unread"), F.col("flagged").alias("starred"), "attachments", hidden.cast("bigint").alias("hidden"))


def hidden_sum(page: DataFrame) -> DataFrame:
    """``hidden``, one row: what cleaning took from the rows that are shown."""
    return page.agg(F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden"))


def without(view: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages whose full id is not among ``ids``."""
    return view.join(ids.select("internal_id").distinct(), "internal_id", "left_anti")


def in_order(newest_first: bool = True) -> list[Column]:
    return [F.desc("date_s"), F.desc("uid")] if newest_first else [F.asc("date_s"), F.asc("uid")]


def search_page(view: DataFrame, size: int | None = None, newest_first: bool = True, cursor: Cursor | None = None, validity: int = 1) -> DataFrame:
    """One page in the total order (date, uid), after a cursor, with ``row_no``: narrow columns are sorted, wide ones joined to the page.

    The page comes in its order; its last row is where the next one begins.
    """
    hits = view.select("date_s", "uid")
    if cursor is not None:
        hits = hits.filter(cursor.after(F.col("date_s"), F.col("uid"), newest_first, validity))
    page = hits.orderBy(*in_order(newest_first)).limit(page_size("mail", size))
    page = page.select("uid", F.row_number().over(W.orderBy(*in_order(newest_first))).cast("bigint").alias("row_no"))  # over a page
    return view.join(F.broadcast(page), "uid").orderBy("row_no")


def next_cursor(page: DataFrame, newest_first: bool = True, validity: int = 1) -> Cursor | None:
    """The cursor after a page's last row; none for an empty page."""
    last = page.orderBy(F.desc("row_no")).select("date_s", "uid").limit(1).collect()
    return Cursor(newest_first, validity, last[0].date_s, last[0].uid) if last else None


def collapse(view: DataFrame, size: int, newest_first: bool = True) -> DataFrame:
    """Rows of a page: copies fold into their first hit, hits of one thread into the first of it.

    ``matching`` counts the distinct hits of a row, ``copies`` the others;
    unread and starred hold if they do for any hit. Hits from the one that
    would open row ``size`` + 1 on do not count. Closed form of a greedy pass:
    a hit stands with its copy's first hit, and its thread is that one's.
    """
    # a key of their own keeps messages without a copy key apart and spread over tasks
    key = F.coalesce(F.to_json("copy_key"), F.concat(F.lit("\x00"), F.col("uid").cast("string")))
    df = view.select("uid", "date_s", "thread", "seen", "flagged", key.alias("_key"))
    # the first hit of each copy key by an aggregate that combines before the shuffle, so a key with very many copies is one row a task
    ends = F.max if newest_first else F.min
    firsts = df.groupBy("_key").agg(ends(F.struct("date_s", "uid", "thread")).alias("_f")).select("_key", F.col("_f.thread").alias("_row"), F.col("_f.uid").alias("_first_uid"))
    df = df.join(firsts, "_key").withColumn("_is_first", F.col("uid") == F.col("_first_uid"))
    place = F.struct("date_s", "uid")
    openers = df.groupBy("_row").agg((F.max(place) if newest_first else F.min(place)).alias("_open"))
    page = openers.orderBy(F.desc("_open") if newest_first else F.asc("_open")).limit(size + 1)
    number = F.row_number().over(W.orderBy(F.desc("_open") if newest_first else F.asc("_open")))  # over at most size + 1 rows
    page = page.withColumn("row_no", number)
    cut = F.max(F.when(F.col("row_no") == size + 1, F.col("_open"))).over(W.partitionBy(F.lit(1)))
    page = F.broadcast(page.withColumn("_cut", cut).filter(F.col("row_no") <= size))
    hits = df.join(page, "_row")
    inside = F.col("_cut").isNull() | ((place > F.col("_cut")) if newest_first else (place < F.col("_cut")))
    rows = hits.filter(inside).groupBy("row_no", "_row").agg(
        F.max("_open.uid").alias("uid"), F.sum(F.col("_is_first").cast("bigint")).alias("matching"), F.sum((~F.col("_is_first")).cast("bigint")).alias("copies"), F.max(~F.col("seen")).alias("unread"), F.max("flagged").alias("starred"))
    return rows.select(F.col("row_no").cast("bigint").alias("row_no"), F.col("_row").alias("thread"), "uid", "matching", "copies", "unread", "starred")


def distinct_messages(counted: DataFrame) -> DataFrame:
    """Counted deliveries without later copies: of one copy key the newest stays; a key without a ``mid`` is never a copy.

    Ties of ``sent_s`` go by ``delivery_no``; a null date is the oldest.
    """
    mid = F.col("copy_of.mid")
    key = F.when(mid.isNotNull(), F.to_json(F.struct(mid, F.col("copy_of.from_addr"), F.col("copy_of.subject")))).otherwise(F.concat(F.lit("\x00"), F.col("delivery_no").cast("string")))
    newest = F.max(F.struct(F.coalesce("sent_s", F.lit(-(2**62))), "delivery_no"))
    # a map-side combined aggregate, not a window: a key with very many copies costs one row a task
    kept = counted.groupBy(key.alias("_key")).agg(newest.alias("k")).select(F.col("k.delivery_no").alias("delivery_no"))
    return counted.join(kept, "delivery_no", "left_semi")


GROUPS = ("from", "fromDomain", "to", "toDomain")


def grouped_count(counted: DataFrame, by: str, order: str = "count", limit: int | None = None) -> DataFrame:
    """Messages, newest and oldest by sender, recipient or their domains.

    A message counts once for each of its distinct keys, or for '(none)'.
    Orders: count (most first), newest, oldest; ties by newest, then key.
    """
    orders = {"count": [F.desc("messages"), F.desc("newest_s"), F.asc("key")], "newest": [F.desc("newest_s"), F.asc("key")], "oldest": [F.asc("oldest_s"), F.asc("key")]}
    return _groups(counted, by).orderBy(*orders[order]).limit(page_size("groups", limit))


def groups_total(counted: DataFrame, by: str) -> DataFrame:
    """``groups_total``, one row: how many groups there are, whatever a page shows."""
    return _groups(counted, by).agg(F.count("*").alias("groups_total"))


def _groups(counted: DataFrame, by: str) -> DataFrame:
    if by not in GROUPS:
        raise ValueError(f"by is one of {', '.join(GROUPS)}")
    lists = F.array("from_addr") if by.startswith("from") else F.coalesce("to_addrs", F.array().cast("array<string>"))
    clean = F.filter(F.transform(lists, lambda a: F.lower(F.trim(a))), lambda a: a.isNotNull() & (a != ""))
    if by.endswith("Domain"):
        clean = F.transform(clean, T.domain)
    keys = F.array_distinct(clean)
    rows = distinct_messages(counted).select(F.coalesce("sent_s", F.lit(0)).alias("date_s"), "delivery_no", F.explode(F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("(none)")))).alias("key"))
    at = F.struct("date_s", "delivery_no")
    groups = rows.groupBy("key").agg(F.count("*").alias("messages"), F.max(at).alias("newest"), F.min(at).alias("oldest"))
    return groups.select("key", "messages", F.col("newest.date_s").alias("newest_s"), F.col("newest.delivery_no").alias("newest_no"), F.col("oldest.date_s").alias("oldest_s"), F.col("oldest.delivery_no").alias("oldest_no"))


def label_counts(mailboxes: DataFrame, membership: DataFrame, view: DataFrame) -> DataFrame:
    """``mailbox``, ``messages``, ``unread`` of every mailbox, empty ones too."""
    m = membership.join(view.select("internal_id", "seen"), "internal_id").groupBy("mailbox").agg(F.count("*").alias("messages"), F.count_if(~F.col("seen")).alias("unread"))
    return mailboxes.select("mailbox").join(m, "mailbox", "left").fillna(0, ["messages", "unread"])


def thread_messages(view: DataFrame, most: int = THREAD_MOST) -> DataFrame:
    """The latest ``most`` messages of each thread, copies merged into the first by date, with ``copies`` and ``pos``."""
    latest = W.partitionBy("thread").orderBy(F.desc("uid"))
    v = view.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= most)
    key = F.coalesce(F.to_json("copy_key"), F.concat(F.lit("\x00"), F.col("uid").cast("string")))
    same = W.partitionBy("thread", key)
    v = v.withColumn("copies", (F.count("*").over(same) - 1)).withColumn("_c", F.row_number().over(same.orderBy("date_s", "uid"))).filter("_c = 1")
    return v.withColumn("pos", F.row_number().over(W.partitionBy("thread").orderBy("date_s", "uid")).cast("bigint")).drop("_n", "_c")


def thread_members(messages: DataFrame) -> DataFrame:
    """``root``, ``msg_no``: the messages of each thread root by their own id, their references or their reply; once each.

    Roots are those that messages name (``thread_key``); a message may belong to several.
    """
    bare = lambda c: F.split(F.concat_ws(" ", c), r"[\s<>]+")
    named = F.filter(F.array_distinct(F.concat(bare(F.array("message_id")), bare(F.col("ref_ids")), bare(F.array("in_reply_to")))), lambda x: x != "")
    ids = messages.select("msg_no", F.explode(named).alias("root"))
    roots = messages.select(T.thread_key(F.col("message_id"), F.col("ref_ids"), F.col("in_reply_to")).alias("root")).filter("root is not null").distinct()
    return ids.join(roots, "root").select("root", "msg_no").distinct()


def related(view: DataFrame, root: str) -> Column:
    """Whether a message belongs to a thread by its own id, its references or its reply."""
    wanted = F.lit(f"<{root}>")
    return (F.col("message_id") == wanted) | F.array_contains("ref_ids", wanted) | (F.col("in_reply_to") == wanted)


def character_pages(rows: DataFrame, key: str, pos: str, size: Column, budget: int = THREAD_CHARS, start: Column | int = 0) -> DataFrame:
    """One page of each ``key``: rows in order from the ``start``-th on (0 is the first) until the budget has been taken before them; always one.

    A key with no row there has no page.
    """
    skipped = F.row_number().over(W.partitionBy(key).orderBy(pos)) - 1
    rows = rows.withColumn("_at", skipped).filter(F.col("_at") >= start)
    before = F.coalesce(F.sum(size).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("chars_before", before).filter(F.col("chars_before") < budget).drop("_at")


def thread_page(rows: DataFrame, pos: str, size: Column, start: int = 0, budget: int = THREAD_CHARS) -> tuple[DataFrame, int | None]:
    """A page of one thread's rows (at most THREAD_MOST) from ``start`` on, and where the next begins; ValueError past the end."""
    n = rows.count()
    if start > n:
        raise ValueError(f"the thread has {n} messages; {start} is past its end")
    page = character_pages(rows.withColumn("_one", F.lit(1)), "_one", pos, size, budget, start).drop("_one")
    end = start + page.count()
    return page, end if end < n else None


def size_batches(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Ids in order, in groups of at most ``most`` bytes together; one that is larger stands alone."""
    out: list[list[int]] = []
    room = -1
    for uid, size in sizes:
        if size > room or not out:
            out.append([])
            room = most
        out[-1].append(uid)
        room -= size
    return out


def message_by_id(view: DataFrame, prefix: str) -> DataFrame:
    """The one message whose internal id begins with a prefix of at least 16 characters; ValueError if none or several do."""
    found = view.filter(T.id_matches(F.col("internal_id"), prefix)).limit(2)
    n = found.count()
    if n != 1:
        raise ValueError(f"{'no message has' if not n else 'several messages have'} an id that begins with {prefix}")
    return found


#: Bytes of an attachment that is given inline at most.
INLINE_MOST = 5 * 1024 * 1024


def attachment(messages: DataFrame, prefix: str, index: int) -> DataFrame:
    """Name, type, size, digest and (up to INLINE_MOST) base64 content of attachment ``index`` of a message (``internal_id``, ``attachments`` with ``content``)."""
    a = message_by_id(messages, prefix).select(F.get("attachments", F.lit(index)).alias("a")).filter("a is not null")
    inline = F.when(F.length("a.content") <= INLINE_MOST, F.base64("a.content"))
    return a.select(T.saved_name(F.lit(index), F.col("a.name")).alias("name"), T.sniffed(F.col("a.content"), F.col("a.name")).alias("type"), F.length("a.content").cast("bigint").alias("size"), F.sha2("a.content", 256).alias("sha256"), inline.alias("content"))
