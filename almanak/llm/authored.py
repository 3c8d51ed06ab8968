"""Only what the sender newly wrote: quoted mail, signatures and legal text taken out (problem 4).

Lines are exploded in a normalised form, without marks, so that a line and its
quotation are equal. Then, in this order,

* rank: within (thread, line) the first occurrence by date is the authored one.
  A later message's line is a quotation if enough of the earlier message's
  lines come with it, and so are the lines that stand beside it in the same order;
* recur: within (sender, line) messages are counted. Lines at the end of what a
  sender wrote that recur in others of the sender's messages are closing lines;
* form: what the archive holds no other occurrence of goes by its marks, boxes
  and place (lines.py): a quotation of mail that is not there, or a signature
  that its sender used once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import text as T
from almanak.llm.lines import CLOSING, INTRO, LEGAL, QUOTE, SIGNATURE, TEXT, label_lines, shown_lines
from almanak.session import checkpoint

#: Labels as they travel with the lines.
CODES = {label: code for code, label in enumerate((TEXT, CLOSING, QUOTE, INTRO, SIGNATURE, LEGAL))}
#: Lines from this length on tell a quotation on their own; shorter ones only beside such.
LEAST_CHARS = 25
#: An earlier message is quoted by a message that has so many of its long lines, or this share of them.
LEAST_LINES, LEAST_SHARE = 3, 1 / 3
#: A closing line recurs in so many messages of its sender.
LEAST_MESSAGES = 2


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part_no", "is_html", "text")]
        part, line, norm, size, label, long = [], [], [], [], [], []
        for no, is_html, text in zip(*columns):
            rows = label_lines(text, is_html)
            part += [no] * len(rows)
            long += [sum(len(n) >= LEAST_CHARS for _, n, _ in rows)] * len(rows)
            for at, n, lb in rows:
                line.append(at)
                norm.append(n or None)
                size.append(len(n))
                label.append(CODES[lb])
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int8(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((part, line, norm, size, label, long), types)], ["part_no", "line_no", "norm", "size", "label", "long"])


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def labelled_lines(parts: DataFrame) -> DataFrame:
    """``part_no``, ``line_no``, ``key`` (hash of the normalised text, null if nothing is left), ``is_long``, ``label`` (a code), ``long`` (long lines of the part)."""
    p = parts.select("part_no", is_html(F.col("content_type")).alias("is_html"), "text").filter("part_no is not null and text is not null and text <> ''")
    rows = p.mapInArrow(_labels, "part_no bigint, line_no int, norm string, size int, label tinyint, long int")
    return rows.select("part_no", "line_no", F.when(F.col("norm").isNotNull(), F.xxhash64("norm")).alias("key"), (F.col("size") >= LEAST_CHARS).alias("is_long"), "label", "long")


def _origin(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """``part_no``, ``thread``, ``sender``, ``sent``, ``msg_no``, ``message``: where a part comes from; copies of a message are one message.

    A message without a thread or a sender has one of its own, so that none is hot.
    """
    m = messages.select("msg_no", F.col("thread_id").alias("thread"), T.bare_address(F.col("from_addr")).alias("sender"), F.col("internaldate").alias("sent"), F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.col("msg_no").cast("string")).alias("message"))
    m = m.filter("msg_no is not null").dropDuplicates(["msg_no"])
    return parts.select("part_no", "msg_no").join(m, "msg_no", "left")


def decided_lines(parts: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """``part_no``, ``line_no``, ``step``: lines that show something and were not newly written by the sender, and what told it.

    Parts of threads that any request reads raw have none; those without a
    thread do. Null and empty texts have none. Equal dates go by ``msg_no``;
    messages without a date count as the latest. A message whose every line
    recurs keeps them, unless their form tells otherwise.
    """
    raw = requests.filter("raw and thread_id is not null").select(F.col("thread_id").alias("thread")).distinct()
    alone = lambda c, of: F.coalesce(c, F.concat(F.lit("\x00"), F.coalesce(F.col(of).cast("string"), F.lit("")), F.lit(" "), F.col("part_no").cast("string")))
    kept = _origin(parts, messages).join(raw, "thread", "left_anti")
    kept = kept.select("part_no", F.xxhash64(alone(F.col("thread"), "message")).alias("thread"), F.xxhash64(alone(F.col("sender"), "msg_no")).alias("sender"), F.coalesce("sent", F.lit("9999-12-31").cast("timestamp")).alias("sent"), "msg_no", F.xxhash64(F.coalesce("message", F.concat(F.lit("\x00"), F.col("part_no").cast("string")))).alias("message"))
    rows = checkpoint(labelled_lines(parts).join(kept, "part_no"))  # labelling is the dear part: once

    # who had a line first, and how often its sender has it, by aggregates that combine before the shuffle: a hot line is one row a task
    first = F.min(F.struct("sent", "msg_no", "part_no", "line_no", "message", "long"))
    firsts = rows.filter("key is not null").groupBy("thread", "key").agg(first.alias("f")).select("thread", "key", F.col("f.message").alias("first"), F.col("f.long").alias("first_long"))
    labelled = lambda *of: F.col("label").isin(*[CODES[x] for x in of])
    own = ~labelled(QUOTE, INTRO)
    recurs = rows.filter(own & F.col("key").isNotNull()).select("sender", "key", "message").distinct().groupBy("sender", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_MESSAGES).select("sender", "key", F.lit(True).alias("recurs"))
    # of a line that an earlier message had: a short name of that message, and how many long lines are enough
    later = F.col("first") != F.col("message")
    enough = F.when(later, F.least(F.lit(LEAST_LINES), F.ceil(F.col("first_long") * LEAST_SHARE)).cast("tinyint"))
    rows = rows.join(firsts, ["thread", "key"], "left").select("part_no", "line_no", "is_long", "label", "sender", "key", F.when(later, F.hash("first")).alias("earlier"), enough.alias("enough"))
    rows = rows.join(recurs, ["sender", "key"], "left").select("part_no", "line_no", "is_long", "label", "earlier", "enough", F.coalesce("recurs", F.lit(False)).alias("recurs"))
    part = W.partitionBy("part_no")
    down, up = part.orderBy("line_no"), part.orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    # successive lines that one earlier message had, with marks or without, are an island
    kind = F.struct("earlier", own.alias("own"))
    anew = F.coalesce(kind != F.lag(kind).over(down), F.lit(True))
    rows = rows.withColumn("island", F.sum(F.when(anew, 1).otherwise(0)).over(down.rowsBetween(W.unboundedPreceding, W.currentRow)))
    long = F.col("earlier").isNotNull() & F.col("is_long")
    rows = rows.withColumn("backed", F.count(F.when(long, True)).over(W.partitionBy("part_no", "earlier")))
    sure = long & (~own | (F.col("backed") >= F.col("enough")))
    ranked = F.col("earlier").isNotNull() & (~own | F.max(sure).over(W.partitionBy("part_no", "island")))
    rows = rows.withColumn("ranked", ranked)
    # the end of what the sender wrote: lines after which only recurring ones and signatures come
    mine = own & ~F.col("ranked")
    ending = F.min(F.when(mine, F.col("recurs") | labelled(SIGNATURE, LEGAL))).over(up)
    rows = rows.withColumn("ending", mine & F.coalesce(ending, F.lit(False)))
    says = F.max(mine & ~F.col("ending")).over(part)
    step = F.when(F.col("ranked"), "rank").when(F.col("ending") & F.col("recurs") & says, "recur").when(~labelled(TEXT, CLOSING), "form")
    return rows.withColumn("step", step).filter("step is not null").select("part_no", F.col("line_no").cast("bigint").alias("line_no"), "step")


def not_written_lines(parts: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """``part_no``, ``line_no``: lines that show something and were not newly written by the sender; see ``decided_lines``."""
    return decided_lines(parts, messages, requests).select("part_no", "line_no").distinct()


def authored_text(parts: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """``part_no``, ``text``: each part reduced to what its sender newly wrote; whole for threads read raw, null for null.

    Of HTML the visible text is given, except where the part stays whole. Runs
    of blank lines shrink to one.
    """
    gone = not_written_lines(parts, messages, requests).groupBy("part_no").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    raw = requests.filter("raw and thread_id is not null").select(F.col("thread_id").alias("thread")).distinct()
    whole = _origin(parts, messages).join(raw, "thread", "left_semi").select("part_no", F.lit(True).alias("whole"))

    @F.pandas_udf("string")
    def reduce(text: pd.Series, as_html: pd.Series, drop: pd.Series, keep: pd.Series) -> pd.Series:
        out = []
        for t, h, d, k in zip(text, as_html, drop, keep):
            if t is None or k:
                out.append(t)
                continue
            d = set(d) if d is not None else set()
            lines = [x for i, x in enumerate(shown_lines(t, bool(h))[0], 1) if i not in d]
            lines = [x for i, x in enumerate(lines) if x.strip() or (i and lines[i - 1].strip())]
            out.append("\n".join(lines).strip("\n"))
        return pd.Series(out, dtype=object)

    p = parts.select("part_no", is_html(F.col("content_type")).alias("is_html"), "text").join(gone, "part_no", "left").join(whole, "part_no", "left")
    return p.select("part_no", reduce("text", "is_html", "gone", F.coalesce("whole", F.lit(False))).alias("text"))


def whole_texts(parts: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """``part_no``, ``text`` of the parts that stay whole, as ``authored_text`` gives them."""
    raw = requests.filter("raw and thread_id is not null").select(F.col("thread_id").alias("thread")).distinct()
    whole = _origin(parts, messages).join(raw, "thread", "left_semi").select("part_no")
    return authored_text(parts, messages, requests).join(whole, "part_no", "left_semi")


def line_faults(parts: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """What the lines found keep: one row per part with text, all counts of faults 0.

    ``outside``, lines that the text does not have; ``blank``, lines that show
    nothing; ``raw``, lines of parts that stay whole.
    """
    lines = F.split("text", "\n")
    n = not_written_lines(parts, messages, requests).groupBy("part_no").agg(F.collect_list("line_no").alias("found"))
    raw = requests.filter("raw and thread_id is not null").select(F.col("thread_id").alias("thread")).distinct()
    whole = _origin(parts, messages).join(raw, "thread", "left_semi").select("part_no", F.lit(True).alias("whole"))
    p = parts.filter("text is not null and text <> ''").select("part_no", lines.alias("lines")).join(n, "part_no", "left").join(whole, "part_no", "left")
    count = lambda of: F.coalesce(F.size(F.filter("found", of)), F.lit(0)).cast("bigint")
    size = F.size("lines")
    empty = lambda k: F.get("lines", (k - 1).cast("int")).rlike(r"^\s*$")
    return p.select("part_no", size.cast("bigint").alias("n_lines"), count(lambda k: (k < 1) | (k > size)).alias("outside"), count(empty).alias("blank"), F.when(F.col("whole"), F.coalesce(F.size("found"), F.lit(0))).otherwise(0).cast("bigint").alias("raw"))
