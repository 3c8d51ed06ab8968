"""Overlapping intervals per entity, to continuous periods and the gaps between them (problem 3).

A mergeable aggregate holds, per entity and time bucket, two sorted lists of
disjoint intervals. Partial lists are made beside the scan, merged over salted
groups, then over whole buckets; periods that run on into later buckets are
closed by a window over one summary row a bucket, so that no task ever holds an
entity, only one bucket of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import zones as Z

#: Seconds in a bucket. A bucket's list can't hold more than half as many intervals.
BUCKET_S = 28 * 86400
SALTS = 8
STATE = "feed_no bigint, bucket bigint, begins array<bigint>, untils array<bigint>"


def combine(key: np.ndarray, bucket: np.ndarray, begin: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted disjoint intervals of each (key, bucket); intervals that touch are one."""
    order = np.lexsort((begin, bucket, key))
    key, bucket, begin, until = key[order], bucket[order], begin[order], until[order]
    if not len(key):
        return key, bucket, begin, until
    new_group = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
    group = np.cumsum(new_group)
    base = min(int(begin.min()), int(until.min()))
    span = int(until.max()) - base + 2
    if span * (int(group[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(until - base + group * span) - group * span + base
    else:  # times too far apart to be stacked in 64 bits
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(until, np.flatnonzero(new_group)[1:])])
    fresh = new_group.copy()
    fresh[1:] |= begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(begin)] - 1
    return key[first], bucket[first], begin[first], reach[last]


def _lists(key: np.ndarray, bucket: np.ndarray, begin: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]) if len(key) else np.array([], int)
    offsets = pa.array(np.r_[first, len(key)].astype("int32"))
    columns = [pa.array(key[first]), pa.array(bucket[first]), pa.ListArray.from_arrays(offsets, pa.array(begin)), pa.ListArray.from_arrays(offsets, pa.array(until))]
    return pa.RecordBatch.from_arrays(columns, ["feed_no", "bucket", "begins", "untils"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    b, u = batch.column("begins"), batch.column("untils")
    lengths = np.asarray(b.value_lengths())
    rep = lambda c: np.repeat(np.asarray(batch.column(c)), lengths)
    return rep("feed_no"), rep("bucket"), np.asarray(b.flatten()), np.asarray(u.flatten())


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if x.num_rows:
            yield _lists(*combine(*(np.asarray(x.column(c)) for c in ("feed_no", "bucket", "begin_s", "until_s"))))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the lists of batches sorted by group; a group that goes on in the next batch is carried as its merged list."""
    held: tuple[np.ndarray, ...] | None = None
    for x in batches:
        if not x.num_rows:
            continue
        rows = _flat(x)
        if held is not None:
            rows = tuple(np.concatenate(p) for p in zip(held, rows))
        merged = combine(*rows)
        key, bucket = merged[:2]
        open_group = (key == key[-1]) & (bucket == bucket[-1])
        held = tuple(p[open_group] for p in merged)
        if not open_group.all():
            yield _lists(*(p[~open_group] for p in merged))
    if held is not None:
        yield _lists(*held)


def duration_parts(text: Column) -> tuple[Column, Column]:
    """Days and seconds of an iCalendar duration; null where it is unreadable, negative or nothing."""
    t = F.upper(F.trim(text))
    shape = r"^\+?P(?:(\d{1,6})W|(?:(\d{1,6})D)?(?:T(?=\d)(?:(\d{1,8})H)?(?:(\d{1,9})M)?(?:(\d{1,10})S)?)?)$"
    n = lambda i: F.coalesce(F.regexp_extract(t, shape, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    days, seconds = n(1) * 7 + n(2), n(3) * 3600 + n(4) * 60 + n(5)
    fine = t.rlike(shape) & (days + seconds > 0)
    return F.when(fine, days), F.when(fine, seconds)


def event_spans(events: DataFrame) -> DataFrame:
    """``feed_no``, ``begin_s``, ``until_s`` of the events that cover any time.

    An event lasts until ``ends`` where that is later than its start; else for
    its readable, positive duration; else, if a date, one day; else it covers
    nothing. Durations of dates are counted on the wall clock. Null starts and
    null feeds are left out; a null or unknown zone is UTC.
    """
    e = events.select("feed_no", "starts", "ends", "duration").filter("starts.wall is not null and feed_no is not null")
    e = Z.with_zone(Z.with_zone(e, F.col("starts.tz"), "_sz"), F.col("ends.tz"), "_ez")
    days, seconds = duration_parts(F.col("duration"))
    utc = F.lit("UTC")
    e = e.select("feed_no", F.lower("starts.kind").eqNullSafe("date").alias("whole_day"), F.coalesce("_sz", utc).alias("sz"), F.coalesce("_ez", utc).alias("ez"), Z.wall_us(F.col("starts.wall")).alias("sw"), Z.wall_us(F.col("ends.wall")).alias("ew"), days.alias("days"), seconds.alias("seconds"))
    lasting = (F.col("days") * 86400 + F.col("seconds")) * 1000000
    e = e.withColumn("b", Z.local_to_utc_us(F.col("sw"), F.col("sz"))).withColumn("u", Z.local_to_utc_us(F.col("ew"), F.col("ez")))
    e = e.withColumn(
        "u",
        F.when(F.col("u") > F.col("b"), F.col("u"))
        .when(F.col("whole_day"), Z.local_to_utc_us(F.col("sw") + F.coalesce(lasting, F.lit(86400000000)), F.col("sz")))
        .otherwise(F.col("b") + lasting),
    )
    second = lambda c: F.floor(F.col(c) / 1000000).cast("bigint")
    return e.select("feed_no", second("b").alias("begin_s"), second("u").alias("until_s")).filter("until_s > begin_s")


def periods_and_gaps(spans: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """``feed_no``, ``what`` ('period' or 'gap'), ``begin_s``, ``until_s`` over spans of the same columns.

    Empty input gives an empty result; ties and repeated rows merge.
    """
    parts = spans.select("feed_no", F.floor(F.col("begin_s") / bucket_s).cast("bigint").alias("bucket"), "begin_s", "until_s").mapInArrow(_partial, STATE)
    parts = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = parts.repartition("feed_no", "bucket", "_salt").sortWithinPartitions("feed_no", "bucket").select("feed_no", "bucket", "begins", "untils").mapInArrow(_merge, STATE)
    lists = salted.repartition("feed_no", "bucket").sortWithinPartitions("feed_no", "bucket").mapInArrow(_merge, STATE)
    in_order = W.partitionBy("feed_no").orderBy("bucket")
    carry = lists.select("feed_no", "bucket", F.element_at("untils", -1).alias("_last")).withColumn("_carry", F.max("_last").over(in_order.rowsBetween(W.unboundedPreceding, -1)))
    lists = lists.join(carry.select("feed_no", "bucket", "_carry"), ["feed_no", "bucket"])
    # intervals up to the carry run on from an earlier bucket; the one after them opens a period, and closes the one before
    skipped = F.when(F.col("_carry").isNull(), 0).otherwise(F.size(F.filter("begins", lambda b: b <= F.col("_carry"))))
    lists = lists.withColumn("_skip", skipped)
    before = F.when(F.col("_skip") == 0, F.col("_carry")).otherwise(F.greatest("_carry", F.get("untils", F.col("_skip") - 1)))
    lists = lists.withColumn("_before", F.when(F.col("_skip") < F.size("begins"), before)).withColumn("_opens", F.col("_skip") < F.size("begins"))
    brief = lists.select("feed_no", "bucket", "_opens", "_before", F.greatest(F.element_at("untils", -1), "_carry").alias("_reach"))
    # the next bucket that opens a period: from the last bucket back, so that every row adds to what is known
    later = W.partitionBy("feed_no").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    close = F.coalesce(F.last(F.when(F.col("_opens"), F.col("_before")), ignorenulls=True).over(later), F.max("_reach").over(W.partitionBy("feed_no")))
    brief = brief.withColumn("_close", close).select("feed_no", "bucket", "_close")
    out = lists.filter("_opens").join(brief, ["feed_no", "bucket"]).select("feed_no", "_skip", "_before", "_close", "untils", F.posexplode("begins").alias("i", "begin_s")).filter("i >= _skip")
    until = F.coalesce(F.get("untils", F.when(F.col("i") < F.size("untils") - 1, F.col("i"))), F.col("_close"))
    previous = F.when(F.col("i") == F.col("_skip"), F.col("_before")).otherwise(F.get("untils", F.col("i") - 1))
    both = F.array(F.struct(F.lit("period").alias("what"), F.col("begin_s").alias("begin_s"), until.alias("until_s")), F.struct(F.lit("gap").alias("what"), previous.alias("begin_s"), F.col("begin_s").alias("until_s")))
    return out.select("feed_no", F.explode(both).alias("r")).select("feed_no", "r.what", "r.begin_s", "r.until_s").filter("begin_s is not null")


def busy_periods(events: DataFrame) -> DataFrame:
    """The continuous busy periods of each calendar and the gaps between them."""
    return periods_and_gaps(event_spans(events))
