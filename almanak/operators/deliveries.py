"""Messages delivered more than once: one delivery of each, and the links between deliveries (problem 2).

A message has up to two identifiers, its full id and its copy key. Fingerprints
of 128 bits of the cleaned identifiers are shuffled, no strings, into as many
shards as keep each within a task's memory. A shard is read in order of time
buckets: a Bloom filter per bucket screens the identifiers that are definitely
new, and the possible repeats are looked up exactly in the sorted storage of
just those buckets whose filter let them pass. Eight successive buckets merge
into a longer one, so an identifier meets few filters however long the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanak.operators.components import components

INVISIBLE = r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻\x{E0000}-\x{E0FFF}]"
OUTER = r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$"
#: Seconds in a time bucket.
BUCKET_S = 7 * 86400
#: Bits a key has in a filter, about one false pass in 400.
BITS = 16
#: Keys that one shard holds at most on average (24 bytes each, and 2 in filters): what a task keeps in memory, whatever the table's size.
SHARD_KEYS = 2_000_000
#: Buckets that stand beside each other before they are merged into one of the next level, so that a key meets few filters.
FANOUT = 8
LINK = -(2**62)  # the bucket of rows that are links already


def cleaned(c: Column) -> Column:
    """An identifier without invisible characters and outer white space; null if nothing is left. Case stays."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), OUTER, ""), F.lit(""))


def _prints(kind: int, *parts: Column) -> list[Column]:
    """Two independent hashes of 64 bits; a null part differs from every text."""
    known = [F.coalesce(p, F.lit("\x00")) for p in parts]
    return [F.xxhash64(F.lit(2 * kind + i), *known) for i in (0, 1)]


def _within_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of the rows of one identifier in a batch the least goes on; the others become links to it."""
    for x in batches:
        if not x.num_rows:
            continue
        h, g, b, n = (np.asarray(x.column(c)) for c in ("h", "g", "bucket", "no"))
        order = np.lexsort((n, g, h))
        h, g, b, n = h[order], g[order], b[order], n[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        head = n[np.flatnonzero(first)[np.cumsum(first) - 1]]
        link = ~first & (n != head)
        keep = first | link
        h, g, b = np.where(link, n, h)[keep], np.where(link, head, g)[keep], np.where(link, LINK, b)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h, g, b, n[keep])], ["h", "g", "bucket", "no"])


class Segment:
    """The keys of one time bucket: a register-blocked Bloom filter before sorted storage."""

    def __init__(self, h: np.ndarray, g: np.ndarray, n: np.ndarray):
        self.h, self.g, self.n = h, g, n
        words = 1 << max(3, int(len(h) * BITS / 64).bit_length())
        self.mask = np.uint64(words - 1)
        self.words = np.zeros(words, np.uint64)
        where, bits = self.place(h, g)
        np.bitwise_or.at(self.words, where, bits)

    def place(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, one = g.view(np.uint64), np.uint64(1)
        bits = np.zeros(len(u), np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= one << ((u >> np.uint64(shift)) & np.uint64(63))
        return (h.view(np.uint64) & self.mask).astype(np.int64), bits

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are stored here, and the delivery of each: the filter first, then the exact look-up of what it let pass."""
        where, bits = self.place(h, g)
        possible = np.flatnonzero((self.words[where] & bits) == bits)
        if not len(possible):
            return possible, possible
        at = np.searchsorted(self.h, h[possible])
        found, owner = [], []
        for step in range(4):  # equal first hashes stand together; more than a few don't occur
            near = np.minimum(at + step, len(self.h) - 1)
            same = (self.h[near] == h[possible]) & (self.g[near] == g[possible]) & (at + step < len(self.h))
            found.append(possible[same])
            owner.append(self.n[near[same]])
        return np.concatenate(found), np.concatenate(owner)


def merged(segments: list[Segment]) -> Segment:
    """The storage of several buckets as that of one longer bucket."""
    h, g, n = (np.concatenate([getattr(s, c) for s in segments]) for c in "hgn")
    order = np.lexsort((g, h))
    return Segment(h[order], g[order], n[order])


def _seen_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a shard sorted by bucket: every delivery with an identifier seen before, to the delivery stored for it."""
    levels: list[list[Segment]] = [[]]
    current: list[np.ndarray] = []
    bucket = None

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keep = a != b
        a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def settle() -> pa.RecordBatch:
        """All rows of one bucket: repeats within it by sorting, repeats of earlier ones by filters and storage."""
        h, g, n = (np.concatenate(p) for p in zip(*current))
        order = np.lexsort((n, g, h))
        h, g, n = h[order], g[order], n[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        a, b = [n[~first]], [n[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]]
        h, g, n = h[first], g[first], n[first]
        new = np.ones(len(h), bool)
        for s in (s for level in levels for s in level):
            at = np.flatnonzero(new)
            hit, owner = s.find(h[at], g[at])
            a.append(n[at[hit]])
            b.append(owner)
            new[at[hit]] = False
        if new.any():
            levels[0].append(Segment(h[new], g[new], n[new]))
            for k in range(len(levels)):
                if len(levels[k]) == FANOUT:
                    if k + 1 == len(levels):
                        levels.append([])
                    levels[k + 1].append(merged(levels[k]))
                    levels[k] = []
        return rows(np.concatenate(a), np.concatenate(b))

    for x in batches:
        h, g, k, n = (np.asarray(x.column(c)) for c in ("h", "g", "bucket", "no"))
        link = k == LINK
        if link.any():
            yield rows(h[link], g[link])
        for part in np.split(np.flatnonzero(~link), np.flatnonzero(np.diff(k[~link])) + 1):
            if len(part):
                if k[part[0]] != bucket and current:
                    yield settle()
                    current = []
                bucket = k[part[0]]
                current.append((h[part], g[part], n[part]))
    if current:
        yield settle()


def delivery_links(counted: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """``u`` > ``v``: pairs of deliveries that share an identifier, enough to connect all that do."""
    c = counted.select(
        F.col("delivery_no").alias("no"),
        F.coalesce(F.floor(F.unix_micros(F.col("received_at").cast("timestamp")) / (bucket_s * 1000000)), F.lit(-1)).cast("bigint").alias("bucket"),
        cleaned(F.col("id")).alias("id"), cleaned(F.col("copy_of.mid")).alias("mid"), cleaned(F.col("copy_of.from_addr")).alias("frm"), cleaned(F.col("copy_of.subject")).alias("subject"),
    ).filter("no is not null")
    key = lambda kind, *parts: F.struct(*[p.alias(a) for p, a in zip(_prints(kind, *parts), "hg")])
    keys = F.array_compact(F.array(F.when(F.col("id").isNotNull(), key(1, F.col("id"))), F.when(F.col("mid").isNotNull(), key(2, F.col("mid"), F.col("frm"), F.col("subject")))))
    rows = c.select("no", "bucket", F.explode(keys).alias("k")).select("k.h", "k.g", "bucket", "no")
    rows = rows.mapInArrow(_within_batch, "h bigint, g bigint, bucket bigint, no bigint")
    # a shard must fit into a task: as many shards as the table needs, more than the session's own number only if that is too low
    shards = -(-2 * counted.count() // SHARD_KEYS)
    usual = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(shards, "h", "g") if shards > usual else rows.repartition("h", "g")
    return rows.sortWithinPartitions("bucket").mapInArrow(_seen_before, "u bigint, v bigint")


def repeated_deliveries(counted: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """``first_no``, ``repeat_no``: every delivery of a message but the one with the lowest number, with that number.

    Two deliveries are of one message if their cleaned ``id`` is the same, or
    their cleaned ``mid`` (not null, not blank), ``from_addr`` and ``subject``
    are (null being equal to null), or if a chain of such deliveries links
    them. Null and blank ids link nothing. Rows of one ``delivery_no`` are one
    delivery. An empty table gives an empty result.
    """
    return components(delivery_links(counted, bucket_s)).select(F.col("root").alias("first_no"), F.col("node").alias("repeat_no"))


def without_repeats(counted: DataFrame) -> DataFrame:
    """Exactly one delivery, the one with the lowest number, of each message; all columns."""
    repeats = repeated_deliveries(counted).select(F.col("repeat_no").alias("delivery_no"))
    return counted.join(repeats, "delivery_no", "left_anti").dropDuplicates(["delivery_no"])
