"""Long exact spans shared between documents (problem 9).

A sampled de Bruijn graph: tokens are code points, k-mers are its edges, and of
every 61 successive k-mers of a text the least by hash is an anchor, so that any
span of 180 code points holds at least one. Anchors that occur in several texts
are linked to their successors, and nonbranching paths of them compact through
joins. Around the ends of these paths every window of 180 code points is an edge
of its own, and paths and windows compact once more to runs: nonbranching
stretches that the same texts share, each a span of at least 180 code points.
All pairs come from runs, by source coordinates: each text that has a run
brings the code points that stand there, and only texts whose code points are
equal are a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.llm.screen import Screen, only
from almanak.session import checkpoint

#: Least length of a shared span, code points of a k-mer, and k-mers of which one is an anchor: K + WINDOW - 1 = SPAN.
SPAN, K, WINDOW = 180, 120, 61
#: Texts that a task remembers having scanned, so as to scan copies once: a bound on memory, not on what is found.
REMEMBERED = 200_000
#: Code points hashed at a time, to stay within the processor's caches and the worker's memory.
CHUNK = 400_000

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hashed:
    """Hashes of any stretch of a sequence of code points, by prefix sums modulo 2**64."""

    def __init__(self, points: np.ndarray):
        power, self.inverse = _power(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    def at(self, positions: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.sums[positions + k] - self.sums[positions]) * self.inverse[positions])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) of every ``width`` successive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the anchors of texts that are hashed together."""
    points = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    hashes = Hashed(points).every(K) | np.uint64(1)
    least = _sliding(hashes, WINDOW, np.minimum)
    least[owner[: len(least)] != owner[SPAN - 1 :]] = 0  # windows over two texts choose nothing
    pad = np.zeros(WINDOW - 1, np.uint64)
    chosen = hashes == _sliding(np.r_[pad, least, pad], WINDOW, np.maximum)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1 : len(hashes)] == owner[: len(hashes) - 1])]
    if same.any():  # within a run of one character every WINDOW-th k-mer and the last are enough
        place = np.arange(len(hashes))
        place -= np.maximum.accumulate(np.where(same, 0, place))
        chosen &= (place % WINDOW == 0) | np.r_[~same[1:], True]
    at = np.flatnonzero(chosen)
    return owner[at], at - starts[owner[at]], hashes[at]


def _scan(screen: Screen | None = None):
    """mapInArrow function: ``h``, ``t``, ``doc_id``, ``pos`` of every anchor that the screen lets pass; without one ``h`` and ``t``.

    Texts are cut into overlapping chunks, so that no window is lost. Of copies
    in one task the first stands for all.
    """

    def out(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        number, pos, h = anchors([p for *_, p in held])
        t = np.array([x[0] for x in held], np.int64)[number]
        h = h.view(np.int64)
        if screen is None:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(t)], ["h", "t"])
        keep = screen(h)
        number, pos, h, t = number[keep], pos[keep], h[keep], t[keep]
        pos = pos + np.array([x[2] for x in held], np.int64)[number]
        doc = np.array([x[1] for x in held], np.int64)[number]
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(t), pa.array(doc), pa.array(pos.astype(np.int32))], ["h", "t", "doc_id", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, size = [], 0
            for t, doc, text in zip(batch.column("t").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if t in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(t)
                points = code_points(text.as_py())
                for o in range(0, max(1, len(points) - SPAN + 1), CHUNK - SPAN + 1):
                    piece = points[o : o + CHUNK]
                    if len(piece) >= SPAN:
                        held.append((t, doc, o, piece))
                        size += len(piece)
                        if size >= CHUNK:
                            yield out(held)
                            held, size = [], 0
            if held:
                yield out(held)

    return run


def _edges_of_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``w``, ``t``, ``pos``: hashes of the windows of SPAN code points that hold an end of a path and stick out of it."""
    for batch in batches:
        ws, ts, ps = [], [], []
        for t, text, paths in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("paths")):
            points = code_points(text.as_py())
            hashed = Hashed(points)
            wanted = []
            for p in paths.as_py():
                wanted.append(np.arange(p["s"] + K - SPAN, p["s"]))
                wanted.append(np.arange(p["e"] - SPAN + 1, p["e"] - K + 1))
            at = np.unique(np.concatenate(wanted))
            at = at[(at >= 0) & (at + SPAN <= len(points))]
            ws.append(hashed.at(at, SPAN).view(np.int64))
            ts.append(np.full(len(at), t, np.int64))
            ps.append(at.astype(np.int32))
        if ws:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ws, ts, ps)], ["w", "t", "pos"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u``, ``t``, ``span``: the SPAN code points with which a text's runs begin."""
    for batch in batches:
        us, ts, spans = [], [], []
        for t, text, runs in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("runs")):
            points = code_points(text.as_py())
            for r in runs.as_py():
                us.append(r["u"])
                ts.append(t)
                spans.append(points[r["s"] : r["s"] + SPAN].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(ts, pa.int64()), pa.array(spans, pa.binary())], ["u", "t", "span"])


class SharedSpans:
    """Which texts share spans of at least SPAN code points, and where.

    Equal texts are one text ``t`` (a hash of 64 bits), so copies, however
    many, cost nothing until pairs of documents are asked for.
    """

    def __init__(self, documents: DataFrame):
        d = documents.select("doc_id", "text").filter("text is not null and doc_id is not null")
        self.texts = d.filter(F.length("text") >= SPAN).select("doc_id", F.xxhash64("text").alias("t"), "text")
        self.copies = d.filter(F.length("text") >= SPAN).select(F.xxhash64("text").alias("t"), F.sha2("text", 256).alias("digest"), "doc_id").distinct()
        of_texts = self.texts.select("t", "doc_id", "text")
        counted = of_texts.mapInArrow(_scan(), "h bigint, t bigint").groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"))
        repeated = checkpoint(counted.filter("a <> b").select("h"))
        # a second scan is cheaper than moving every anchor again: few are repeated
        rows = of_texts.mapInArrow(_scan(Screen(repeated)), "h bigint, t bigint, doc_id bigint, pos int")
        # copies fold before the join, whose hot anchors adaptive execution can then split: nothing after it needs the rows by anchor
        found = checkpoint(rows.groupBy("h", "t", "pos").agg(F.min("doc_id").alias("doc_id")).join(repeated, "h"))
        self.paths = checkpoint(self._compact(found))
        self.windows = self._windows()

    @staticmethod
    def _compact(found: DataFrame) -> DataFrame:
        """``t``, ``doc_id`` (the least of the text's), ``path``, ``s``, ``e``: the nonbranching paths of repeated anchors and where each text has them."""
        along = W.partitionBy("t").orderBy("pos")
        gap_on, gap_back = F.lead("pos").over(along) - F.col("pos"), F.col("pos") - F.lag("pos").over(along)
        link = lambda gap, h: F.when(gap <= K, F.xxhash64(h, gap)).otherwise(0)
        rows = found.withColumn("on", link(gap_on, F.lead("h").over(along))).withColumn("back", link(gap_back, F.lag("h").over(along)))
        one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
        nodes = rows.groupBy("h").agg(one("on").alias("one_on"), one("back").alias("one_back"))
        rows = rows.select("h", "t", "doc_id", "pos").join(nodes, "h")
        joined = F.coalesce(F.lag("one_on").over(along), F.lit(False)) & F.col("one_back")
        number = F.sum(F.when(joined, 0).otherwise(1)).over(along)
        rows = rows.withColumn("n", number)
        ends = rows.groupBy("t", "n").agg(F.min_by("h", "pos").alias("head"), F.min("pos").alias("s"), (F.max("pos") + K).alias("e"), F.min("doc_id").alias("doc_id"))
        return ends.select("t", "doc_id", F.xxhash64("head", F.col("e") - F.col("s")).alias("path"), "s", "e")

    def _windows(self) -> DataFrame:
        """``w``, ``t``, ``pos``: the windows at the ends of paths that several texts have."""
        ends = checkpoint(self.paths.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("paths")))
        texts = self.texts.select("doc_id", "t", "text").mapInArrow(only(Screen(ends.select("doc_id"))), "doc_id bigint, t bigint, text string")
        rows = texts.join(ends, "doc_id").select("t", "text", "paths").mapInArrow(_edges_of_paths, "w bigint, t bigint, pos int")
        rows = checkpoint(rows)
        several = rows.groupBy("w").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("w")
        return checkpoint(rows.join(several, "w"))

    def members(self) -> DataFrame:
        """``u``, ``t``, ``span``: which text has which run, with the code points it begins with.

        Runs with the same set of texts count once, by a signature of the set.
        """
        runs = checkpoint(self._runs().groupBy("u", "t").agg(F.min("s").alias("s")))
        sets = runs.groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "t")).alias("y")).filter("n > 1")
        chosen = sets.groupBy("n", "x", "y").agg(F.min("u").alias("u")).select("u")
        wanted = runs.join(chosen, "u").groupBy("t").agg(F.collect_list(F.struct("u", "s")).alias("runs"))
        wanted = checkpoint(wanted.join(self.paths.groupBy("t").agg(F.min("doc_id").alias("doc_id")), "t"))
        texts = self.texts.select("doc_id", "text").mapInArrow(only(Screen(wanted.select("doc_id"))), "doc_id bigint, text string")
        return checkpoint(texts.join(wanted, "doc_id").select("t", "text", "runs").mapInArrow(_slices, "u bigint, t bigint, span binary"))

    def text_pairs(self) -> DataFrame:
        """``a`` < ``b``: pairs of different texts that have a run in common, code point for code point."""
        members = self.members()
        left, right = members.select("u", "span", F.col("t").alias("a")), members.select("u", "span", F.col("t").alias("b"))
        return left.join(right, ["u", "span"]).filter("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """``doc_a`` < ``doc_b``: every pair of documents whose texts share a span, copies included."""
        a, b = self.copies.select(F.col("t").alias("a"), F.col("digest").alias("x"), F.col("doc_id").alias("i")), self.copies.select(F.col("t").alias("b"), F.col("digest").alias("y"), F.col("doc_id").alias("j"))
        between = self.text_pairs().join(a, "a").join(b, "b").select("i", "j")
        equal = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))).filter("i < j").select("i", "j")
        return between.unionByName(equal).select(F.least("i", "j").alias("doc_a"), F.greatest("i", "j").alias("doc_b"))

    def classes(self) -> DataFrame:
        """``doc_id``, ``class_id``, ``copies``, ``links``: one row per document of at least SPAN code points.

        ``class_id`` is the least document with the same text, ``copies``
        counts the others, ``links`` the other texts that share a span with it.
        """
        pairs = self.text_pairs()
        links = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).groupBy("t").agg(F.count("*").alias("links"))
        size = self.copies.groupBy("t", "digest").agg(F.min("doc_id").alias("class_id"), (F.count("*") - 1).alias("copies"))
        return self.copies.join(size, ["t", "digest"]).join(links, "t", "left").fillna(0, ["links"]).select("doc_id", "class_id", "copies", "links")

    def shares(self) -> DataFrame:
        """``doc_id``, ``n_chars``, ``shared_chars``, ``share``, ``copies``: how much of each document stands in others.

        A code point counts if it lies in a span of at least SPAN code points
        that another document has too. Texts with copies are shared as wholes;
        documents shorter than SPAN share nothing.
        """
        spans = self.paths.filter(F.col("e") - F.col("s") >= SPAN).select("t", "s", "e").unionByName(self.windows.select("t", F.col("pos").alias("s"), (F.col("pos") + SPAN).alias("e")))
        reach = F.max("e").over(W.partitionBy("t").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
        covered = spans.withColumn("r", F.coalesce(reach, F.lit(0))).groupBy("t").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "r"))).alias("c"))
        count = self.copies.select("t", "doc_id").groupBy("t").agg(F.count("*").alias("copies"))
        d = self.texts.select("doc_id", "t", F.length("text").cast("bigint").alias("n_chars")).join(count, "t").join(covered, "t", "left")
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0)).cast("bigint"))
        return d.select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"), (F.col("copies") - 1).alias("copies"))


    def _runs(self) -> DataFrame:
        """``t``, ``chain``, ``n``, ``u``, ``s``, ``e``: the shared windows of each text in order, compacted.

        Long paths and single windows are the steps; windows that begin one
        code point after another chain, and steps that follow each other in
        every text are one run ``u``.
        """
        steps = self.paths.filter(F.col("e") - F.col("s") >= SPAN).select(F.xxhash64(F.lit(2), "path").alias("g"), "t", "s", "e").unionByName(self.windows.select(F.xxhash64(F.lit(1), "w").alias("g"), "t", F.col("pos").alias("s"), (F.col("pos") + SPAN).alias("e")))
        along = W.partitionBy("t").orderBy("s")
        goes_on = F.lead("s").over(along) == F.col("e") - SPAN + 1
        came = F.coalesce(F.lag("e").over(along) - SPAN + 1 == F.col("s"), F.lit(False))
        link = lambda there, g: F.when(there, g).otherwise(0)
        rows = checkpoint(steps.withColumn("came", came).withColumn("on", link(goes_on, F.lead("g").over(along))).withColumn("back", link(came, F.lag("g").over(along))))
        one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
        nodes = rows.groupBy("g").agg(one("on").alias("one_on"), one("back").alias("one_back"))
        rows = rows.select("g", "t", "s", "e", "came").join(nodes, "g")
        joined = F.coalesce(F.lag("one_on").over(along), F.lit(False)) & F.col("one_back")
        rows = rows.withColumn("n", F.sum(F.when(joined, 0).otherwise(1)).over(along)).withColumn("chain", F.sum(F.when(F.col("came"), 0).otherwise(1)).over(along))
        runs = rows.groupBy("t", "chain", "n").agg(F.min_by("g", "s").alias("head"), F.min("s").alias("s"), F.max("e").alias("e"))
        return runs.select("t", "chain", "n", F.xxhash64("head", F.col("e") - F.col("s")).alias("u"), "s", "e")

    def text_spans(self) -> DataFrame:
        """``t``, ``begin``, ``end``, ``passage``: the maximal spans of each text that stand, whole, in a different text.

        From each run on, what follows is compared with the nearest of other
        texts in sorted order, which have most in common with it; so no pairs
        are made, however many texts share a passage. A run that repeats at
        once is one item with its count, so periodic texts stay small.
        """
        chain, along = W.partitionBy("t", "chain"), W.partitionBy("t", "chain").orderBy("n")
        anew = F.coalesce(F.lag("u").over(along) != F.col("u"), F.lit(True))
        items = self._runs().withColumn("i", F.sum(F.when(anew, 1).otherwise(0)).over(along)).groupBy("t", "chain", "i", "u").agg(F.count("*").alias("c"), F.min("s").alias("s"), F.min(F.col("e") - F.col("s")).alias("size"))
        later = F.collect_list(F.struct("u", "c", "s", "size")).over(chain.orderBy("i").rowsBetween(1, W.unboundedFollowing))
        rows = items.withColumn("later", later).withColumn("left", F.explode(F.sequence(F.col("c"), F.lit(1), F.lit(-1))))
        step = F.col("size") - SPAN + 1
        at = (F.col("s") + (F.col("c") - F.col("left")) * step).alias("s")
        rows = rows.withColumn("all", F.concat(F.array(F.struct("u", F.col("left").alias("c"), at, "size")), "later"))
        rows = rows.select("t", "chain", "u", "all", F.element_at("all", 1)["s"].alias("begin"), F.transform("all", lambda x: F.struct(x["u"].alias("u"), x["c"].alias("c"))).alias("us"))
        key, back = ["us", "t", "begin"], [F.desc("us"), F.desc("t"), F.desc("begin")]
        for name, order in (("up", W.partitionBy("u").orderBy(*key)), ("down", W.partitionBy("u").orderBy(*back))):
            rows = rows.withColumn(name, F.when(F.lag("t").over(order) != F.col("t"), F.lag("us").over(order)))
            rows = rows.withColumn(name, F.last(name, True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        rows = rows.withColumn("found", F.greatest(_common("up"), _common("down"))).filter("found is not null").select("t", "chain", "begin", "found.end", "found.passage")
        before = F.coalesce(F.lag("end").over(chain.orderBy("begin")), F.lit(-1))
        return rows.withColumn("before", before).filter("end > before").select("t", F.col("begin").cast("bigint").alias("begin"), F.col("end").cast("bigint").alias("end"), "passage")

    def spans(self) -> DataFrame:
        """``doc_id``, ``begin``, ``end``, ``passage``: every maximal span of at least SPAN code points that another document has too.

        A span is as long as any one other document allows, so spans shared
        with different documents may overlap; a text with copies is one span.
        Equal spans have one ``passage``.
        """
        found = self.text_spans()
        sizes = self.texts.groupBy("t").agg(F.count("*").alias("docs"), F.max(F.length("text")).cast("bigint").alias("size"))
        copied = sizes.filter("docs > 1")
        whole = copied.join(found, ["t"], "left").groupBy("t", "size").agg(F.max(F.when((F.col("begin") == 0) & (F.col("end") == F.col("size")), F.col("passage"))).alias("p"))
        whole = whole.select("t", F.lit(0).cast("bigint").alias("begin"), F.col("size").alias("end"), F.coalesce("p", F.xxhash64(F.lit(3), "t")).alias("passage"))
        parts = found.join(copied.select("t"), "t", "left_anti")
        return self.copies.select("t", "doc_id").join(parts.unionByName(whole), "t").select("doc_id", "begin", "end", "passage")


def _common(other: str) -> Column:
    """``end`` and ``passage`` of what ``all`` begins with in common with ``other``; null if nothing."""
    us, o = F.col("us"), F.col(other)
    differs = F.array_position(F.zip_with(us, o, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    m = F.when(differs > 0, differs - 1).otherwise(F.size(us)).cast("int")
    mine, its = F.get("all", m), F.get(o, m)
    # the first item that differs may be the same run, repeated more or less often
    more = F.when(mine["u"] == its["u"], F.least(mine["c"], its["c"]))
    last, count = F.when(more.isNotNull(), mine).otherwise(F.get("all", m - 1)), F.coalesce(more, F.get("all", m - 1)["c"])
    end = last["s"] + (count - 1) * (last["size"] - SPAN + 1) + last["size"]
    same = F.slice(us, F.lit(1), m)
    same = F.when(more.isNull(), same).otherwise(F.concat(same, F.array(F.struct(mine["u"].alias("u"), more.alias("c")))))
    return F.when(o.isNotNull() & ((m > 0) | more.isNotNull()), F.struct(end.alias("end"), F.xxhash64(same).alias("passage")))


def shared_pairs(documents: DataFrame) -> DataFrame:
    """``doc_a``, ``doc_b``: pairs whose texts share a span of at least SPAN code points; null and short texts share none."""
    return SharedSpans(documents).pairs()


def shared_classes(documents: DataFrame) -> DataFrame:
    """One row per document of at least SPAN code points: the class of its copies, and how many other texts share a span with it."""
    return SharedSpans(documents).classes()


def shared_amounts(documents: DataFrame) -> DataFrame:
    """One row per document of at least SPAN code points: how much of it stands elsewhere."""
    return SharedSpans(documents).shares()


def document_amounts(documents: DataFrame) -> DataFrame:
    """One row per document, whatever its text: how much of it stands elsewhere; null, empty and short texts share nothing."""
    every = documents.filter("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return every.join(shared_amounts(documents).drop("n_chars"), "doc_id", "left").fillna(0, ["shared_chars", "share", "copies"])


def shared_spans(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``begin``, ``end``, ``passage``: the maximal passages of at least SPAN code points that other documents have too."""
    return SharedSpans(documents).spans()
