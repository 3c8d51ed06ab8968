"""Mixing sources to target weights (problem 8).

Every mix takes as many tokens as its scarcest source allows at its share and
its cap of repeats. A source's documents stand in hashed order; passes over them
make its stream, which is cut into blocks of a fixed number of tokens, or of the
longest document's where that is more. Pfair scheduling gives block j of a
source with share w the release time floor(j / w) and the deadline
ceil((j + 1) / w); earliest deadline first then interleaves the streams, so that
in blocks every source is always less than one away from its share. The
documents that begin in a block stand in its slot, so in tokens one block and
the longest documents at the ends of the others' blocks come to that; the query
p8_deviation reports the worst.

The schedule has as many blocks as the corpus needs. It is made in ranges of
slots, each by itself: at the begin of a range every source has had the blocks
whose deadline is past, and those with the greatest remainders one more, which a
Pfair schedule can always reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.llm import encode
from almanak.session import checkpoint

#: Tokens of a block, unless a document is longer.
BLOCK_TOKENS = 16_384
#: Slots of a range of the schedule: at least so many, and more where a share is below one in so many, up to the second.
SLOTS, MOST_SLOTS = 4_096, 65_536
#: Hash ranges a source is split into for its running sums: at least so many, and one more for every so many documents.
RANGES, RANGE_DOCS = 512, 50_000


def source_key(c: Column) -> Column:
    """Sources differ neither by case nor by outer white space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def sized_documents(documents: DataFrame, name: str = encode.TOKENIZER, folder: str = encode.TOKENIZERS) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of documents with a source and at least one token."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("source is not null and source <> '' and text <> ''")
    return encode.token_counts(d, name, folder).filter("n_tokens > 0")


def solve(targets: DataFrame, totals: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per mix and source of ``targets``: what the mix takes of it.

    ``weight`` null, negative or zero takes nothing; ``max_repeats`` null means
    once. Rows that name a source of a mix twice add their weights and keep the
    larger cap. The shares of sources without documents go to the others in
    proportion; ``target_share`` is the share asked for, ``goal_share`` the one
    that is possible.
    """
    t = targets.select("mix_no", source_key(F.col("source")).alias("source"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
    t = t.filter("mix_no is not null and source is not null and source <> ''").groupBy("mix_no", "source").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
    t = t.join(totals, "source", "left").fillna(0, ["docs", "tokens"])
    mix = W.partitionBy("mix_no")
    live = (F.col("weight") > 0) & (F.col("tokens") > 0) & (F.col("cap") > 0)
    t = t.withColumn("target_share", F.when(F.sum("weight").over(mix) > 0, F.col("weight") / F.sum("weight").over(mix)).otherwise(0.0))
    t = t.withColumn("goal_share", F.when(live, F.col("weight") / F.sum(F.when(live, F.col("weight"))).over(mix)).otherwise(0.0))
    t = t.withColumn("total", F.coalesce(F.floor(F.min(F.when(live, F.col("tokens") * F.col("cap") / F.col("goal_share"))).over(mix)), F.lit(0)).cast("bigint"))
    return t.withColumn("quota", F.least(F.round(F.col("total") * F.col("goal_share")).cast("bigint"), (F.col("tokens") * F.col("cap")).cast("bigint"))).withColumn("block", F.lit(block).cast("bigint"))


def exact(shares: dict[str, float]) -> dict[str, Fraction]:
    """Positive shares as fractions that add up to one."""
    near = {s: Fraction(w).limit_denominator(10**9) or Fraction(w) for s, w in shares.items() if w > 0}
    return {s: w / sum(near.values()) for s, w in near.items()}


def range_slots(weights: Iterable[float]) -> int:
    """Slots of a range: enough that even the least share has a block in each, within bounds."""
    least = min((w for w in weights if w > 0), default=1.0)
    return min(MOST_SLOTS, max(SLOTS, ceil(1 / least)))


def had(weights: dict[str, Fraction], slot: int, slots: int) -> dict[str, int]:
    """Blocks that each source has had before a slot where a range begins.

    Those whose deadline is past, and one more for the greatest remainders,
    until all slots are used. Shares without a block in every range are
    rounded by themselves, so that no later range takes one back.
    """
    small = {s for s, w in weights.items() if w * slots < 1}
    out = {s: floor(w * slot + Fraction(1, 2)) if s in small else floor(w * slot) for s, w in weights.items()}
    left = slot - sum(out.values())
    rest = sorted((s for s, w in weights.items() if s not in small and w * slot > out[s]), key=lambda s: (out[s] - weights[s] * slot, s))
    for s in rest[: max(0, left)]:
        out[s] += 1
    return out


def pfair(weights: dict[str, Fraction], begin: dict[str, int], until: dict[str, int], slot: int = 0, last: int | None = None) -> list[tuple[str, int]]:
    """Source and block of the slots from ``slot`` on: the blocks from ``begin`` to ``until`` of each source.

    Earliest deadline first among the released blocks, ties by share, then
    name; no block is due after ``last``.
    """
    due = lambda s, j: ceil((j + 1) / weights[s]) if last is None else min(last, ceil((j + 1) / weights[s]))
    waiting = [(max(slot, floor(begin[s] / weights[s])), s, begin[s]) for s in weights if begin[s] < until[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, Fraction, str, int]] = []
    out: list[tuple[str, int]] = []
    now = slot
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), -weights[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < until[s]:
            heapq.heappush(waiting, (floor((j + 1) / weights[s]), s, j + 1))
        now += 1
    return out


def n_ranges(shares: dict[str, float], needed: dict[str, int]) -> int:
    return max(1, ceil(sum(needed.values()) / range_slots(shares.values())))


def schedule_range(shares: dict[str, float], needed: dict[str, int], number: int) -> list[tuple[str, int, int]]:
    """Source, block and slot of range ``number`` of a schedule that gives each source the blocks it needs."""
    weights, slots = exact(shares), range_slots(shares.values())
    at = lambda k: {s: min(needed[s], n) for s, n in had(weights, k * slots, slots).items()}
    begin, final = at(number), number == n_ranges(shares, needed) - 1
    order = pfair(weights, begin, needed if final else at(number + 1), number * slots, None if final else (number + 1) * slots)
    base = sum(begin.values())
    return [(s, j, base + k) for k, (s, j) in enumerate(order)]


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for mix, number, sources in zip(frame["mix_no"], frame["number"], frame["sources"]):
            shares, needed = {x["source"]: x["share"] for x in sources}, {x["source"]: x["needed"] for x in sources}
            rows = [(mix, *x) for x in schedule_range(shares, needed, number)]
            yield pd.DataFrame(rows, columns=["mix_no", "source", "block_no", "slot"]).astype({"mix_no": "int64", "block_no": "int64", "slot": "int64"})


class Mix:
    """The plan of all mixes over a corpus."""

    def __init__(self, documents: DataFrame, targets: DataFrame, name: str = encode.TOKENIZER, folder: str = encode.TOKENIZERS, block: int = BLOCK_TOKENS):
        self.sizes = checkpoint(sized_documents(documents, name, folder))
        totals = self.sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
        most = self.sizes.groupBy("source").agg(F.max("n_tokens").alias("n"), F.count("*").alias("docs")).agg(F.max("n").alias("n"), F.max("docs").alias("docs")).first()
        self.block = max(block, most.n or 0)
        self.ranges = max(RANGES, (most.docs or 0) // RANGE_DOCS)
        self.plan = checkpoint(solve(targets, totals, self.block))
        self.slots = self._all_slots()

    def _all_slots(self) -> DataFrame:
        """``mix_no``, ``source``, ``block_no``, ``slot``: every block that holds a use (one begins before its source's quota), ranges made in parallel."""
        live = self.plan.filter("quota > 0").select("mix_no", F.struct("source", F.col("goal_share").alias("share"), F.ceil(F.col("quota") / F.col("block")).alias("needed")).alias("x"))
        mixes = live.groupBy("mix_no").agg(F.sort_array(F.collect_list("x")).alias("sources"), F.sum("x.needed").alias("needed"), F.min("x.share").alias("least"))
        slots = F.least(F.lit(MOST_SLOTS), F.greatest(F.lit(SLOTS), F.ceil(1 / F.col("least"))))  # as in range_slots
        ranges = mixes.withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("needed") / slots) - 1)))
        return ranges.select("mix_no", "number", "sources").repartition("mix_no", "number").mapInPandas(_slots, "mix_no bigint, source string, block_no bigint, slot bigint")

    def _ordered(self) -> DataFrame:
        """Sizes with ``offset``, the tokens of the source before the document in hashed order."""
        h = self.sizes.withColumn("h", F.xxhash64(F.lit(8), "source", "doc_id")).withColumn("r", F.pmod("h", F.lit(self.ranges)))
        sums = h.groupBy("source", "r").agg(F.sum("n_tokens").alias("n"))
        before = sums.select("source", "r", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "r").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return h.withColumn("inside", inside).join(before, ["source", "r"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("inside")).alias("offset"))

    def uses(self) -> DataFrame:
        """``mix_no``, ``source``, ``doc_id``, ``pass``, ``n_tokens``, ``start``: every use of a document, placed in its source's stream."""
        plan = self.plan.filter("quota > 0").select("mix_no", "source", "quota", "tokens", "block", "cap")
        u = self._ordered().join(plan, "source")
        # a use counts if its middle lies within the quota: the nearest the source's sum can come to it
        last = F.least(F.floor((F.col("quota") - F.col("offset") - F.col("n_tokens") / 2) / F.col("tokens")), F.col("cap") - 1)
        u = u.withColumn("last", last.cast("int")).filter("last >= 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return u.select("mix_no", "source", "doc_id", "pass", "n_tokens", (F.col("pass") * F.col("tokens") + F.col("offset")).alias("start"), "block")

    def schedule(self) -> DataFrame:
        """``mix_no``, ``slot``, ``place``, ``source``, ``doc_id``, ``pass``, ``n_tokens``: read by slot and place, the mix in order."""
        u = self.uses().withColumn("block_no", F.floor(F.col("start") / F.col("block")))
        return u.join(self.slots, ["mix_no", "source", "block_no"]).select("mix_no", "slot", (F.col("start") - F.col("block_no") * F.col("block")).alias("place"), "source", "doc_id", F.col("pass").cast("bigint").alias("pass"), "n_tokens")

    def shares(self) -> DataFrame:
        """One row per mix and source: shares asked for, possible and reached, and how often its documents were used."""
        used = self.uses().groupBy("mix_no", "source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("uses"), (F.max("pass") + 1).cast("bigint").alias("most_repeats"))
        p = self.plan.join(used, ["mix_no", "source"], "left").fillna(0, ["tokens_used", "uses", "most_repeats"])
        all_used = F.sum("tokens_used").over(W.partitionBy("mix_no"))
        reached = F.when(all_used > 0, F.col("tokens_used") / all_used).otherwise(0.0)
        six = lambda c: F.round(c, 6)
        return p.select("mix_no", "source", six("target_share").alias("target_share"), six("goal_share").alias("goal_share"), six(reached).alias("actual_share"), "tokens_used", "uses", "most_repeats", F.col("tokens").alias("tokens_there"), F.col("cap").cast("bigint").alias("max_repeats"))

    def deviation(self) -> DataFrame:
        """``mix_no``, ``source``, ``blocks``, ``worst_tokens``, ``worst_blocks``: how far the mix, read from its begin, was ever from the source's goal share.

        Looked at before and after each of the source's slots, where the
        difference is greatest. Running sums over ranges of slots, then within
        each, so no mix is in one task.
        """
        size = self.schedule().groupBy("mix_no", "slot", "source").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.floor(F.col("slot") / SLOTS))
        size = checkpoint(size)

        def before(keys: list[str]) -> DataFrame:
            sums = size.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
            earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
            return sums.select(*keys, "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))

        inside = lambda keys: F.coalesce(F.sum("n").over(W.partitionBy(*keys, "part").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = size.withColumn("all", inside(["mix_no"])).withColumn("own", inside(["mix_no", "source"]))
        rows = rows.join(before(["mix_no"]).withColumnRenamed("base", "all_base"), ["mix_no", "part"]).join(before(["mix_no", "source"]).withColumnRenamed("base", "own_base"), ["mix_no", "source", "part"])
        rows = rows.join(F.broadcast(self.plan.select("mix_no", "source", "goal_share")), ["mix_no", "source"])  # as many rows as there are targets
        all_, own = F.col("all") + F.col("all_base"), F.col("own") + F.col("own_base")
        off = F.greatest(F.abs(own - F.col("goal_share") * all_), F.abs(own + F.col("n") - F.col("goal_share") * (all_ + F.col("n"))))
        worst = rows.groupBy("mix_no", "source").agg(F.count("*").alias("blocks"), F.round(F.max(off), 3).alias("worst_tokens"))
        return worst.withColumn("worst_blocks", F.round(F.col("worst_tokens") / self.block, 3))
