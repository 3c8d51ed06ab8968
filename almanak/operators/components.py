"""Connected components over links, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanak.session import checkpoint


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours go to its least one, then its smaller ones and itself do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``u`` > ``v``, bigints) that is not its component's least.

    Nodes with one link, to a node without a smaller neighbour, are leaves:
    they take that node's root at the end. Only the rest is contracted round by
    round, each round checkpointed in the shared folder, so hot centres with
    very many leaves cost one aggregation with map-side combine.
    """
    edges = checkpoint(edges.select("u", "v").distinct())
    degree = edges.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n"))
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u")
    inner = checkpoint(inner)  # nodes that have smaller and larger neighbours
    up, own = inner.select(F.col("u").alias("p"), F.lit(True).alias("a")), inner.select("u", F.lit(True).alias("b"))
    joined = degree.join(up, "p", "left").join(own, "u", "left")
    degree = checkpoint(joined.select("u", "p", (F.col("a").isNotNull() | F.col("b").isNotNull() | (F.col("n") > 1)).alias("core")))
    core = edges.join(degree.filter("core").select("u"), "u", "left_semi").select("u", "v")
    core, mark = checkpoint(core), None
    while (now := _mark(core)) != mark and now[0]:  # every round that changes anything brings a node nearer to its root
        core, mark = checkpoint(_star(core)), now
    root = core.select(F.col("u").alias("p"), F.col("v").alias("q"))
    leaves = degree.filter("not core").join(root, "p", "left").select(F.col("u").alias("node"), F.coalesce("q", "p").alias("root"))
    return leaves.unionByName(core.select(F.col("u").alias("node"), F.col("v").alias("root")))
