"""Remote file listings as JSON, read field by field: a field of another type is null, the rest stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "uid string, type string, name struct<ok: boolean, value: string>, modificationTime string, activeRevision struct<uid: string, claimedSize: bigint, claimedDigests: struct<sha1: string>, claimedModificationTime: string>"


def nodes(text: Column) -> Column:
    """A node of a listing; a size that is no number counts as 0, a digest only if it is 40 hex digits."""
    return F.from_json(text, NODE, {"mode": "PERMISSIVE"})


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of saved listings: one JSON array a file, one object a file, or one object a line; what is no JSON is passed by."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    first = F.regexp_extract("value", r"^[^\r\n]*", 0)  # an object of its own where each line is one
    is_array = F.col("value").startswith("[")
    arrays = whole.filter(is_array).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    lines = whole.filter(~is_array).select(F.explode(F.when(F.from_json(first, "map<string, string>").isNotNull(), F.split("value", r"\r?\n")).otherwise(F.array("value"))).alias("value"))
    rows = arrays.unionByName(lines).select(nodes(F.col("value")).alias("n"))
    return rows.filter("n.uid is not null").select(*node_columns(F.col("n")))


def node_columns(n: Column) -> list[Column]:
    """``node_id``, ``name``, ``kind``, ``size``, ``claimed_sha1``, ``revision_id`` of a node."""
    sha = n["activeRevision"]["claimedDigests"]["sha1"]
    return [
        n["uid"].alias("node_id"), n["name"]["value"].alias("name"), F.when(F.lower(n["type"]).contains("folder"), "folder").otherwise("file").alias("kind"),
        F.coalesce(n["activeRevision"]["claimedSize"], F.lit(0)).alias("size"), F.when(sha.rlike("^[0-9A-Fa-f]{40}$"), F.lower(sha)).alias("claimed_sha1"), n["activeRevision"]["uid"].alias("revision_id"),
    ]
