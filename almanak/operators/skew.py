"""Joins that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``left`` joined to a ``right`` with at most one row a key, hot keys of ``left`` spread over ``salts`` tasks.

    ``right`` is repeated ``salts`` times, so it should be the far smaller
    side; ``spread`` is a column of ``left`` with many values. If Catalyst
    finds ``right`` below the broadcast threshold it broadcasts it instead.
    Null keys find no partner.
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("int"))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")
