"""The deduplicated count as a stream. An extension: a stream can't wait for copies that come later than its watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanak.functions.text import domain
from almanak.operators.deliveries import cleaned


def domain_counts(deliveries: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Messages by day and sender's domain, a full id counting once within ``late``; works on streams and tables alike."""
    d = deliveries.select(F.col("received_at").cast("timestamp").alias("received_at"), cleaned(F.col("id")).alias("id"), F.coalesce(domain(F.lower("from_addr")), F.lit("(none)")).alias("domain"))
    d = d.withWatermark("received_at", late)
    if d.isStreaming:
        d = d.dropDuplicatesWithinWatermark(["id"])
    else:  # of a table the first delivery counts, which a stream takes to be the one that arrives first
        d = d.groupBy("id").agg(F.min(F.struct("received_at", "domain")).alias("first")).select("first.*")
    return d.groupBy(F.window("received_at", window), "domain").agg(F.count("*").alias("messages")).select(F.col("window.start").alias("day"), "domain", "messages")
