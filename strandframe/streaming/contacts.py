"""Streaming counts: pixels of read pairs as they arrive, and events by window with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pixel_counts(pairs: DataFrame, size: int) -> DataFrame:
    """Running pixel counts of a stream of pairs."""
    b1, b2 = (F.floor(F.col(c) / size).cast("long") for c in ("pos1", "pos2"))
    return pairs.where("chr1 = chr2").groupBy(F.col("chr1").alias("chrom"), F.least(b1, b2).alias("bin1"), F.greatest(b1, b2).alias("bin2")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window; rows later than the watermark allows are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """A query that writes to a table in memory, for tests."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
