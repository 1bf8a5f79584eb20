"""Structured Streaming beside the batch operators: clean and deduplicate arriving messages, and count terms by day.

The reference data flow is batch only; these go beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import clean, tokens
from wordloom.operators.redelivery import message_key


def arriving(stream: DataFrame, *, late: str = "30 days") -> DataFrame:
    """Messages without stubs, each identifier once within ``late`` of its first arrival."""
    s = stream.withColumn("key", message_key(F.col("comment_id"), F.col("post_id"))).where(F.col("key").isNotNull() & ~clean.is_stub(F.col("body")))
    return s.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["key"])


def daily_terms(stream: DataFrame, terms: list[str], *, late: str = "2 days") -> DataFrame:
    """window, hits, tokens of each day; late rows beyond ``late`` are left out by the watermark."""
    s = stream.withWatermark("ingested_at", late)
    hits = F.count_if(clean.contains_any(F.col("body"), terms))
    return s.groupBy(F.window("ingested_at", "1 day")).agg(hits.alias("hits"), F.sum(F.size(tokens.words(F.col("body")))).alias("tokens"))


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
