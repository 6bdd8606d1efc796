"""Streaming wrappers: stateless markers of arriving texts, and windowed event counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def stream_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, n_words, n_chars) of texts as their files arrive; stateless, so any sink and mode will do."""
    docs = spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", "*.parquet").parquet(folder)
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped when it runs as a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
