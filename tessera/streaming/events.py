"""Streams of events: windowed counts with late data, sessions, prompts answered once. An extension of our own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.llm import llm_function
from tessera.functions.providers import Provider


def event_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", glob: str | None = None) -> DataFrame:
    """The Parquet files of a folder, or those that glob names, as a stream; ts becomes a session timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of value by window and event type; rows later than `late` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def answer_stream(prompts: DataFrame, write: Callable[[DataFrame], None], prompt: str = "prompt", time: str = "ts", late: str = "1 hour", provider: Provider | None = None) -> StreamingQuery:
    """Answers each distinct prompt inside the watermark once; write gets each micro-batch with its answers."""
    distinct = prompts.withWatermark(time, late).dropDuplicatesWithinWatermark([prompt])
    ask = llm_function(provider)
    return distinct.writeStream.foreachBatch(lambda batch, _: write(batch.withColumn("answer", ask(F.col(prompt))))).trigger(availableNow=True).start()
