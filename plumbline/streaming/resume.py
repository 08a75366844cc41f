"""Resumable work as a stream: new score files are scored once, whatever is restarted.

An extension: the workload is batch, and its resumable loops (skip
what is done, retry what failed) are covered by an ``availableNow`` file stream
whose batches skip keys already in the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.sinks import append_missing


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, score: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Run all files that have landed under ``source`` through ``score`` into ``sink``; then stop."""

    def batch(df: DataFrame, _: int) -> None:
        append_missing(score(df.dropDuplicates([key])), sink, key)

    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_scores(scores: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time windows over a stream (or batch) of ``(judge, ts, score)``."""
    rows = scores.withWatermark("ts", late) if scores.isStreaming else scores
    return rows.groupBy("judge", F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select("judge", F.col("window.start").alias("start"), "n", "mean")
