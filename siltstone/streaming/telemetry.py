"""Structured Streaming over append-only telemetry, and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = (
    "source string, stage string, chunk_index int, retry_attempt int, model string, prompt_tokens long, completion_tokens long, "
    "prompt_chars long, completion_chars long, cost double, latency_ms long, success boolean, error string, timestamp timestamp"
)


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines as they are appended."""
    return spark.readStream.schema(TELEMETRY).json(folder)


def windows(calls: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, tokens and failures per stage and window; a batch DataFrame gives the same rows."""
    src = calls.withWatermark("timestamp", late) if calls.isStreaming else calls
    return src.groupBy(F.window("timestamp", every).alias("w"), "stage").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count_if(~F.col("success")).alias("failures")
    ).select(F.col("w.start").alias("window_start"), "stage", "calls", "tokens", "failures")


def progress(events: DataFrame) -> DataFrame:
    """Counts by event type, updated as events arrive."""
    return events.groupBy("event_type").count()


def upsert_stream(points: DataFrame, table_path: str, checkpoint: str, key: str = "id", order: str | None = "seq"):
    """Each micro-batch replaces its points by key in a ``Collection`` at ``table_path``, which is made if it is not
    there: only the buckets of its keys are rewritten, a failed batch leaves the table as it was, and one
    that was committed is not applied again."""
    from ..sinks.collection import Collection

    return Collection(points.sparkSession, table_path).init(points.schema, key).upsert_stream(points, checkpoint, order)
