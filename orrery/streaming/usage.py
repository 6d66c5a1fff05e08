"""Usage metering and queue state over streams; each also runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metered(activity: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and tokens per identity and month of event time; rows later than `late` are left out of a stream."""
    month = F.date_trunc("month", F.col("created_at").cast("timestamp")).alias("month")
    rows = activity.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("created_at", late) if rows.isStreaming else rows
    return rows.groupBy("identity_id", month).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def hourly(activity: DataFrame, late: str = "2 hours") -> DataFrame:
    """Event-time windows of an hour: an extension beyond monthly metering."""
    rows = activity.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("created_at", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("created_at", "1 hour"), "tool_name").agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(F.col("window.start").alias("hour_start"), "tool_name", "calls", "output_tokens")


def sessions(activity: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each identity: calls less than `gap` apart."""
    rows = activity.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("created_at", late) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window("created_at", gap), "identity_id").agg(F.count("*").alias("calls"))
    return out.select("identity_id", F.col("session_window.start").alias("session_start"), "calls")


def live_jobs(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of jobs in which a (type, knowledge_id) that is still live is not published again."""
    return jobs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["type", "knowledge_id"])


def latest_state(events: DataFrame) -> DataFrame:
    """Per knowledge base its last state, by (seq, state)."""
    return events.groupBy("knowledge_id").agg(F.max_by("state", F.struct("seq", "state")).alias("state"), F.max("seq").alias("seq"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now and returns what its table at `path` has then.

    A complete result replaces the table, an appended one adds to it; neither passes through the driver.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        writer.format("parquet").start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
