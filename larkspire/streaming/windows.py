"""Streams of events: windows with watermarks, deduplication, and the job queue as keyed state.

Windows over event time generalise the trailing 24-hour counts of the catalog, session windows the expiry of leases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _late(df: DataFrame, watermark: str | None) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", watermark) if watermark else df


def tumbling(events: DataFrame, size: str = "1 day", watermark: str | None = None, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _late(events, watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("sum_value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "sum_value")


def sessions(events: DataFrame, gap: str = "6 hours", watermark: str | None = None) -> DataFrame:
    out = _late(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def deduplicated(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    return _late(events, watermark).dropDuplicatesWithinWatermark(["event_id"])


def queue_state(changes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Each job's status after its events (enqueue, claim, done, fail) in order: failures go back to pending until attempts are used up."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event"])
        for e in rows["event"]:
            if e == "enqueue" and status == "new":
                status = "pending"
            elif e == "claim" and status == "pending":
                status, attempts = "running", attempts + 1
            elif e == "done" and status == "running":
                status = "completed"
            elif e == "fail" and status == "running":
                status = "pending" if attempts < max_attempts else "dead_lettered"
        state.update((status, attempts))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return changes.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)
