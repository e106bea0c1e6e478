"""The streaming form of the sessions: merged session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: Column, ts: Column, kind: Column, event_id: Column, gap: str = "1800 seconds", lateness: str = "2 hours") -> DataFrame:
    """Sessions (key, start_us, end_us, n_events, n_types) of a stream, each emitted once the watermark has passed it.

    An event no later than ``lateness`` still joins, prolongs or bridges the sessions that are open; a redelivered
    ``event_id`` within that time counts once. Rows without key or time are left out, null kinds are no type.
    """
    rows = events.select(key.alias("key"), ts.cast("timestamp").alias("ts"), kind.alias("kind"), event_id.alias("event_id")).where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    once = rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    merged = once.groupBy("key", F.session_window("ts", gap).alias("span")).agg(
        F.min(F.unix_micros("ts")).alias("start_us"), F.max(F.unix_micros("ts")).alias("end_us"), F.count("*").alias("n_events"), F.size(F.collect_set("kind")).cast("bigint").alias("n_types")
    )
    return merged.drop("span")
