"""Streams: change feeds and time-bounded memory. After a flush a stream's result is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def feed(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of changes (seq, op, ...) to a Parquet log; `operators.agent.latest` of the log is the state."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(notes: DataFrame, hold: str, slide: str | None = None) -> DataFrame:
    """(scope, window, notes, tokens) over event time at: what memory holds in each window, late notes to hold behind the newest."""
    own = F.window("at", hold, slide) if slide else F.window("at", hold)
    return notes.withWatermark("at", hold).groupBy("scope", own).agg(F.count("*").alias("notes"), F.sum(F.floor(F.octet_length("text") / 4)).alias("tokens"))


def sessions(events: DataFrame, gap: str, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events with no pause of gap."""
    rows = events.withWatermark(at, gap) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
