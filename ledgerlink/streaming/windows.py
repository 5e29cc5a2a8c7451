"""Event-time operators over a stream, or a table, of events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def tumbling(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    """start, event_type, n, total for windows of a fixed size; in a stream, rows later than late drop out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = LATE) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """user_id, start, end, n: runs of a user's events with no gap as long as gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(documents: DataFrame, late: str = "7 days") -> DataFrame:
    """Documents whose content was not seen for their source within late. documents: source, external_id, payload, ts."""
    keyed = documents.withColumn("sha256", F.sha2("payload", 256)).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["source", "external_id", "sha256"])


def changes(log: DataFrame) -> DataFrame:
    """A stream of observations (entity_id, field, value, ts) to changes, with the last value as state."""
    import pandas as pd

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen = (state.get[0], True) if state.exists else (None, False)
        rows = []
        for v, ts in sorted(((v, t) for f in frames for v, t in zip(f["value"], f["ts"])), key=lambda x: x[1]):
            if seen and v != last:
                rows.append((*key, last, v, ts))
            last, seen = v, True
        state.update((last,))
        yield pd.DataFrame(rows, columns=["entity_id", "field", "old_value", "new_value", "ts"])

    out = "entity_id long, field string, old_value string, new_value string, ts timestamp"
    return log.groupBy("entity_id", "field").applyInPandasWithState(step, out, "last string", "append", "NoTimeout")
