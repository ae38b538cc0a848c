"""Redelivered events [K5]: one row for each id, in batch or within a time window of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = "2 minutes"


def once(events: DataFrame, key: str = "event_id", order: str = "lsn_num") -> DataFrame:
    """The first delivery of each id: a maximum by key, so redeliveries are dropped on the map side."""
    others = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("e"))
    return first.select(key, "e.*").select(*events.columns)


def once_in_window(stream: DataFrame, key: str = "event_id", time: str = "ts", window: str = WINDOW) -> DataFrame:
    """Drop an id that was seen within the window; state older than that is forgotten."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark([key])
