"""Outbox messages [K7, P18]: rows of the outbox table become messages of a topic's stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import Outbox
from .route import outbox_events


def _value(name: str) -> Column:
    return F.element_at("new_data", F.lit(name))


def messages(events: DataFrame, outbox: Outbox, fail: bool = True) -> DataFrame:
    """(stream, id, payload, type, key, event_id, error) of every INSERT into the outbox table.

    The topic is the row's, else the default; a row without topic or payload is an error: raised, or
    with fail=False kept in the column `error`. The id falls back to the event's; empty type and key are null.
    """
    rows = outbox_events(events, outbox)
    some = lambda name: F.nullif(_value(name), F.lit(""))
    topic = F.coalesce(some(outbox.topic), F.nullif(F.lit(outbox.default_topic), F.lit("")))
    payload = _value(outbox.payload)
    error = F.when(topic.isNull(), F.lit("no topic")).when(payload.isNull(), F.lit("no payload"))
    out = rows.select(
        F.concat_ws(":", F.lit(outbox.stream_prefix), topic).alias("stream"), F.coalesce(some(outbox.id), F.col("event_id")).alias("id"), payload.alias("payload"),
        some(outbox.event_type).alias("type"), some(outbox.key).alias("key"), "event_id", error.alias("error"),
    )
    if fail:
        raised = F.raise_error(F.concat(F.lit("outbox event "), F.col("event_id"), F.lit(": "), F.col("error"))).cast("string")
        out = out.withColumn("stream", F.when(F.col("error").isNotNull(), raised).otherwise(F.col("stream"))).drop("error")
    return out
