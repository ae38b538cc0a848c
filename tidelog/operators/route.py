"""Exclusion and routing [F1-F7, F12]: predicates over schema and table, resolved to literals when the plan is built."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INSERT, full_name
from ..sources.config import Outbox, Routing, Sink


def named(tables: Iterable[str]) -> Column:
    """The event's table is listed, by full or by bare name."""
    names = sorted(tables)
    return (full_name().isin(*names) | F.col("table").isin(*names)) if names else F.lit(False)


def exclude(events: DataFrame, tables: Iterable[str], state_table: str = "") -> DataFrame:
    """Drop listed tables, and the backfill's own state table, before fan-out."""
    return events.where(~named({*tables, *([state_table] if state_table else [])}))


def selected(sink: Sink) -> Column:
    """Whether a sink takes the event's table."""
    if sink.keyed:
        return F.lit(True) if sink.sync_all else named(sink.tables)
    return index_of(sink).isNotNull()


def index_of(sink: Sink) -> Column:
    """The search index of the event's table; null if none. A full name with an empty index doesn't fall back."""
    full = [(n, t.target) for n, t in sorted(sink.tables.items()) if "." in n]
    bare = [(n, t.target) for n, t in sorted(sink.tables.items()) if "." not in n]
    out = F.lit(None).cast("string")
    for column, pairs in ((F.col("table"), bare), (full_name(), full)):
        for name, target in pairs:
            out = F.when(column == name, F.lit(target or None).cast("string")).otherwise(out)
    return out


def is_outbox(outbox: Outbox | None) -> Column:
    return F.lit(False) if outbox is None else (F.col("schema") == outbox.schema) & (F.col("table") == outbox.table)


def outbox_events(events: DataFrame, outbox: Outbox) -> DataFrame:
    """Only INSERTs into the outbox table are messages."""
    return events.where(is_outbox(outbox) & (F.col("op") == INSERT))


def route(events: DataFrame, routes: Routing) -> DataFrame:
    """A row for each sink that takes the event, with column `sink`. Selection comes before any transform."""
    data = ~is_outbox(routes.outbox)
    takes = [F.when(data & selected(s), F.lit(n)) for n, s in sorted(routes.sinks.items())]
    if routes.outbox is not None:
        takes.append(F.when(is_outbox(routes.outbox) & (F.col("op") == INSERT), F.lit("outbox")))
    return events.withColumn("sink", F.explode(F.filter(F.array(*takes), lambda s: s.isNotNull())))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows that hold the text in any column, whatever its case."""
    whole = reduce(lambda a, b: F.concat(a, F.lit(" "), b), (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    return rows.where(F.contains(F.lower(whole), F.lit(text.lower())))
