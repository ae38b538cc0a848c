"""Backfill runs [T12-T23, F9-F11, W2]: a queue of tables, chunk by chunk, with marks, resume and status.

A chunk is bracketed by two positions of the log; its rows that the log changed in between are
superseded, the rest is delivered as READ events at the high mark. The cursor is saved after delivery,
so a restart goes on where it was, and a chunk that fails is simply done again with the same event ids.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY_SEPARATOR
from ..model import lsn_text
from ..operators import backfill
from .sinks import Progress


@dataclass
class Status:
    schema: str
    table: str
    state: str = "pending"  # pending, running, done, skipped, failed
    rows_copied: int = 0
    error: str = ""
    started_at: str = ""
    finished_at: str = ""


class StreamRestarted(RuntimeError):
    """The stream was restarted while a chunk waited for it: the chunk is done again."""


@dataclass
class Source:
    """What the coordinator needs of a database: rows, keys, the log and its end."""

    rows: Callable[[str, str], DataFrame]
    key: Callable[[str, str], list[str]]
    events: Callable[[], DataFrame]
    mark: Callable[[], int]  # writes a mark and returns its position
    tables: Callable[[], list[tuple[str, str]]] = list


_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


def split_name(name: str) -> tuple[str, str]:
    """schema.table; a bare name is in public. Names of other forms, or that aren't identifiers, are errors."""
    parts = name.split(".")
    if len(parts) > 2 or not all(map(_IDENTIFIER.fullmatch, parts)):
        raise ValueError(f"not a table name: {name!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else ("public", parts[0])


@dataclass
class Coordinator:
    source: Source
    deliver: Callable[[DataFrame, int], None]
    progress: Progress = field(default_factory=Progress)
    chunk_size: int = 1000
    chunk_delay: float = 0.0
    excluded: Iterable[str] = ()
    state_table: str = ""
    retries: int = 3
    sleep: Callable[[float], None] = time.sleep
    queue: deque = field(default_factory=deque)
    statuses: dict[tuple[str, str], Status] = field(default_factory=dict)
    batch: int = 0
    restarts: int = 0
    mode: str = "manual"  # auto: all tables are copied once, by the run that finds no earlier state; off: nothing is

    def start(self, first_run: bool) -> list[str]:
        """What to do when the service starts: go on with what is unfinished, and in mode auto copy all tables on the first run."""
        if self.mode == "off":
            return []
        self.resume()
        return self.enqueue_pending() if self.mode == "auto" and first_run else []

    def stream_restarted(self) -> None:
        """To be called when the stream is restarted (Supervisor's `restarted`)."""
        self.restarts += 1

    def _excluded(self, schema: str, table: str) -> bool:
        names = {*self.excluded, *([self.state_table] if self.state_table else [])}
        return f"{schema}.{table}" in names or table in names

    def resume(self) -> None:
        """Queue what an earlier run left unfinished."""
        for name, saved in sorted(self.progress.load().items()):
            ref = split_name(name)
            if saved["done"]:
                self.statuses[ref] = Status(*ref, state="done")
            elif not self._excluded(*ref):
                self._add(ref)

    def _add(self, ref: tuple[str, str]) -> None:
        self.statuses[ref] = Status(*ref)
        self.queue.append(ref)

    def enqueue(self, name: str) -> None:
        """Copy a table from its start, again if it was copied before; an error if it is waiting or running."""
        ref = split_name(name)
        if self._excluded(*ref):
            raise ValueError(f"{name} is excluded")
        if ref in self.statuses and self.statuses[ref].state in ("pending", "running"):
            raise RuntimeError(f"{name} is already queued or running")
        self.progress.clear(".".join(ref))
        self._add(ref)

    def enqueue_pending(self) -> list[str]:
        """Every published table that isn't excluded, done, waiting or running."""
        added = []
        for ref in sorted(self.source.tables()):
            busy = ref in self.statuses and self.statuses[ref].state in ("pending", "running", "done")
            if not busy and not self._excluded(*ref):
                self._add(ref)
                added.append(".".join(ref))
        return added

    def status(self) -> list[Status]:
        return [self.statuses[k] for k in sorted(self.statuses)]

    def run(self) -> None:
        """Work the queue off."""
        while self.queue:
            ref = self.queue.popleft()
            status = self.statuses[ref]
            status.state, status.started_at = "running", _now()
            try:
                status.state = self._table(ref, status)
            except Exception as e:
                status.state, status.error = "failed", str(e)
            status.finished_at = _now()

    def _table(self, ref: tuple[str, str], status: Status) -> str:
        key = self.source.key(*ref)
        if not key:
            status.error = "no primary key"
            return "skipped"
        name = ".".join(ref)
        cursor = (self.progress.load().get(name) or {}).get("cursor")
        while True:
            last, rows, delivered = self._chunk(ref, key, cursor)
            if not rows:
                self.progress.save(name, cursor, True, _now())
                return "done"
            cursor = last
            status.rows_copied += delivered
            self.progress.save(name, cursor, False, _now())
            if self.chunk_delay:
                self.sleep(self.chunk_delay)

    def _chunk(self, ref: tuple[str, str], key: list[str], cursor: list | None) -> tuple[list | None, int, int]:
        for attempt in range(self.retries + 1):
            try:
                return self._once(ref, key, cursor)
            except Exception:
                if attempt == self.retries:
                    raise
                self.sleep(1.0)
        raise AssertionError("unreachable")

    def _once(self, ref: tuple[str, str], key: list[str], cursor: list | None) -> tuple[list | None, int, int]:
        schema, table = ref
        restarts = self.restarts
        low = self.source.mark()
        full = self.source.rows(schema, table)
        page = backfill.page(full, key, tuple(cursor) if cursor else None, self.chunk_size)
        text = F.concat_ws(KEY_SEPARATOR, *(F.col(k).cast("string") for k in key))
        page = page.withColumn("key", text).persist()  # a chunk is chunk_size rows at most
        try:
            ends = page.agg(F.count("*").alias("n"), F.max(F.struct(*key)).alias("last")).first()
            high = self.source.mark()
            if not ends.n:
                return None, 0, 0
            if self.restarts != restarts:
                raise StreamRestarted("the stream was restarted")
            seen = backfill.seen_keys(self.source.events(), schema, table, key, F.lit(Decimal(low)), F.lit(Decimal(high)))
            left = backfill.supersede(page, seen)
            rows = backfill.read_events(left, schema, table, full.columns, F.lit(lsn_text(high)), F.lit(Decimal(high))).persist()
            try:
                n = rows.count()
                self.batch += 1
                self.deliver(rows, -self.batch)  # returns when the rows are delivered
                if self.restarts != restarts:
                    raise StreamRestarted("the stream was restarted")
            finally:
                rows.unpersist()
            return list(ends.last), ends.n, n
        finally:
            page.unpersist()


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
