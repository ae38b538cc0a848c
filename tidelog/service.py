"""The programmatic counterpart of the service's endpoints [section 2.12]: health, metrics, statistics, listings."""

from __future__ import annotations

from collections import deque
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import schema_diff, stats
from .streaming.coordinator import Coordinator
from .streaming.delivery import Pipeline
from .streaming.schema_events import FanOut, Recorder


@dataclass
class Service:
    spark: SparkSession
    pipeline: Pipeline
    coordinator: Coordinator | None = None
    streaming: bool = False
    history: deque = field(default_factory=lambda: deque(maxlen=stats.HISTORY_SAMPLES))
    recorder: Recorder | None = None
    observers: FanOut | None = None
    server_end: int = 0  # the server's position, as the source's progress tells it

    def health(self) -> int:
        return 200

    def readiness(self) -> int:
        """200 if the stream runs and every sink is healthy, else 503."""
        return 200 if self.streaming and all(self.pipeline.registry.health().values()) else 503

    def backfill_status(self) -> tuple[int, list[dict]]:
        return (501, []) if self.coordinator is None else (200, [asdict(s) for s in self.coordinator.status()])

    def backfill(self, table: str = "", everything: bool = False) -> int:
        """202 accepted, 400 malformed or excluded, 409 busy, 501 switched off."""
        if self.coordinator is None:
            return 501
        if bool(table) == everything:
            return 400
        try:
            if everything:
                self.coordinator.enqueue_pending()
            else:
                self.coordinator.enqueue(table)
        except ValueError:
            return 400
        except RuntimeError:
            return 409
        return 202

    def depth(self) -> int:
        return len(self.pipeline.letters.entries) if self.pipeline.tables is None else self.pipeline.tables.depth()

    def dead_letters(self, limit: str | None = None) -> dict:
        """Newest first; the limit is 100 unless it is a positive number."""
        from .operators.attempts import list_limit

        if self.pipeline.tables is not None:
            shown = [r.asDict(recursive=True) for r in self.pipeline.tables.list(list_limit(limit)).collect()]
        else:
            shown = [{k: v for k, v in vars(e).items() if k != "rows"} for e in self.pipeline.letters.list(list_limit(limit))]
        return {"total": self.depth(), "entries": shown}

    def retry(self, key: str = "", everything: bool = False) -> tuple[int, dict]:
        if self.pipeline.tables is not None:
            try:
                out = self.pipeline.tables.retry(None if everything else key, lambda sink, rows: self.pipeline.deliver(sink, rows, -1))
            except KeyError:
                return 404, {}
            return (200 if everything or out["succeeded"] else 409), out
        deliver = lambda e: self.pipeline.deliver(e.sink, e.rows, e.batch)
        if everything:
            return 200, self.pipeline.letters.retry_all(deliver)
        try:
            done = self.pipeline.letters.retry(key, deliver)
        except KeyError:
            return 404, {}
        return (200 if done else 409), {"retried": 1, "succeeded": int(done), "failed": int(not done)}

    def discard(self, key: str) -> int:
        try:
            (self.pipeline.letters if self.pipeline.tables is None else self.pipeline.tables).discard(key)
        except KeyError:
            return 404
        return 200

    def sample(self, at_ms: int, events_total: int, lag_bytes: int, in_flight: int) -> None:
        """Keep a sample; the oldest of more than 360 goes."""
        self.history.append({"t": at_ms, "events_total": events_total, "wal_lag": lag_bytes, "inflight": in_flight, "dlq_entries": self.depth()})

    def record(self, relations: DataFrame, batch: int = 0) -> None:
        """Schema changes to all observers; without any, to a recorder."""
        if self.recorder is None:
            self.recorder = Recorder()
        if self.observers is None:
            self.observers = FanOut([self.recorder])
        self.observers(schema_diff.changes(relations), batch)

    def schema_changes(self) -> dict:
        """Newest first, and how many there were in all."""
        return {"total": 0, "changes": []} if self.recorder is None else {"total": self.recorder.total, "changes": list(reversed(self.recorder.changes))}

    def snapshot(self, events: DataFrame) -> dict:
        """Tables by total (then name), sinks by name, totals by operation."""
        tables = [r.asDict() for r in stats.per_table(events).orderBy("total", "table_name", ascending=[False, True]).collect()]
        outcome: dict[str, dict] = {}
        health = self.pipeline.registry.health()
        for name in sorted({*health, *(r["sink"] for r in self.pipeline.results)}):
            own = [r for r in self.pipeline.results if r["sink"] == name]
            outcome[name] = {"healthy": health.get(name, False), "processed": sum(r["success"] for r in own), "failed": sum(not r["success"] for r in own), "breaker": self.pipeline.breakers[name].gauge if name in self.pipeline.breakers else 0}
        totals = {op.lower(): sum(t[op.lower()] for t in tables) for op in stats.OPERATIONS}
        return {"tables": tables, "sinks": outcome, "operations": totals, "total": sum(totals.values()), "dlq_entries": self.depth()}

    def metrics(self, events: DataFrame | None = None) -> str:
        """All metrics as exposition text; counters of received events from the log, if it is given."""
        p, lines = self.pipeline, []

        def line(name: str, value, **labels) -> None:
            text = ",".join(f'{k}="{v}"' for k, v in labels.items())
            lines.append(f"cdc_{name}{'{' + text + '}' if text else ''} {value}")

        if events is not None:
            for r in stats.received(events).orderBy("schema", "table", "op").collect():
                line("events_received_total", r.events, schema=r.schema, table=r.table, operation=r.op)
        for (name, *values), n in sorted(p.counters.items()):
            if name != "events_received_total" or events is None:
                line(name, n, **dict(zip(stats.METRICS[name][1], values, strict=True)))
        for name in sorted({r["sink"] for r in p.results}):
            own = [r["seconds"] for r in p.results if r["sink"] == name]
            for bound in stats.BUCKETS:
                line("event_processing_duration_seconds_bucket", sum(x <= bound for x in own), sink=name, le=f"{bound:g}")
            line("event_processing_duration_seconds_bucket", len(own), sink=name, le="+Inf")
            line("event_processing_duration_seconds_sum", round(sum(own), 6), sink=name)
            line("event_processing_duration_seconds_count", len(own), sink=name)
        for name, breaker in sorted(p.breakers.items()):
            line("circuit_breaker_state", breaker.gauge, sink=name)
        if p.tables is not None:
            for (sink, what), n in sorted(p.tables.totals.items()):
                line("dlq_parked_total", n, sink=sink) if what == "parked" else line("dlq_retried_total", n, sink=sink, status=what)
        if self.recorder is not None:
            for (schema, table, kind), n in sorted(self.recorder.counts.items()):
                line("schema_changes_total", n, schema=schema, table=table, kind=kind)
        if self.observers is not None:
            for target, n in sorted(self.observers.errors.items()):
                line("schema_publish_errors_total", n, target=target)
        if self.coordinator is not None:
            for s in self.coordinator.status():
                line("backfill_rows_total", s.rows_copied, schema=s.schema, table=s.table)
        line("active_sinks", len(p.registry.sinks))
        line("inflight_events", p.in_flight)
        line("last_processed_lsn", p.last_position)
        line("wal_lag_bytes", max(0, self.server_end - p.last_position))
        line("dlq_entries", self.depth())
        return "\n".join(lines) + "\n"
