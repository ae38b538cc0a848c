"""Fan-out with retries, circuit breaking and dead letters [T1-T11, K11, K12].

One streaming query, one foreachBatch: every sink is attempted on every batch, and a batch that any
sink failed is raised, so its offsets stay uncommitted and it is delivered again (at least once).
Sinks get DataFrames, not events: what runs on the driver is control, never rows. A sink may say which events failed
(EventsFailed); those alone are tried again and, by letters.LetterTables, parked.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter, deque
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import route, transform
from ..sources.config import Routing, Settings


class CircuitOpen(RuntimeError):
    pass


class ShuttingDown(RuntimeError):
    pass


class DeliveryFailed(RuntimeError):
    pass


class EventsFailed(RuntimeError):
    """Some events of a batch failed; `failed` has their event_id and error, all others were delivered."""

    def __init__(self, failed: DataFrame):
        super().__init__("; ".join(f"{r.event_id}: {r.error}" for r in failed.orderBy("event_id").limit(3).collect()))
        self.failed = failed


class Sink(Protocol):
    name: str

    def initialize(self) -> None: ...

    def process(self, events: DataFrame, batch: int) -> None: ...

    def healthy(self) -> bool: ...

    def shutdown(self) -> None: ...


class Registry:
    """Sinks by name, in the order of registration."""

    def __init__(self) -> None:
        self.sinks: dict[str, Sink] = {}

    def register(self, sink: Sink) -> None:
        if sink.name in self.sinks:
            raise ValueError(f"sink {sink.name!r} is registered already")
        self.sinks[sink.name] = sink

    def unregister(self, name: str) -> None:
        if self.sinks.pop(name, None) is None:
            raise KeyError(f"sink {name!r} is not registered")

    def get(self, name: str) -> Sink:
        if name not in self.sinks:
            raise KeyError(f"sink {name!r} is not registered")
        return self.sinks[name]

    def initialize(self) -> None:
        for sink in self.sinks.values():
            sink.initialize()

    def shutdown(self) -> None:
        errors = []
        for sink in self.sinks.values():
            try:
                sink.shutdown()
            except Exception as e:  # the others are shut down too
                errors.append(e)
        if errors:
            raise ExceptionGroup("shutdown", errors)

    def health(self) -> dict[str, bool]:
        out = {}
        for name, sink in self.sinks.items():
            try:
                out[name] = bool(sink.healthy())
            except Exception:
                out[name] = False
        return out


def backoffs(retries: int, first: float, most: float) -> list[float]:
    """Pauses before each retry: doubling, up to the cap."""
    return [min(most, first * 2**i) for i in range(retries)]


def with_retry(call: Callable[[], None], pauses: list[float], sleep: Callable[[float], None] = time.sleep) -> int:
    """Call until it succeeds; the last error is raised. Returns the number of retries."""
    for i, pause in enumerate([*pauses, None]):
        try:
            call()
            return i
        except CircuitOpen:
            raise
        except Exception:
            if pause is None:
                raise
            sleep(pause)
    raise AssertionError("unreachable")


@dataclass
class Breaker:
    """Opens after `threshold` failed cycles in a row; one trial after `timeout` seconds decides."""

    threshold: int = 5
    timeout: float = 30.0
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    failures: int = 0
    since: float = 0.0

    def call(self, work: Callable[[], None]) -> None:
        if self.state == "open":
            if self.clock() - self.since < self.timeout:
                raise CircuitOpen("circuit breaker is open")
            self.state = "half-open"
        try:
            work()
        except Exception:
            self.failures += 1
            if self.state == "half-open" or self.failures >= self.threshold:
                self.state, self.since, self.failures = "open", self.clock(), 0
            raise
        self.state, self.failures = "closed", 0

    @property
    def gauge(self) -> int:
        return {"closed": 0, "half-open": 1, "open": 2}[self.state]


@dataclass
class Entry:
    """A parked batch of a sink: already transformed rows, kept as a table."""

    id: str
    sink: str
    batch: int
    rows: DataFrame
    error: str
    attempts: int
    first_failed_at: float
    last_failed_at: float


class QueueFull(RuntimeError):
    pass


@dataclass
class DeadLetters:
    """Counts failed cycles by (sink, batch); from the threshold on, parks instead of stalling the stream."""

    threshold: int = 3
    most: int = 10_000
    clock: Callable[[], float] = time.time
    counts: dict[tuple[str, int], tuple[int, float]] = field(default_factory=dict)
    entries: dict[str, Entry] = field(default_factory=dict)
    keep: Callable[[str, DataFrame], DataFrame] = lambda _id, rows: rows

    def guard(self, sink: str, batch: int, rows: DataFrame, work: Callable[[], None]) -> bool:
        """True if delivered, False if parked; errors below the threshold and open circuits propagate."""
        try:
            work()
        except CircuitOpen:
            raise
        except Exception as e:
            n, first = self.counts.get((sink, batch), (0, self.clock()))
            self.counts[sink, batch] = (n + 1, first)
            if n + 1 < self.threshold:
                raise
            self.park(sink, batch, rows, str(e), n + 1, first)
            del self.counts[sink, batch]
            return False
        self.counts.pop((sink, batch), None)
        return True

    def park(self, sink: str, batch: int, rows: DataFrame, error: str, attempts: int, first: float) -> None:
        key = f"{sink}:{batch}"
        if key not in self.entries and len(self.entries) >= self.most:
            raise QueueFull(f"dead letters are full ({self.most}); last error: {error}")
        self.entries[key] = Entry(key, sink, batch, self.keep(key, rows), error, attempts, first, self.clock())

    def list(self, limit: int = 100) -> list[Entry]:
        found = sorted(self.entries.values(), key=lambda e: (-e.last_failed_at, e.id))
        return found[:limit] if limit > 0 else found

    def retry(self, key: str, deliver: Callable[[Entry], None]) -> bool:
        if key not in self.entries:
            raise KeyError(f"no dead letter {key!r}")
        entry = self.entries[key]
        try:
            deliver(entry)
        except Exception as e:
            entry.attempts += 1
            entry.error, entry.last_failed_at = str(e), self.clock()
            return False
        del self.entries[key]
        return True

    def retry_all(self, deliver: Callable[[Entry], None]) -> dict[str, int]:
        done = [self.retry(k, deliver) for k in list(self.entries)]
        return {"retried": len(done), "succeeded": sum(done), "failed": len(done) - sum(done)}

    def discard(self, key: str) -> None:
        if self.entries.pop(key, None) is None:
            raise KeyError(f"no dead letter {key!r}")


def error_class(text: str) -> str:
    """As operators.attempts.error_class, for one error."""
    low = text.lower()
    if "circuit breaker is open" in low:
        return "circuit_open"
    if "deadline exceeded" in low or "timeout" in low:
        return "timeout"
    return "canceled" if "context canceled" in low or "cancelled" in low else "other"


def within(rows: DataFrame, seconds: float, work: Callable[[], None]) -> None:
    """Run the work of a batch; it may take `seconds` for each of its events. Beyond that its Spark jobs are cancelled."""
    sc, group = rows.sparkSession.sparkContext, f"sink-{uuid.uuid4().hex}"
    limit, late = seconds * max(1, rows.count()), threading.Event()

    def cancel() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, cancel)
    timer.daemon = True
    timer.start()
    sc.setJobGroup(group, "delivery", True)
    try:
        work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"deadline exceeded after {limit:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"deadline exceeded after {limit:g} s")


#: Results of deliveries that are kept.
RESULTS = 10_000


class Pipeline:
    """Exclude, route, transform and deliver a batch to every sink."""

    def __init__(self, routes: Routing, registry: Registry, conf: Settings | None = None, sleep: Callable[[float], None] = time.sleep, prepare: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, tables=None):
        """`tables`, a letters.LetterTables, keeps dead letters by event in a folder; without it they are kept by batch, in memory."""
        if not registry.sinks:
            raise ValueError("no sink is registered")
        self.routes, self.registry, self.conf, self.sleep = routes, registry, conf or Settings(), sleep
        self.prepare = prepare or {}
        self.breakers = {n: Breaker(self.conf.breaker_threshold, self.conf.breaker_timeout) for n in registry.sinks}
        self.letters = DeadLetters(self.conf.dlq_threshold, self.conf.dlq_max_entries)
        self.tables = tables
        self.stopping = False
        self.results: deque[dict] = deque(maxlen=RESULTS)
        self.counters: Counter[tuple[str, ...]] = Counter()  # metric, then its labels
        self.in_flight = 0
        self.last_position = 0

    def rows_for(self, name: str, events: DataFrame) -> DataFrame:
        """What a sink gets of a batch; the outbox sink takes its own table and no transform."""
        if name == "outbox":
            rows = route.outbox_events(events, self.routes.outbox)
        else:
            sink = self.routes.sinks[name]
            rows = events.where(~route.is_outbox(self.routes.outbox) & F.coalesce(route.selected(sink), F.lit(False)))
            rows = transform.transform(rows, sink, self.conf.mask_hmac_key.encode())
        return self.prepare.get(name, lambda r: r)(rows)

    def deliver(self, name: str, rows: DataFrame, batch: int) -> None:
        pauses = backoffs(self.conf.max_retries, self.conf.backoff_initial, self.conf.backoff_max)
        sink, left = self.registry.get(name), [rows]

        def cycle() -> None:
            try:
                within(rows, self.conf.process_timeout, lambda: sink.process(left[0], batch))
            except EventsFailed as e:  # what was delivered isn't tried again
                left[0] = rows.join(e.failed.select("event_id"), "event_id", "left_semi").select(*rows.columns)
                raise

        def paused(seconds: float) -> None:
            self.counters["retry_attempts_total", name] += 1
            self.sleep(seconds)

        self.breakers[name].call(lambda: with_retry(cycle, pauses, paused))

    def _received(self, events: DataFrame) -> None:
        """Counts before exclusion."""
        listed = route.named({*self.conf.excluded_tables, *([self.conf.backfill_state_table] if self.conf.backfill_state_table else [])})
        for r in events.groupBy("schema", "table", "op").agg(F.count("*").alias("n"), F.count_if(listed).alias("excluded"), F.max("lsn_num").alias("last")).collect():
            self.counters["events_received_total", r.schema, r.table, r.op] += r.n
            self.counters["events_excluded_total", r.schema, r.table] += r.excluded
            self.last_position = max(self.last_position, int(r.last or 0))

    def __call__(self, events: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        if self.stopping:
            raise ShuttingDown("shutting down")
        events = events.persist()
        try:
            self._received(events)
            taken = route.exclude(events, self.conf.excluded_tables, self.conf.backfill_state_table)
            self.in_flight = taken.count()
            run = lambda n: self._one(n, taken, batch)
            names = list(self.registry.sinks)
            if self.conf.parallel_sinks:
                with ThreadPoolExecutor(len(names)) as pool:
                    errors = [e for e in pool.map(run, names) if e]
            else:
                errors = [e for n in names if (e := run(n))]
        finally:
            self.in_flight = 0
            events.unpersist()
        if errors:
            raise DeliveryFailed("; ".join(map(str, errors))) from errors[0]

    def _one(self, name: str, events: DataFrame, batch: int) -> Exception | None:
        began, error = time.monotonic(), None
        try:
            rows = self.rows_for(name, events)
            if self.conf.dlq_enabled and self.tables is not None:
                self.tables.guard(name, rows, lambda r: self.deliver(name, r, batch))
            elif self.conf.dlq_enabled:
                self.letters.guard(name, batch, rows, lambda: self.deliver(name, rows, batch))
            else:
                self.deliver(name, rows, batch)
        except Exception as e:
            error = e
            self.counters["sink_errors_total", name, error_class(str(e))] += 1
        self.counters["events_processed_total", name, "error" if error else "success"] += 1
        self.results.append({"sink": name, "batch": batch, "success": error is None, "seconds": time.monotonic() - began})
        return error
