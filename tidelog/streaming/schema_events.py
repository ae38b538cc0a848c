"""Schema changes to observers [C13, C14, K10]: in order, advisory; none of them ever fails the stream."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import schema_diff, stats


class Observer(Protocol):
    name: str

    def __call__(self, changes: DataFrame, batch: int) -> None: ...


class Recorder:
    """The newest changes, and how many there were of each kind by table."""

    name = "recorder"

    def __init__(self, most: int = stats.SCHEMA_CHANGES):
        self.changes: deque = deque(maxlen=most)
        self.counts: Counter[tuple[str, str, str]] = Counter()
        self.total = 0

    def __call__(self, changes: DataFrame, batch: int) -> None:
        for r in changes.select("schema", "table", F.explode("kinds").alias("kind")).groupBy("schema", "table", "kind").count().collect():
            self.counts[r.schema, r.table, r.kind] += r["count"]
        self.total += changes.count()
        for r in reversed(changes.orderBy(F.desc("lsn_num")).limit(self.changes.maxlen).collect()):
            self.changes.append(r.asDict(recursive=True))


class Publisher:
    """Appends notifications to a stream's folder, one folder a batch: a replay overwrites its own."""

    name = "publisher"

    def __init__(self, path: str, prefix: str = "cdc", enabled: bool = True):
        self.path, self.prefix, self.enabled = path, prefix, enabled

    def __call__(self, changes: DataFrame, batch: int) -> None:
        if self.enabled:
            schema_diff.notifications(changes, self.prefix).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


class FanOut:
    """Every observer sees every batch's changes; an error is counted by observer and goes no further."""

    def __init__(self, observers: Sequence[Observer], log: Callable[[str], None] = print):
        self.observers, self.log = list(observers), log
        self.errors: Counter[str] = Counter()

    def __call__(self, changes: DataFrame, batch: int) -> None:
        for observer in self.observers:
            try:
                observer(changes, batch)
            except Exception as e:
                self.errors[observer.name] += 1
                self.log(f"schema observer {observer.name} failed on batch {batch}: {e}")
