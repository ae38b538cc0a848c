"""Dead letters by event, kept as tables [K8, T8-T11, A7, W3]: they outlive the driver.

A sink that knows which events it failed raises EventsFailed with them; any other error fails the whole
batch. Failed cycles are counted by (sink, event); at the threshold the event, already transformed, is
parked and the stream goes on without it. Open circuits are no failed cycles. Only numbers come to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT
from ..operators import attempts
from ..storage import Versions
from .delivery import CircuitOpen, EventsFailed, QueueFull

ENTRY = f"id string, sink string, event_id string, event {EVENT.simpleString()}, error string, attempts int, first_failed_at timestamp, last_failed_at timestamp"
COUNT = "sink string, event_id string, failures int, first_failed_at timestamp"


class LetterTables:
    def __init__(self, spark: SparkSession, path: str, threshold: int = 3, most: int | None = 10_000, clock: Callable = F.current_timestamp):
        """`most` bounds the queue: what would go beyond it stalls the stream instead. None: no bound, entries are rows of a table."""
        self.entries, self.counts = Versions(spark, f"{path}/entries", ENTRY), Versions(spark, f"{path}/counts", COUNT)
        self.spark, self.threshold, self.most, self.clock = spark, threshold, most, clock
        self.totals: Counter[tuple[str, str]] = Counter()  # (sink, parked, succeeded or failed)

    def pending(self, sink: str, rows: DataFrame) -> DataFrame:
        """What of a batch is to be delivered: not what is parked already, for a replayed batch."""
        return rows.join(self.entries.read().where(F.col("sink") == sink).select("event_id"), "event_id", "left_anti")

    def guard(self, sink: str, rows: DataFrame, work: Callable[[DataFrame], None]) -> bool:
        """True if all of it was delivered, False if some was parked; errors below the threshold propagate."""
        rows = self.pending(sink, rows)
        try:
            work(rows)
        except CircuitOpen:
            raise
        except Exception as e:
            failed = e.failed if isinstance(e, EventsFailed) else rows.select("event_id", F.lit(str(e)).alias("error"))
            if self.failed(sink, rows, failed):
                raise
            return False
        if self.counts.numbers():
            self._clear(sink, rows.select("event_id"))
        return True

    def _clear(self, sink: str, ids: DataFrame) -> None:
        done = ids.select(F.lit(sink).alias("sink"), "event_id")
        self.counts.write(self.counts.read().join(done, ["sink", "event_id"], "left_anti"))

    def failed(self, sink: str, rows: DataFrame, failed: DataFrame) -> int:
        """Count a failed cycle of these events and park those at the threshold; how many are below it."""
        known = self.counts.read().where(F.col("sink") == sink)
        now = failed.groupBy("event_id").agg(F.max("error").alias("error")).join(known.drop("sink"), "event_id", "left")
        now = now.select("event_id", "error", (F.coalesce("failures", F.lit(0)) + 1).cast("int").alias("failures"), F.coalesce("first_failed_at", self.clock()).alias("first_failed_at"))
        now = now.persist()
        try:
            below = now.where(F.col("failures") < self.threshold)
            ripe = now.where(F.col("failures") >= self.threshold).join(rows.select("event_id", F.struct(*EVENT.names).alias("event")), "event_id")
            n = ripe.count()
            if n:
                if self.most is not None and self.depth() + n > self.most:
                    raise QueueFull(f"dead letters are full ({self.most}); last error: {now.first().error}")
                entry = ripe.select(F.concat_ws(":", F.lit(sink), "event_id").alias("id"), F.lit(sink).alias("sink"), "event_id", "event", "error", F.col("failures").alias("attempts"), "first_failed_at", self.clock().alias("last_failed_at"))
                self.entries.write(attempts.upsert(self.entries.read(), entry))
                self.totals[sink, "parked"] += n
            others = self.counts.read().join(now.select(F.lit(sink).alias("sink"), "event_id"), ["sink", "event_id"], "left_anti")
            self.counts.write(others.unionByName(below.select(F.lit(sink).alias("sink"), "event_id", "failures", "first_failed_at")))
            return below.count()
        finally:
            now.unpersist()

    def depth(self) -> int:
        return self.entries.read().count()

    def list(self, limit: int = 100) -> DataFrame:
        return attempts.newest(self.entries.read(), limit)

    def retry(self, key: str | None, deliver: Callable[[str, DataFrame], None]) -> dict[str, int]:
        """Deliver one entry, or all of them, sink by sink; failures get another attempt, successes are removed."""
        found = self.entries.read() if key is None else self.entries.read().where(F.col("id") == key)
        n = Counter({r.sink: r["count"] for r in found.groupBy("sink").count().collect()})
        if key is not None and not n:
            raise KeyError(f"no dead letter {key!r}")
        done = 0
        for sink in sorted(n):
            own = found.where(F.col("sink") == sink)
            rows, error = own.select("event.*"), None
            try:
                deliver(sink, rows)
            except EventsFailed as e:
                error = e.failed.groupBy("event_id").agg(F.max("error").alias("now"))
            except Exception as e:
                error = own.select("event_id", F.lit(str(e)).alias("now"))
            tried = own.select("id", "event_id") if error is None else own.select("id", "event_id").join(error, "event_id", "left")
            tried = tried.withColumn("now", F.lit(None).cast("string")) if error is None else tried
            all_ = self.entries.read().join(tried.select("id", "now", F.lit(True).alias("tried")), "id", "left").where("tried IS NULL OR now IS NOT NULL")
            hit = F.col("tried").isNotNull()
            all_ = all_.withColumns({"attempts": F.col("attempts") + F.when(hit, 1).otherwise(0), "error": F.coalesce("now", "error"), "last_failed_at": F.when(hit, self.clock()).otherwise(F.col("last_failed_at"))})
            bad = 0 if error is None else tried.where("now IS NOT NULL").count()
            self.entries.write(all_)
            done += n[sink] - bad
            self.totals[sink, "succeeded"] += n[sink] - bad
            self.totals[sink, "failed"] += bad
        total = sum(n.values())
        return {"retried": total, "succeeded": done, "failed": total - done}

    def discard(self, key: str) -> None:
        rest = self.entries.read().where(F.col("id") != key)
        if rest.count() == self.depth():
            raise KeyError(f"no dead letter {key!r}")
        self.entries.write(rest)
