"""Retries, dead letters and circuit breaking over a log of delivery attempts [A9, A12, T6-T11, P20, K8, W3, J10].

An attempt is one whole retry cycle of a sink on an event: (sink, event_id, attempt, outcome, error, ts)
with outcome ok, error or circuit_open. Open-circuit attempts never count towards dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, ERROR, OPEN = "ok", "error", "circuit_open"
BREAKER_STATES = {"closed": 0, "half-open": 1, "open": 2}


def error_class(error: Column) -> Column:
    low = F.lower(error)
    return (
        F.when(F.contains(low, F.lit("circuit breaker is open")), F.lit("circuit_open"))
        .when(F.contains(low, F.lit("deadline exceeded")) | F.contains(low, F.lit("timeout")), F.lit("timeout"))
        .when(F.contains(low, F.lit("context canceled")) | F.contains(low, F.lit("cancelled")), F.lit("canceled"))
        .otherwise(F.lit("other"))
    )


def streaks(attempts: DataFrame) -> DataFrame:
    """Failures since the last success of each event at each sink: counted, with first and last time and the last error."""
    rows = attempts.where(F.col("outcome") != OPEN)
    order = Window.partitionBy("sink", "event_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    island = F.coalesce(F.sum(F.when(F.col("outcome") == OK, 1).otherwise(0)).over(order), F.lit(0))
    failed = rows.withColumn("island", island).where(F.col("outcome") == ERROR)
    return failed.groupBy("sink", "event_id", "island").agg(
        F.count("*").alias("failures"), F.min("ts").alias("first_failed_at"), F.max("ts").alias("last_failed_at"), F.max_by("error", "attempt").alias("last_error"), F.max("attempt").alias("last_attempt")
    )


def parked(attempts: DataFrame, threshold: int = 3, most: int | None = None) -> DataFrame:
    """Dead letters: streaks that reached the threshold, by id <sink>:<event_id>.

    `most` caps the queue per sink in order of parking; an event beyond it stalls instead (column stalled).
    """
    rows = attempts.where(F.col("outcome") != OPEN)
    order = Window.partitionBy("sink", "event_id").orderBy("attempt")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.when(F.col("outcome") == OK, 1).otherwise(0)).over(upto)
    rows = rows.withColumn("island", island).where(F.col("outcome") == ERROR)
    nth = F.row_number().over(Window.partitionBy("sink", "event_id", "island").orderBy("attempt"))
    first = F.min("ts").over(Window.partitionBy("sink", "event_id", "island"))
    rows = rows.withColumn("failures", nth).withColumn("first_failed_at", first).where(F.col("failures") == threshold)
    once = rows.groupBy("sink", "event_id").agg(F.min_by(F.struct(F.col("failures").alias("attempts"), "error", "first_failed_at", F.col("ts").alias("last_failed_at")), "attempt").alias("e"))
    out = once.select(F.concat_ws(":", "sink", "event_id").alias("id"), "sink", "event_id", "e.*")
    if most is None:
        return out.withColumn("stalled", F.lit(False))
    place = F.row_number().over(Window.partitionBy("sink").orderBy("last_failed_at", "event_id"))
    return out.withColumn("stalled", place > most)


def newest(entries: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first; a limit of zero or less lists all."""
    rows = entries.orderBy(F.desc("last_failed_at"), "id")
    return rows.limit(limit) if limit > 0 else rows


def list_limit(text: str | None) -> int:
    """The listing's limit from a request: 100 where it is missing, unreadable or not positive."""
    try:
        n = int(text or "")
    except ValueError:
        return 100
    return n if n > 0 else 100


def indexed(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that the index names; ids without an entry are skipped."""
    return index.join(entries, "id")


def upsert(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """The store after some parks: one row for each id, the update's if there is one."""
    both = entries.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_new"), F.desc("last_failed_at")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def retry_summary(results: DataFrame) -> DataFrame:
    """retried, succeeded, failed of a sweep over (id, success)."""
    return results.agg(F.count("*").alias("retried"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def breaker(attempts: DataFrame, threshold: int = 5, open_seconds: float = 30.0) -> DataFrame:
    """Replays each sink's circuit over its attempts in order of time: (sink, ts, event_id, outcome, state).

    The circuit opens after `threshold` failures in a row; while it is open attempts are refused; when
    open_seconds have passed one trial decides. A sink's log is folded as a stream of rows sorted
    by (sink, ts), so no sink's history is held in memory.
    """
    rows = attempts.select("sink", "ts", "event_id", F.col("outcome").alias("call"))
    dealt = rows.repartition("sink").sortWithinPartitions("sink", "ts", "event_id")

    def fold(batches):
        import pandas as pd

        sink, state, failures, since = None, "closed", 0, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.sink != sink:
                    sink, state, failures, since = r.sink, "closed", 0, None
                t = r.ts.timestamp()
                if state == "open" and t - since >= open_seconds:
                    state = "half-open"
                if state == "open":
                    out.append((r.sink, r.ts, r.event_id, OPEN, state))
                    continue
                if r.call == OK:
                    state, failures = "closed", 0
                else:
                    failures += 1
                    if state == "half-open" or failures >= threshold:
                        state, failures, since = "open", 0, t
                out.append((r.sink, r.ts, r.event_id, r.call, state))
            yield pd.DataFrame(out, columns=["sink", "ts", "event_id", "outcome", "state"])

    return dealt.mapInPandas(fold, "sink string, ts timestamp, event_id string, outcome string, state string")
