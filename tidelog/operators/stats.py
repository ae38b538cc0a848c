"""Counters, roll-ups, rates and listings [A1-A16, W5-W14, J7, P21]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import OPERATIONS, full_name

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
HISTORY_SAMPLES, SCHEMA_CHANGES = 360, 200


def received(events: DataFrame) -> DataFrame:
    """Counted before exclusion, snapshot reads included."""
    return events.groupBy("schema", "table", "op").agg(F.count("*").alias("events"))


def per_table(events: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("op") == op).alias(op.lower()) for op in OPERATIONS]
    return events.groupBy(full_name().alias("table_name")).agg(*counts, F.count("*").alias("total"))


def operation_totals(events: DataFrame) -> DataFrame:
    """By operation, and all together in the row without one."""
    return events.rollup("op").agg(F.count("*").alias("events"))


def sink_outcomes(deliveries: DataFrame) -> DataFrame:
    """processed, failed, filtered, retries and the last breaker state of each sink; all but success failed."""
    return deliveries.groupBy("sink").agg(
        F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.col("status") != "success").alias("failed"),
        F.sum("filtered").alias("filtered"), F.sum("retries").alias("retries"), F.max_by("breaker", "ts").alias("breaker"),
    )


def errors_by_type(deliveries: DataFrame) -> DataFrame:
    per = deliveries.where("error_type IS NOT NULL").groupBy("sink", "error_type").agg(F.count("*").alias("n"))
    return per.groupBy("sink").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n")))).alias("errors"))


def latency_histogram(deliveries: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts by upper bound, as an exposition has them; the last bound is infinity."""
    sums = [F.count_if(F.col("seconds") <= b).alias(str(i)) for i, b in enumerate(buckets)]
    per = deliveries.groupBy("sink").agg(*sums, F.count("*").alias(str(len(buckets))))
    bounds = [*map(float, buckets), float("inf")]
    return per.select("sink", F.posexplode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)))).alias("i", "b")).select("sink", "b.le", F.col("b.n").alias("events"))


def table_shares(events: DataFrame) -> DataFrame:
    per = per_table(events).select("table_name", "total")
    return per.withColumn("share", F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy()))


def operation_mix(events: DataFrame) -> DataFrame:
    """Operations that occurred, with their percentage to one decimal."""
    per = events.groupBy("op").agg(F.count("*").alias("events"))
    return per.withColumn("percent", F.round(F.col("events") * 100.0 / F.sum("events").over(Window.partitionBy()), 1))


def throughput(samples: DataFrame, by: list[str], time: str = "t", total: str = "events_total") -> DataFrame:
    """Events a second between samples; never negative, 0 where time doesn't advance, none for the first."""
    order = Window.partitionBy(*by).orderBy(time)
    dt = F.col(time) - F.lag(time).over(order)
    dx = F.col(total) - F.lag(total).over(order)
    return samples.withColumn("rate", F.when(dt.isNull(), F.lit(None).cast("double")).when(dt <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dx / dt)))


def last_rows(rows: DataFrame, order: str, keep: int, by: list[str] | None = None, ties: str | None = None) -> DataFrame:
    """Retention: the newest rows by an ordering, of the whole table (a top-n) or of each group."""
    columns = [F.desc(order), *([F.desc(ties)] if ties else [])]
    if not by:
        return rows.orderBy(*columns).limit(keep)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*columns))).where(F.col("_r") <= keep).drop("_r")


def busiest(tables: DataFrame, most: int = 8) -> DataFrame:
    return tables.orderBy(F.desc("total"), "table_name").limit(most)


def with_health(outcomes: DataFrame, health: DataFrame) -> DataFrame:
    """Every sink that either side knows; what the other side lacks is 0 or false."""
    both = outcomes.join(health, "sink", "full_outer")
    return both.select("sink", F.coalesce("healthy", F.lit(False)).alias("healthy"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("processed", "failed", "filtered", "retries")))


def ready(health: DataFrame, streaming: bool) -> DataFrame:
    return health.agg((F.coalesce(F.bool_and("healthy"), F.lit(True)) & F.lit(streaming)).alias("ready"))


def compact_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(n.cast("long").cast("string"))


def compact_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def compact_duration(seconds: Column) -> Column:
    """The two largest units of a time: 45s, 2m 5s, 3h 7m, 2d 4h."""
    n = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    two = lambda a, b, big, small: F.concat(F.floor(n / a).cast("string"), F.lit(f"{big} "), F.floor((n % a) / b).cast("string"), F.lit(small))
    return F.when(n >= 86400, two(86400, 3600, "d", "h")).when(n >= 3600, two(3600, 60, "h", "m")).when(n >= 60, two(60, 1, "m", "s")).otherwise(F.concat(n.cast("string"), F.lit("s")))


def compact_rate(rate: Column) -> Column:
    """Events a second: one decimal below ten, none above."""
    return F.concat(F.when(rate < 10, F.format_string("%.1f", rate.cast("double"))).otherwise(compact_number(F.round(rate))), F.lit("/s"))


def time_ago(then: Column, now: Column) -> Column:
    """How long ago, in one unit; both in seconds."""
    n = F.greatest(F.lit(0), now - then).cast("long")
    one = lambda a, unit: F.concat(F.floor(n / a).cast("string"), F.lit(f"{unit} ago"))
    return F.when(n >= 86400, one(86400, "d")).when(n >= 3600, one(3600, "h")).when(n >= 60, one(60, "m")).otherwise(one(1, "s"))


def letter_totals(counters: DataFrame) -> DataFrame:
    """(parked, retried) over all sinks and outcomes of the dead-letter counters (name, labels, value)."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0)).cast("long")
    return counters.agg(of("dlq_parked_total").alias("parked"), of("dlq_retried_total").alias("retried"))


def sorted_listing(rows: DataFrame, column: str, descending: bool = False, alphanumeric: bool = False) -> DataFrame:
    """A listing ordered by any of its columns; alphanumeric order compares runs of digits as numbers."""
    key = F.col(column)
    if alphanumeric:
        parts = F.regexp_extract_all(F.lower(key.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(1))
        key = F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")).alias("n"), p.alias("t")))
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return rows.orderBy(first, *(F.col(c) for c in rows.columns if c != column and rows.schema[c].dataType.typeName() not in ("map", "variant")))


#: Metric names without their prefix, kind and labels.
METRICS = {
    "events_received_total": ("counter", ("schema", "table", "operation")), "events_processed_total": ("counter", ("sink", "status")),
    "event_processing_duration_seconds": ("histogram", ("sink",)), "sink_errors_total": ("counter", ("sink", "error_type")),
    "circuit_breaker_state": ("gauge", ("sink",)), "wal_lag_bytes": ("gauge", ()), "active_sinks": ("gauge", ()), "retry_attempts_total": ("counter", ("sink",)),
    "events_excluded_total": ("counter", ("schema", "table")), "inflight_events": ("gauge", ()), "last_processed_lsn": ("gauge", ()),
    "events_filtered_total": ("counter", ("sink", "schema", "table")), "backfill_rows_total": ("counter", ("schema", "table")), "dlq_entries": ("gauge", ()),
    "dlq_parked_total": ("counter", ("sink",)), "dlq_retried_total": ("counter", ("sink", "status")), "schema_changes_total": ("counter", ("schema", "table", "kind")),
    "schema_publish_errors_total": ("counter", ("target",)),
}


def exposition(samples: DataFrame, prefix: str = "cdc_") -> DataFrame:
    """One text line for each sample (name, labels map, value) of a known metric."""
    rows = samples.where(F.col("name").isin(*METRICS))
    labels = F.array_join(F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))), ",")
    head = F.concat(F.lit(prefix), "name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")))
    return rows.select(F.concat_ws(" ", head, F.col("value").cast("string")).alias("line"))
