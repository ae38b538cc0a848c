"""Queries over delivery attempts, statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_LOG_SQL, read
from ..operators import attempts as att
from ..operators import schema_diff, stats
from .registry import Plans
from .state import _TABLES_SQL, _mixed

plans = Plans()
query = plans.query


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four attempts of each seventh event fail, each eleventh fails twice, each thirteenth meets an open circuit once."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    rows = e.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    out = (
        F.when(F.col("event_id") % 7 == 0, F.lit("error"))
        .when((F.col("event_id") % 11 == 0) & (F.col("attempt") <= 2), F.lit("error"))
        .when((F.col("event_id") % 13 == 0) & (F.col("attempt") == 1), F.lit("circuit_open"))
        .otherwise(F.lit("ok"))
    )
    return rows.select(
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("sink"), F.col("event_id").cast("string").alias("event_id"), "attempt", out.alias("outcome"),
        F.when(out == "error", F.concat(F.lit("dial timeout "), F.col("attempt").cast("string"))).alias("error"), F.timestamp_seconds(F.unix_timestamp("t") + F.col("attempt")).alias("ts"),
    )


_ATTEMPTS_SQL = """
a AS (SELECT 's' || (event_id % 3)::VARCHAR AS sink, event_id::VARCHAR AS event_id, attempt, outcome, CASE WHEN outcome = 'error' THEN 'dial timeout ' || attempt::VARCHAR END AS error, epoch(date_trunc('second', ts))::BIGINT + attempt AS ts
      FROM (SELECT event_id, ts, attempt, CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 11 = 0 AND attempt <= 2 THEN 'error' WHEN event_id % 13 = 0 AND attempt = 1 THEN 'circuit_open' ELSE 'ok' END AS outcome
            FROM events, (VALUES (1), (2), (3), (4)) n(attempt)))
"""
_ISLANDS = f"WITH {_ATTEMPTS_SQL}, i AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY sink, event_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS island FROM a WHERE outcome <> 'circuit_open') "


@query(_ISLANDS + "SELECT sink, event_id, island, count(*) AS failures, min(ts) AS first_failed, max(ts) AS last_failed, arg_max(error, attempt) AS last_error FROM i WHERE outcome = 'error' GROUP BY ALL")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = att.streaks(attempt_log(spark, sf_dir))
    return rows.select("sink", "event_id", "island", "failures", F.unix_timestamp("first_failed_at").alias("first_failed"), F.unix_timestamp("last_failed_at").alias("last_failed"), "last_error")


_PARKED = _ISLANDS + ", p AS (SELECT sink, event_id, 3::BIGINT AS attempts, min(ts) AS first_failed, min(ts) + 2 AS last_failed, 'dial timeout 3' AS error FROM i WHERE outcome = 'error' GROUP BY sink, event_id, island HAVING count(*) >= 3) "


@query(_PARKED + "SELECT sink || ':' || event_id AS id, attempts, error, first_failed, last_failed FROM p")
def dlq_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = att.parked(attempt_log(spark, sf_dir), 3)
    return rows.select("id", F.col("attempts").cast("long").alias("attempts"), "error", F.unix_timestamp("first_failed_at").alias("first_failed"), F.unix_timestamp("last_failed_at").alias("last_failed"))


@query(_PARKED + "SELECT sink || ':' || event_id AS id, last_failed FROM p ORDER BY last_failed DESC, id LIMIT 100")
def dlq_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.newest(att.parked(attempt_log(spark, sf_dir), 3), 100).select("id", F.unix_timestamp("last_failed_at").alias("last_failed"))


@query(_PARKED + "SELECT sink, count(*) AS parked, count(*) FILTER (place > 200) AS stalled FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY last_failed, event_id) AS place FROM p) GROUP BY sink")
def dlq_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = att.parked(attempt_log(spark, sf_dir), 3, most=200)
    return rows.groupBy("sink").agg(F.count("*").alias("parked"), F.count_if("stalled").alias("stalled"))


@query(_PARKED + "SELECT sink || ':' || event_id AS id, error FROM p WHERE event_id::BIGINT % 2 = 0")
def dlq_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = att.parked(attempt_log(spark, sf_dir), 3)
    index = attempt_log(spark, sf_dir).where("cast(event_id as long) % 2 = 0 AND attempt = 1").select(F.concat_ws(":", "sink", "event_id").alias("id"))
    return att.indexed(index, entries).select("id", "error")


@query(f"WITH {_ATTEMPTS_SQL} SELECT count(*) AS retried, count(*) FILTER (outcome = 'ok') AS succeeded, count(*) FILTER (outcome <> 'ok') AS failed FROM a WHERE attempt = 3")
def retry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.retry_summary(attempt_log(spark, sf_dir).where("attempt = 3").select((F.col("outcome") == "ok").alias("success")))


@query(f"WITH {_ATTEMPTS_SQL} SELECT CASE WHEN error IS NULL AND outcome = 'circuit_open' THEN 'circuit_open' WHEN error LIKE '%timeout%' THEN 'timeout' ELSE 'other' END AS error_type, count(*) AS errors FROM a WHERE outcome <> 'ok' GROUP BY 1")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempt_log(spark, sf_dir).where("outcome <> 'ok'")
    text = F.coalesce("error", F.lit("circuit breaker is open"))
    return rows.select(att.error_class(text).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("errors"))


#: One attempt after another: st is whether the circuit is open, f the failures in a row, since when it opened; then counts by outcome and state.
_STEP = """{'t': x.t, 'ok': x.ok,
    'st': CASE WHEN s.st AND x.t - s.since < 30 THEN true WHEN x.ok THEN false ELSE s.st OR s.f + 1 >= 5 END,
    'f': CASE WHEN s.st AND x.t - s.since < 30 OR x.ok OR s.st OR s.f + 1 >= 5 THEN 0 ELSE s.f + 1 END,
    'since': CASE WHEN NOT x.ok AND (s.st AND x.t - s.since >= 30 OR NOT s.st AND s.f + 1 >= 5) THEN x.t ELSE s.since END,
    'n1': s.n1 + CASE WHEN NOT (s.st AND x.t - s.since < 30) AND x.ok THEN 1 ELSE 0 END,
    'n2': s.n2 + CASE WHEN NOT x.ok AND NOT s.st AND s.f + 1 < 5 THEN 1 ELSE 0 END,
    'n3': s.n3 + CASE WHEN NOT x.ok AND (s.st AND x.t - s.since >= 30 OR NOT s.st AND s.f + 1 >= 5) THEN 1 ELSE 0 END,
    'n4': s.n4 + CASE WHEN s.st AND x.t - s.since < 30 THEN 1 ELSE 0 END}"""
_BREAKER_SQL = f"""WITH {_ATTEMPTS_SQL},
l AS (SELECT sink, list({{'t': ts, 'ok': outcome = 'ok', 'st': false, 'f': 0, 'since': 0::BIGINT, 'n1': 0::BIGINT, 'n2': 0::BIGINT, 'n3': 0::BIGINT, 'n4': 0::BIGINT}} ORDER BY ts, event_id) AS xs FROM a WHERE outcome <> 'circuit_open' GROUP BY sink),
r AS (SELECT sink, list_reduce(xs, lambda s, x: {_STEP}, {{'t': 0::BIGINT, 'ok': true, 'st': false, 'f': 0, 'since': 0::BIGINT, 'n1': 0::BIGINT, 'n2': 0::BIGINT, 'n3': 0::BIGINT, 'n4': 0::BIGINT}}) AS z FROM l)
SELECT sink, outcome, state, attempts FROM (SELECT sink, 'ok' AS outcome, 'closed' AS state, z.n1 AS attempts FROM r UNION ALL SELECT sink, 'error', 'closed', z.n2 FROM r UNION ALL SELECT sink, 'error', 'open', z.n3 FROM r UNION ALL SELECT sink, 'circuit_open', 'open', z.n4 FROM r) WHERE attempts > 0"""


@query(_BREAKER_SQL)
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine in time order, folded sink by sink."""
    return att.breaker(attempt_log(spark, sf_dir).where("outcome <> 'circuit_open'")).groupBy("sink", "outcome", "state").agg(F.count("*").alias("attempts"))


# -- roll-ups [A1-A16] ------------------------------------------------------------------------------------


@query(_TABLES_SQL + 'SELECT schema, tbl AS "table", op, count(*) AS events FROM ev GROUP BY ALL')
def events_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.received(_mixed(spark, sf_dir))


_PIVOT = "SELECT schema || '.' || tbl AS table_name, " + ", ".join(f"count(*) FILTER (op = '{o}') AS \"{o.lower()}\"" for o in ("INSERT", "UPDATE", "DELETE", "TRUNCATE", "READ")) + ", count(*) AS total FROM ev GROUP BY 1"


@query(_TABLES_SQL + _PIVOT)
def per_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_table(_mixed(spark, sf_dir))


@query(_TABLES_SQL + "SELECT op, count(*) AS events FROM ev GROUP BY ROLLUP (op)")
def operation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.operation_totals(_mixed(spark, sf_dir))


@query(_TABLES_SQL + "SELECT op, events, round(events * 100.0::DOUBLE / sum(events) OVER (), 1) AS percent FROM (SELECT op, count(*) AS events FROM ev GROUP BY op)")
def op_mix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.operation_mix(_mixed(spark, sf_dir)).select("op", "events", F.col("percent").cast("double").alias("percent"))


@query(_TABLES_SQL + "SELECT table_name, total, round(total * 100.0::DOUBLE / sum(total) OVER (), 6) AS share FROM (SELECT schema || '.' || tbl AS table_name, count(*) AS total FROM ev GROUP BY 1)")
def table_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_shares(_mixed(spark, sf_dir)).select("table_name", "total", F.round(F.col("share").cast("double"), 6).alias("share"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 7 == 0, F.lit("error")).otherwise(F.lit("success"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (e % 3).cast("string")).alias("sink"), status.alias("status"), F.when(e % 14 == 0, F.lit("timeout")).when(e % 7 == 0, F.lit("other")).alias("error_type"),
        (e % 5 == 0).cast("long").alias("filtered"), (e % 4).alias("retries"), (e % 3).alias("breaker"), e.alias("ts"), ((e % 1000) / 1000.0).cast("double").alias("seconds"),
    )


_DELIVERIES_SQL = """
d AS (SELECT 's' || (event_id % 3)::VARCHAR AS sink, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 14 = 0 THEN 'timeout' WHEN event_id % 7 = 0 THEN 'other' END AS error_type,
             CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS filtered, event_id % 4 AS retries, event_id % 3 AS breaker, event_id AS ts, (event_id % 1000) / 1000.0::DOUBLE AS seconds FROM events)
"""


@query(f"WITH {_DELIVERIES_SQL} SELECT sink, count(*) FILTER (status = 'success') AS processed, count(*) FILTER (status <> 'success') AS failed, sum(filtered)::BIGINT AS filtered, sum(retries)::BIGINT AS retries, arg_max(breaker, ts) AS breaker FROM d GROUP BY sink")
def sink_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sink_outcomes(deliveries(spark, sf_dir))


@query(f"WITH {_DELIVERIES_SQL} SELECT sink, error_type, count(*) AS n FROM d WHERE error_type IS NOT NULL GROUP BY ALL")
def errors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.errors_by_type(deliveries(spark, sf_dir)).select("sink", F.explode("errors").alias("error_type", "n"))


_BOUNDS = ", ".join(f"({b!r}::DOUBLE)" for b in stats.BUCKETS)


@query(f"WITH {_DELIVERIES_SQL}, b AS (SELECT * FROM (VALUES {_BOUNDS}, ('inf'::DOUBLE)) v(le)) SELECT sink, le, count(*) FILTER (seconds <= le) AS events FROM d, b GROUP BY sink, le")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_histogram(deliveries(spark, sf_dir))


@query(
    f"""WITH {_DELIVERIES_SQL}, o AS (SELECT sink, count(*) FILTER (status = 'success') AS processed, count(*) FILTER (status <> 'success') AS failed, sum(filtered)::BIGINT AS filtered, sum(retries)::BIGINT AS retries FROM d WHERE sink <> 's2' GROUP BY sink),
    h AS (SELECT * FROM (VALUES ('s1', true), ('s2', true), ('s9', false)) v(sink, healthy))
    SELECT sink, coalesce(healthy, false) AS healthy, coalesce(processed, 0) AS processed, coalesce(failed, 0) AS failed, coalesce(filtered, 0) AS filtered, coalesce(retries, 0) AS retries FROM o FULL JOIN h USING (sink)"""
)
def sink_health_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = spark.createDataFrame([("s1", True), ("s2", True), ("s9", False)], "sink string, healthy boolean")
    return stats.with_health(stats.sink_outcomes(deliveries(spark, sf_dir)).where("sink <> 's2'"), health)


@query("SELECT false AS ready")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ready(spark.createDataFrame([("s1", True), ("s9", False)], "sink string, healthy boolean"), True)


# -- rates, retention, listings [W6-W11] ---------------------------------------------------------------------

_SAMPLES_SQL = "samples AS (SELECT event_type, t, sum(n) OVER (PARTITION BY event_type ORDER BY t)::BIGINT AS events_total FROM (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS t, count(*) AS n FROM events GROUP BY ALL))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    per = read(spark, sf_dir, "events").groupBy("event_type", hour.alias("t")).agg(F.count("*").alias("n"))
    return per.select("event_type", "t", F.sum("n").over(Window.partitionBy("event_type").orderBy("t")).alias("events_total"))


@query(f"WITH {_SAMPLES_SQL} SELECT event_type, t, events_total, CASE WHEN lag(t) OVER w IS NULL THEN NULL WHEN t <= lag(t) OVER w THEN 0.0 ELSE greatest(0.0::DOUBLE, (events_total - lag(events_total) OVER w)::DOUBLE / (t - lag(t) OVER w)::DOUBLE) END AS rate FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY t)")
def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.throughput(samples(spark, sf_dir), ["event_type"])


@query(f"WITH {_SAMPLES_SQL} SELECT event_type, t, events_total FROM samples ORDER BY t DESC, event_type DESC LIMIT 360")
def history_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_rows(samples(spark, sf_dir), "t", stats.HISTORY_SAMPLES, ties="event_type")


@query(f"WITH {EVENT_LOG_SQL} SELECT user_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM log) WHERE r <= 10")
def stream_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..model import event_log

    return stats.last_rows(event_log(spark, sf_dir).select("user_id", "pos"), "pos", 10, ["user_id"])


@query("SELECT 'c' || l_suppkey::VARCHAR AS table_name, count(*) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, table_name LIMIT 8")
def busiest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("table_name")).agg(F.count("*").alias("total"))
    return stats.busiest(per)


@query("SELECT k AS pos, 'public.t' || r::VARCHAR AS table_name, CASE WHEN wide THEN 'added b' ELSE 'dropped b' END AS summary FROM (SELECT *, lag(wide) OVER (PARTITION BY r ORDER BY k) AS before FROM (SELECT o_orderkey AS k, o_orderkey % 10 AS r, o_orderstatus = 'F' AS wide FROM orders)) WHERE before <> wide ORDER BY k DESC LIMIT 200")
def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of the newest 200 schema changes, newest first: ten tables that gain and lose a column as orders come."""
    column = lambda n: F.struct(F.lit(n).alias("name"), F.lit(23).cast("long").alias("type_oid"), F.lit("int4").alias("type"), F.lit(False).alias("key"))
    o, r = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    described = o.select(
        r.alias("relation_id"), F.col("o_orderkey").cast("decimal(20,0)").alias("lsn_num"), F.lit("public").alias("schema"), F.concat(F.lit("t"), r.cast("string")).alias("table"), F.lit("d").alias("identity"),
        F.when(F.col("o_orderstatus") == "F", F.array(column("a"), column("b"))).otherwise(F.array(column("a"))).alias("columns"),
    )
    rows = schema_diff.changes(described).select(F.col("lsn_num").cast("long").alias("pos"), F.concat_ws(".", "schema", "table").alias("table_name"), "summary")
    return stats.last_rows(rows, "pos", stats.SCHEMA_CHANGES)


@query(
    """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1e6) || 'M' WHEN n >= 1000 THEN printf('%.1f', n / 1e3) || 'k' ELSE n::VARCHAR END AS compact FROM (SELECT o_orderkey, o_orderkey * 100 + 1 AS n FROM orders)"""
)
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", stats.compact_number(F.col("o_orderkey") * 100 + 1).alias("compact"))


@query(f"WITH {_DELIVERIES_SQL} SELECT 'cdc_events_processed_total{{sink=\"' || sink || '\",status=\"' || status || '\"}} ' || count(*)::VARCHAR AS line FROM d GROUP BY sink, status")
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = deliveries(spark, sf_dir).groupBy("sink", "status").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("sink"), F.col("sink"), F.lit("status"), F.col("status"))
    return stats.exposition(per.select(F.lit("events_processed_total").alias("name"), labels.alias("labels"), "value"))
