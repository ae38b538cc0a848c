"""Queries over delivery control, backfill runs, configuration and listings: the operators run, their outcome is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import template
from ..model import EVENT_LOG_SQL, ORDER_LOG_SQL, envelope, order_log, read
from ..operators import apply, attempts, outbox, route, schema_diff, stats
from ..sources.config import Outbox, Settings, Sink, Table, Transform, routing, settings, summary, validate
from ..storage import fresh
from ..streaming.coordinator import Coordinator, Source, split_name
from ..streaming.delivery import DeliveryFailed, EventsFailed, Pipeline, Registry, backoffs
from ..streaming.letters import LetterTables
from ..streaming.schema_events import FanOut, Publisher, Recorder
from ..streaming.sinks import AppendLog, Messages, MessageBus, Mirror, Progress
from .delivery import _DELIVERIES_SQL, deliveries
from .registry import Plans
from .snapshot import _DIFF_SQL, relations

plans = Plans()
query = plans.query


# -- configuration [S14, S15, P14, F13, A13] -----------------------------------------------------------------


@query("SELECT n_nationkey AS k, (CASE WHEN n_nationkey % 4 = 0 THEN 1000 ELSE n_nationkey * 10 END)::BIGINT AS chunk_size, n_nationkey % 3 <> 0 AS dlq_enabled, CASE WHEN n_nationkey % 2 = 0 THEN 90.0::DOUBLE ELSE 30.0::DOUBLE END AS breaker_timeout, CASE WHEN n_nationkey % 5 = 0 THEN 'stream,bus' ELSE 'bus' END AS sinks FROM nation")
def settings_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from environments: what can't be read falls back to its default."""

    def read_environment(k):
        import pandas as pd

        out = []
        for i in k.tolist():
            env = {"CDC_BACKFILL_CHUNK_SIZE": "many" if i % 4 == 0 else str(i * 10), "CDC_DLQ_ENABLED": "false" if i % 3 == 0 else "perhaps", "CDC_CIRCUIT_BREAKER_TIMEOUT": "1m30s" if i % 2 == 0 else "soon", "NATS_URL": "bus:1", "REDIS_URL": "r:1" if i % 5 == 0 else ""}
            s = settings(env)
            out.append((s.backfill_chunk_size, s.dlq_enabled, s.breaker_timeout, ",".join(s.enabled_sinks)))
        return pd.DataFrame(out, columns=["chunk_size", "dlq_enabled", "breaker_timeout", "sinks"])

    made = F.pandas_udf(read_environment, "chunk_size long, dlq_enabled boolean, breaker_timeout double, sinks string")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), made("n_nationkey").alias("s")).select("k", "s.*")


ROUTING = {
    "redis_stream": {"sync_all": False, "default_key_pattern": "all", "tables": {"orders": "orders:{{.Table}}", "public.sessions": {"key": "s:{{.Operation}}", "transform": {"drop_columns": ["props"]}}}},
    "redis_json": {"sync_all": True, "transform": {"mask": {"customer": "last4"}}},
    "meilisearch": {"tables": {"orders": {"index": "o"}, "public.orders": {"index": ""}, "sessions": "s"}},
    "webhook": {"tables": {"orders": None}},
    "outbox": {"table": "orders", "columns": {"topic": "status", "payload": "customer"}, "default_topic": "misc"},
}


@query("SELECT * FROM (VALUES ('orders', 'stream', true, 'orders:{{.Table}}'), ('sessions', 'stream', true, 's:{{.Operation}}'), ('other', 'stream', false, 'all'), ('orders', 'document', true, 'd'), ('sessions', 'document', true, 'd'), ('other', 'document', true, 'd'), ('orders', 'index', false, 'o'), ('sessions', 'index', true, 's'), ('other', 'index', false, 'd'), ('orders', 'webhook', true, 'd'), ('sessions', 'webhook', false, 'd'), ('other', 'webhook', false, 'd'), ('orders', 'bus', false, 'd'), ('sessions', 'bus', false, 'd'), ('other', 'bus', false, 'd')) v(tbl, sink, takes, pattern)")
def routing_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of a routing file: which sink takes which table, and the key pattern or index it uses."""
    routes = routing(ROUTING)
    rows = [(t, n, s.selects("public", t), s.key_pattern("public", t, "d")) for n, s in routes.sinks.items() for t in ("orders", "sessions", "other")]
    return spark.createDataFrame(rows, "tbl string, sink string, takes boolean, pattern string")


@query("SELECT 'fail' AS status, 3::BIGINT AS checks UNION ALL SELECT 'ok', 2 UNION ALL SELECT 'warn', 4")
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks before a start: settings, transforms, selections, keys of masked columns, tables without identity, limits."""
    conf = Settings(backfill_mode="sometimes", dlq_threshold=9, breaker_threshold=5)
    bad = {"orders": Table('x:{{.Field "email"}}', Transform("new.a ==", (), (("email", "redact"),))), "users": Table("", Transform("", ("a",), (("b", "null"),))), "parts": Table("", Transform("", (), (("c", "rot13"),)))}
    routes = routing({}).sinks
    from ..sources.config import Routing

    sinks = {"stream": Sink("stream", tables=bad), "document": Sink("document", True, transform=Transform('op == "INSERT"')), "webhook": routes["webhook"]}
    found = summary(validate(conf, Routing(sinks), {"public.orders": ("id",), "public.lineitem": ()}))
    return spark.createDataFrame([(k, v) for k, v in found.items()], "status string, checks long")


@query("SELECT n_name AS name, n_name NOT LIKE '% %' AS valid FROM nation UNION ALL SELECT * FROM (VALUES ('a.b', true), ('a.b.c', false), ('a..b', false), ('1a', false), ('', false), ('a;drop', false)) v(name, valid)")
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be asked to be copied: an identifier, or two with a dot."""

    def check(names):
        def ok(n):
            try:
                return bool(split_name(n))
            except ValueError:
                return False

        return names.map(ok)

    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionAll(spark.createDataFrame([(n,) for n in ("a.b", "a.b.c", "a..b", "1a", "", "a;drop")], "name string"))
    return names.select("name", F.pandas_udf(check, "boolean")("name").alias("valid"))


# -- routing with an outbox, the outbox's sink [F6, F7, K7, P18] ----------------------------------------------


@query(f"WITH {ORDER_LOG_SQL} SELECT CASE WHEN op = 'INSERT' THEN 'outbox' END AS sink, op, count(*) AS events FROM olog WHERE op = 'INSERT' GROUP BY ALL UNION ALL SELECT s, 'INSERT', (SELECT count(*) FROM events e2 WHERE event_id % 2 = 0) FROM (VALUES ('document'), ('stream')) v(s)")
def outbox_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox table's inserts go to the outbox alone, its other changes nowhere; other tables go as routed."""
    e = read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.lit("INSERT").alias("op"), F.lit("public").alias("schema"), F.lit("sessions").alias("table"))
    both = order_log(spark, sf_dir).select("op", "schema", "table").unionByName(e)
    return route.route(both, routing(ROUTING | {"meilisearch": {}})).groupBy("sink", "op").agg(F.count("*").alias("events"))


@query(f"WITH {ORDER_LOG_SQL} SELECT 'events:O' AS stream, count(*) AS messages, count(*) AS deleted, sum(id)::BIGINT AS ids FROM olog WHERE op = 'INSERT'")
def outbox_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the outbox's inserts, written twice over (a replay), then deleted from the outbox."""
    box = routing(ROUTING).outbox
    gone, path = fresh(spark, "deleted"), fresh(spark, "outbox")
    sink = Messages(path, delete=lambda ids: ids.write.mode("overwrite").parquet(gone))
    rows = outbox.messages(order_log(spark, sf_dir), Outbox(box.schema, box.table, topic="status", payload="customer"))
    for _ in range(2):
        sink.process(rows, 0)
    deleted = spark.read.parquet(gone).agg(F.count("*").alias("deleted"), F.sum(F.col("id").cast("long")).alias("ids"))
    return spark.read.parquet(path).groupBy("stream").agg(F.count("*").alias("messages")).crossJoin(F.broadcast(deleted))


# -- sinks over replayed batches [K1, K2, K5, W1, W11, T4] ------------------------------------------------------


def _batches(log: DataFrame) -> list[DataFrame]:
    return [log.where(F.col("lsn_num") % 3 == i) for i in range(3)]


@query(f"WITH {ORDER_LOG_SQL} SELECT 'app:orders:' || op AS key, count(*) AS entries, min(pos) AS first, max(pos) AS last FROM olog GROUP BY op")
def appended_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log by key pattern; every batch is delivered twice and appears once."""
    sink = AppendLog(fresh(spark, "stream"), template("{{.Prefix}}:{{.Table}}:{{.Operation}}", "app"))
    for i, b in enumerate(_batches(order_log(spark, sf_dir))):
        sink.process(b, i)
        sink.process(b, i)
    return sink.read(spark).groupBy("key").agg(F.count("*").alias("entries"), F.min("lsn_num").cast("long").alias("first"), F.max("lsn_num").cast("long").alias("last"))


@query(f"WITH {EVENT_LOG_SQL} SELECT 'u' || user_id::VARCHAR AS key, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM log WHERE op <> 'DELETE') WHERE r <= 5")
def trimmed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that keeps five entries of each key."""
    sink = AppendLog(fresh(spark, "stream"), F.concat(F.lit("u"), F.element_at("new_data", F.lit("user_id"))), most=5)
    for i, b in enumerate(_batches(envelope(spark, sf_dir).where("op <> 'DELETE'"))):
        sink.process(b, i)
    return sink.read(spark).select("key", F.col("lsn_num").cast("long").alias("pos"))


@query(f"WITH {ORDER_LOG_SQL} SELECT id::VARCHAR AS doc_key, customer::VARCHAR AS customer, arg_max(status, pos) AS status FROM olog WHERE id % 17 <> 0 GROUP BY id, customer")
def mirrored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by key from batches that come out of order, one of them twice."""
    sink = Mirror(fresh(spark, "mirror"), apply.row_key(["id"]))
    for i, b in [*enumerate(_batches(order_log(spark, sf_dir)))][::-1]:
        sink.process(b, i)
    sink.process(_batches(order_log(spark, sf_dir))[1], 1)
    return sink.read(spark).select("doc_key", F.col("document")["customer"].alias("customer"), F.col("document")["status"].alias("status"))


@query("SELECT o_orderkey AS id, 1::BIGINT AS deliveries FROM orders WHERE o_orderkey % 2 = 0")
def bus_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bus whose messages were published twice under different batches; its consumer drops redeliveries."""
    path, out = fresh(spark, "bus"), fresh(spark, "consumed")
    sink = MessageBus(path, F.col("table"))
    rows = order_log(spark, sf_dir).where("op = 'INSERT' AND xid % 2 = 0")
    for batch in (0, 1):
        sink.process(rows, batch)
    q = sink.consume(spark).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(F.expr("conv(split_part(event_id, '/', 2), 16, 10) div 4").cast("long").alias("id")).agg(F.count("*").alias("deliveries"))


# -- fan-out, retries, dead letters [T1, T3, T5-T11, K8, K11, K12, A7] ----------------------------------------------


class _Fragile:
    """A sink that refuses some events, the first `times` times that it is asked."""

    def __init__(self, name: str, bad, times: int):
        self.name, self.bad, self.times, self.got = name, bad, times, 0

    def initialize(self) -> None:
        self.got = 0

    def healthy(self) -> bool:
        return self.times == 0

    def shutdown(self) -> None:
        self.times = 0

    def process(self, events: DataFrame, batch: int) -> None:
        if self.times:
            self.times -= 1
            failed = events.where(self.bad).select("event_id", F.lit("refused: timeout").alias("error")).persist()
            if failed.count():
                self.got += events.count() - failed.count()
                raise EventsFailed(failed)
        self.got += events.count()


def _fanned(spark: SparkSession, sf_dir: str, times: int, **conf) -> tuple[Pipeline, Registry, list]:
    registry = Registry()
    sinks = [_Fragile("stream", F.col("xid") % 5 == 0, times), _Fragile("bus", F.lit(False), 0)]
    for s in sinks:
        registry.register(s)
    registry.initialize()
    tables = LetterTables(spark, fresh(spark, "letters"), conf.get("dlq_threshold", 3), most=None, clock=lambda: F.timestamp_seconds(F.lit(1_700_000_000)))
    routes = routing({"redis_stream": {"sync_all": True}, "nats": {"sync_all": True}})
    return Pipeline(routes, registry, Settings(max_retries=0, breaker_threshold=99, **conf), sleep=lambda _: None, tables=tables), registry, sinks


@query(f"WITH {ORDER_LOG_SQL} SELECT sink, CASE sink WHEN 'bus' THEN n * 3 ELSE n END AS events, CASE sink WHEN 'bus' THEN 0 ELSE 2 END::BIGINT AS failed_batches, true AS healthy FROM (SELECT count(*) AS n FROM olog WHERE op = 'INSERT'), (VALUES ('bus'), ('stream')) v(sink)")
def fanout_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sink is attempted on every batch; the batch fails while one of them does and is delivered again to all."""
    p, registry, sinks = _fanned(spark, sf_dir, 2, dlq_enabled=False)
    sinks[0].bad = F.lit(True)
    events, failed = order_log(spark, sf_dir).where("op = 'INSERT'"), 0
    for _ in range(3):
        try:
            p(events, 0)
        except DeliveryFailed:
            failed += 1
    health = registry.health()
    rows = [(s.name, s.got, p.counters["events_processed_total", s.name, "error"], health[s.name]) for s in sinks]
    assert failed == 2
    return spark.createDataFrame(rows, "sink string, events long, failed_batches long, healthy boolean")


@query(f"WITH {ORDER_LOG_SQL} SELECT 'stream:0/' || upper(to_hex(pos)) AS id, 3 AS attempts, 'refused: timeout' AS error, customer::VARCHAR AS customer FROM olog WHERE op = 'INSERT' AND id % 5 = 0")
def letters_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a sink refuses three times are parked, each by itself; the others are delivered and the stream goes on."""
    p, _, _ = _fanned(spark, sf_dir, 3)
    events = order_log(spark, sf_dir).where("op = 'INSERT'")
    for _ in range(2):
        try:
            p(events, 0)
        except DeliveryFailed:
            continue
        raise AssertionError("below the threshold a failure stalls the stream")
    p(events, 0)
    return p.tables.list(0).select("id", "attempts", "error", F.element_at("event.new_data", F.lit("customer")).alias("customer"))


@query("SELECT count(*) AS parked, count(*) AS retried, count(*) FILTER (o_orderkey % 10 <> 0) AS succeeded, count(*) FILTER (o_orderkey % 10 = 0) AS failed, count(*) FILTER (o_orderkey % 10 = 0) - 1 AS kept, 4 AS attempts FROM orders WHERE o_orderkey % 5 = 0")
def letters_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over all entries: what is refused again stays with another attempt, the rest goes; one more is discarded."""
    p, _, sinks = _fanned(spark, sf_dir, 1, dlq_threshold=1)
    p(order_log(spark, sf_dir).where("op = 'INSERT'"), 0)
    parked = p.tables.depth()
    sinks[0].times, sinks[0].bad = 1, F.col("xid") % 10 == 0
    p.tables.entries.write(p.tables.entries.read().withColumn("attempts", F.lit(3)))
    done = p.tables.retry(None, lambda sink, rows: p.deliver(sink, rows, -1))
    p.tables.discard(p.tables.list(1).first().id)
    left = p.tables.entries.read().agg(F.count("*").alias("kept"), F.max("attempts").alias("attempts"))
    return left.select(F.lit(parked).cast("long").alias("parked"), *(F.lit(done[k]).cast("long").alias(k) for k in ("retried", "succeeded", "failed")), "kept", "attempts")


@query(f"WITH {_DELIVERIES_SQL} SELECT count(*) FILTER (status = 'error') AS parked, sum(retries)::BIGINT AS retried FROM d")
def letter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parked and retried, over all labels."""
    d = deliveries(spark, sf_dir)
    parked = d.where("status = 'error'").groupBy("sink").agg(F.count("*").alias("value")).select(F.lit("dlq_parked_total").alias("name"), F.create_map(F.lit("sink"), "sink").alias("labels"), "value")
    retried = d.groupBy("sink", "status").agg(F.sum("retries").alias("value")).select(F.lit("dlq_retried_total").alias("name"), F.create_map(F.lit("sink"), "sink", F.lit("status"), "status").alias("labels"), "value")
    return stats.letter_totals(parked.unionByName(retried))


@query("SELECT n_nationkey AS retries, round(list_sum([least(10.0::DOUBLE, 0.1::DOUBLE * (2 ** i)) FOR i IN range(n_nationkey)]), 6) AS pauses FROM nation WHERE n_nationkey > 0")
def retry_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling pauses up to a cap."""
    total = F.pandas_udf(lambda n: n.map(lambda i: float(sum(backoffs(i, 0.1, 10.0)))), "double")
    return read(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("retries"), F.round(total("n_nationkey"), 6).alias("pauses"))


@query("SELECT t AS text, CASE t WHEN '7' THEN 7 WHEN '250' THEN 250 ELSE 100 END AS shown FROM (VALUES (''), ('x'), ('0'), ('-3'), ('7'), ('250'), ('1.5')) v(t)")
def list_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's limit as a request gives it."""
    texts = ("", "x", "0", "-3", "7", "250", "1.5")
    return spark.createDataFrame([(t, attempts.list_limit(t)) for t in texts], "text string, shown int")


# -- backfill runs [T12-T14, T17-T23, A10, K9] ------------------------------------------------------------------


def _backfilled(spark: SparkSession, sf_dir: str) -> tuple[Coordinator, str]:
    """Nation and region are copied, lineitem has no key, customer is excluded; a restart of the stream repeats a chunk."""
    at, out, restarted = [0], fresh(spark, "backfill"), [False]
    names = {"nation": ["n_nationkey"], "region": ["r_regionkey"], "lineitem": [], "customer": ["c_custkey"]}
    live = order_log(spark, sf_dir).where("false")

    def mark() -> int:
        at[0] += 10
        return at[0]

    def deliver(rows: DataFrame, batch: int) -> None:
        if not restarted[0]:
            restarted[0] = True
            c.stream_restarted()
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    source = Source(lambda s, t: read(spark, sf_dir, t), lambda s, t: names[t], lambda: live, mark, lambda: [("public", t) for t in names])
    c = Coordinator(source, deliver, Progress(), 10, excluded=["public.customer"], sleep=lambda _: None, mode="auto")
    c.start(first_run=True)
    c.run()
    return c, out


@query("SELECT * FROM (SELECT 'lineitem' AS tbl, 'skipped' AS state, 0::BIGINT AS rows_copied, 'no primary key' AS error UNION ALL SELECT 'nation', 'done', count(*), '' FROM nation UNION ALL SELECT 'region', 'done', count(*), '' FROM region)")
def backfill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each table after a run in mode auto."""
    c, _ = _backfilled(spark, sf_dir)
    return spark.createDataFrame([(s.table, s.state, s.rows_copied, s.error) for s in c.status()], "tbl string, state string, rows_copied long, error string")


@query("SELECT 'bf:public.nation:' || n_nationkey::VARCHAR AS event_id, n_name AS name FROM nation UNION ALL SELECT 'bf:public.region:' || r_regionkey::VARCHAR, r_name FROM region")
def backfill_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was delivered: a READ event for each row, once under its id, though a chunk was done twice."""
    _, out = _backfilled(spark, sf_dir)
    rows = spark.read.parquet(out).where("op = 'READ'")
    name = F.coalesce(F.element_at("new_data", F.lit("n_name")), F.element_at("new_data", F.lit("r_name")))
    return rows.select("event_id", name.alias("name")).distinct()


# -- schema changes to observers [C10, C13, C14, K10, W10, W12] ----------------------------------------------------


@query("SELECT relation_id, CASE WHEN lsn = 0 THEN 77 ELSE lsn END AS lsn FROM (VALUES (1, 0), (2, 35)) v(relation_id, lsn)")
def schema_final_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description without a position takes that of its transaction's end."""
    column = lambda n: F.struct(F.lit(n).alias("name"), F.lit(23).cast("long").alias("type_oid"), F.lit("int4").alias("type"), F.lit(False).alias("key"))
    rows = spark.createDataFrame([(1, -1, 1), (1, 0, 2), (2, 30, 1), (2, 35, 2)], "relation_id long, at int, n int")
    rows = rows.select("relation_id", F.col("at").cast("decimal(20,0)").alias("lsn_num"), F.lit("public").alias("schema"), F.lit("t").alias("table"), F.lit("d").alias("identity"), F.slice(F.array(column("a"), column("b")), F.lit(1), F.col("n")).alias("columns"))
    return schema_diff.changes(rows, F.lit(77).cast("decimal(20,0)")).select("relation_id", F.col("lsn_num").cast("int").alias("lsn"))


def _observed(spark: SparkSession, sf_dir: str) -> tuple[FanOut, Recorder, str]:
    path, recorder = fresh(spark, "schema"), Recorder(2)

    class Broken:
        name = "broken"

        def __call__(self, changes: DataFrame, batch: int) -> None:
            raise RuntimeError("no route")

    fan = FanOut([Broken(), recorder, Publisher(path, "app")], log=lambda _: None)
    found = schema_diff.changes(relations(spark))
    for batch in (0, 0):  # a replayed batch
        fan(found, batch)
    return fan, recorder, path


@query(_DIFF_SQL + "SELECT 'app:schema' AS stream, s || '.' || t AS \"table\", pos::VARCHAR AS lsn, (len(list_filter(kinds, lambda z: z <> 'column_added')) > 0)::VARCHAR AS breaking, array_to_string(parts, '; ') AS summary FROM y JOIN h USING (relation_id, pos) WHERE len(kinds) > 0")
def schema_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications on <prefix>:schema, once each, though an observer before the publisher fails."""
    _, _, path = _observed(spark, sf_dir)
    return spark.read.parquet(path).select("stream", "table", "lsn", "breaking", F.get_json_object("payload", "$.summary").alias("summary"))


@query(_DIFF_SQL + "SELECT 'broken' AS observer, 2::BIGINT AS errors, 2::BIGINT AS kept, 2 * count(*) AS total FROM y WHERE len(kinds) > 0")
def schema_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by observer; the recorder keeps the newest and counts all."""
    fan, recorder, _ = _observed(spark, sf_dir)
    return spark.createDataFrame([(n, e, len(recorder.changes), recorder.total) for n, e in fan.errors.items()], "observer string, errors long, kept long, total long")


# -- listings and formats [W5, W7, W13, W14, P21] --------------------------------------------------------------------


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 50")
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing by any of its columns, ties by the others."""
    rows = stats.sorted_listing(read(spark, sf_dir, "customer").select("c_acctbal", "c_custkey", "c_name"), "c_acctbal", descending=True).limit(50)
    from pyspark.sql import Window

    return rows.select(F.col("c_name").alias("name"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@query(f"WITH {_DELIVERIES_SQL} SELECT bool_and(ok) AS ready FROM (SELECT sink, count(*) FILTER (status = 'error') * 2 < count(*) AS ok FROM d GROUP BY sink)")
def ready_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready while the stream runs and every sink is healthy: here, while fewer than half of its deliveries fail."""
    per = stats.sink_outcomes(deliveries(spark, sf_dir)).select("sink", (F.col("failed") * 2 < F.col("failed") + F.col("processed")).alias("healthy"))
    return stats.ready(per, True)


@query(
    """SELECT k, CASE WHEN n >= 86400 THEN (n // 86400)::VARCHAR || 'd ' || ((n % 86400) // 3600)::VARCHAR || 'h' WHEN n >= 3600 THEN (n // 3600)::VARCHAR || 'h ' || ((n % 3600) // 60)::VARCHAR || 'm' WHEN n >= 60 THEN (n // 60)::VARCHAR || 'm ' || (n % 60)::VARCHAR || 's' ELSE n::VARCHAR || 's' END AS duration,
    CASE WHEN n >= 86400 THEN (n // 86400)::VARCHAR || 'd ago' WHEN n >= 3600 THEN (n // 3600)::VARCHAR || 'h ago' WHEN n >= 60 THEN (n // 60)::VARCHAR || 'm ago' ELSE n::VARCHAR || 's ago' END AS ago FROM (SELECT o_orderkey AS k, o_orderkey * 7 AS n FROM orders)"""
)
def compact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 7
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), stats.compact_duration(n).alias("duration"), stats.time_ago(F.lit(1_000_000_000) - n, F.lit(1_000_000_000)).alias("ago"))
