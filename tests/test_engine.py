"""Operators and delivery on small logs, worked out by hand."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions.keys import template
from tidelog.model import EVENT
from tidelog.operators import apply, attempts, backfill, dedupe, outbox, route, schema_diff, stats
from tidelog.operators.transform import transform
from tidelog.plans.snapshot import relations
from tidelog.service import Service
from tidelog.sources.config import Outbox, Routing, Settings, Sink, Table, Transform
from tidelog.streaming import delivery
from tidelog.streaming.coordinator import Coordinator, Source, split_name
from tidelog.streaming.sinks import AppendLog, Messages, Mirror, Progress, Webhook

T0 = datetime(2024, 1, 1)


def log(spark, *changes):
    """(position, op, new, old, omitted) rows of public.users, or with a table name after them."""
    rows = []
    for pos, op, new, old, omitted, *table in changes:
        rows.append((f"0/{pos:X}", op, "public", table[0] if table else "users", old, new, omitted, f"0/{pos:X}", Decimal(pos), 0, pos, T0 + timedelta(seconds=pos)))
    return spark.createDataFrame(rows, EVENT)


def mirrored(events, flavour=apply.FULL_SET):
    return {r.doc_key: r.document for r in apply.documents(events, apply.row_key(["id"]), flavour).collect()}


def test_documents_full_set_and_merge(spark):
    e = log(
        spark,
        (1, "INSERT", {"id": "1", "a": "x", "b": None}, None, []),
        (2, "UPDATE", {"id": "1", "a": None}, None, ["b"]),  # merge: null removes a, b stays as it was
        (3, "READ", {"id": "2", "a": "r"}, None, []),
        (4, "UPDATE", {"id": "2", "b": "new"}, None, []),  # full set: a is gone
        (5, "INSERT", {"id": "3", "a": "y"}, None, []),
        (6, "DELETE", None, {"id": "3"}, []),
        (7, "DELETE", None, {"id": "9"}, []),
        (8, "UPDATE", {"id": "4", "a": "m"}, None, ["b"]),  # merge into nothing
        (9, "TRUNCATE", None, None, []),
        (10, "UPDATE", None, None, []),
        (11, "UPDATE", {"a": "no key"}, None, []),
    )
    want = {"1": {"id": "1", "b": None}, "2": {"id": "2", "b": "new"}, "4": {"id": "4", "a": "m"}}
    assert mirrored(e) == want
    assert mirrored(e.unionAll(e)) == want  # redelivered
    assert mirrored(e.where("false")) == {}


def test_index_flavour_is_partial_and_truncated(spark):
    e = log(spark, (1, "INSERT", {"id": "1", "a": "x"}, None, []), (2, "TRUNCATE", None, None, []), (3, "INSERT", {"id": "2", "a": "x", "b": "y"}, None, []), (4, "UPDATE", {"id": "2", "a": "z"}, None, []))
    assert mirrored(e, apply.PARTIAL) == {"2": {"id": "2", "a": "z", "b": "y"}}


def test_merge_apply_matches_a_replay(spark):
    import random

    rng, rows, state = random.Random(1), [], {}
    for pos in range(600):
        key, op = rng.randrange(12), rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE", "READ"])
        omit = op == "UPDATE" and rng.random() < 0.5
        a, b = (None if op == "DELETE" else str(pos)), (None if op == "DELETE" or omit or rng.random() < 0.2 else f"b{pos}")
        rows.append((pos, op, key, a, b, omit))
        if op == "DELETE":
            state.pop(key, None)
        elif omit:
            state[key] = (a, state.get(key, (None, None))[1])
        else:
            state[key] = (a, b)
    df = spark.createDataFrame(rows, "pos long, op string, k int, a string, b string, omitted boolean")
    got = apply.merge_apply(df, ["k"], ["a", "b"], {"b": ~F.col("omitted")}, F.col("omitted"))
    assert {r.k: (r.a, r.b) for r in got.collect()} == state


def test_moved_keys(spark):
    e = log(spark, (1, "INSERT", {"id": "1", "v": "a"}, None, []), (2, "UPDATE", {"id": "2", "v": "b"}, {"id": "1"}, []), (3, "UPDATE", {"id": "2", "v": "c"}, None, []))
    assert set(mirrored(e)) == {"1", "2"}  # an orphan stays unless keys are moved
    assert mirrored(apply.move_keys(e, ["id"])) == {"2": {"id": "2", "v": "c"}}


def test_dedupe(spark):
    e = log(spark, (1, "INSERT", {"id": "1"}, None, []), (2, "DELETE", None, {"id": "1"}, []))
    assert sorted(r.event_id for r in dedupe.once(e.unionAll(e).unionAll(e)).collect()) == ["0/1", "0/2"]


def test_dedupe_stream(spark, tmp_path):
    e = log(spark, *((i, "INSERT", {"id": str(i)}, None, []) for i in range(20)))
    e.unionAll(e).write.parquet(str(tmp_path / "in"))
    q = dedupe.once_in_window(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("deduped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduped").count() == 20


def test_routing(spark):
    e = log(spark, (1, "INSERT", {"id": "1"}, None, [], "users"), (2, "INSERT", {"id": "1"}, None, [], "outbox"), (3, "DELETE", None, {"id": "1"}, [], "outbox"), (4, "INSERT", {"id": "1"}, None, [], "state"))
    routes = Routing({"stream": Sink("stream", True), "index": Sink("index", tables={"users": Table("people"), "state": Table("")}, keyed=False)}, Outbox("public", "outbox"))
    got = sorted((r.sink, r.table) for r in route.route(route.exclude(e, ["public.nothing"], "state"), routes).collect())
    assert got == [("index", "users"), ("outbox", "outbox"), ("stream", "users")]
    assert [r.table for r in route.exclude(e, ["public.users", "outbox"]).collect()] == ["state"]


def test_transform_order_and_scope(spark):
    e = log(spark, (1, "INSERT", {"id": "1", "status": "live", "email": "a@b", "ssn": "123456789"}, None, []), (2, "UPDATE", {"id": "2", "status": "draft"}, {"id": "2", "email": "old"}, []), (3, "INSERT", {"id": "3", "status": "draft", "email": "x"}, None, [], "other"))
    sink = Sink("s", True, "", Transform("", ("status",)), {"public.users": Table("", Transform('"email" in new', (), (("email", "redact"), ("ssn", "last4")))), "users": Table("", Transform("false"))})
    got = {r.event_id: (r.old_data, r.new_data) for r in transform(e, sink).collect()}
    assert got == {"0/1": (None, {"id": "1", "email": "[REDACTED]", "ssn": "*****6789"}), "0/3": (None, {"id": "3", "email": "x"})}
    plain = Sink("p", True)
    assert transform(e, plain) is e


def test_outbox(spark):
    rows = log(
        spark,
        (1, "INSERT", {"id": "m1", "topic": "orders", "event_type": "made", "aggregate_id": "7", "payload": '{"a":1}'}, None, [], "outbox"),
        (2, "INSERT", {"topic": None, "event_type": "", "payload": "x"}, None, [], "outbox"),
        (3, "READ", {"id": "m3", "topic": "t", "payload": "x"}, None, [], "outbox"),
        (4, "INSERT", {"id": "m4", "topic": "t", "payload": None}, None, [], "outbox"),
    )
    box = Outbox("public", "outbox", default_topic="misc")
    got = [tuple(r) for r in outbox.messages(rows, box, fail=False).orderBy("event_id").collect()]
    assert got == [("events:orders", "m1", '{"a":1}', "made", "7", "0/1", None), ("events:misc", "0/2", "x", None, None, "0/2", None), ("events:t", "m4", None, None, None, "0/4", "no payload")]
    with pytest.raises(Exception, match="no payload"):
        outbox.messages(rows, box).collect()
    with pytest.raises(Exception, match="no topic"):
        outbox.messages(rows.where("lsn_num = 2"), Outbox("public", "outbox")).collect()


# -- backfill --------------------------------------------------------------------------------------


def test_supersede_sees_old_keys_and_truncates(spark):
    chunk = spark.createDataFrame([(str(i),) for i in range(1, 6)], "key string")
    events = log(spark, (10, "UPDATE", {"id": "1"}, None, []), (11, "UPDATE", {"id": "9"}, {"id": "2"}, []), (12, "DELETE", None, {"id": "3"}, []), (13, "UPDATE", {"id": "4"}, None, [], "other"), (20, "UPDATE", {"id": "5"}, None, []))
    seen = backfill.seen_keys(events, "public", "users", ["id"], F.lit(5), F.lit(20))
    assert sorted(r.key for r in backfill.supersede(chunk, seen).collect()) == ["4", "5"]
    assert tuple(backfill.superseded_count(chunk, seen).first()) == (5, 3, 2)
    cut = backfill.seen_keys(events.unionAll(log(spark, (15, "TRUNCATE", None, None, []))), "public", "users", ["id"], F.lit(5), F.lit(20))
    assert backfill.supersede(chunk, cut).collect() == []


def test_coordinator(spark, tmp_path):
    users = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id long, name string")
    live = log(spark, (15, "UPDATE", {"id": "2", "name": "live"}, None, []))
    at, got, fail = [0], [], [True]

    def mark():
        at[0] += 10
        return at[0]

    def deliver(rows, batch):
        if fail and len(got) == 1:
            fail.pop()
            raise RuntimeError("sink is down")
        got.append([(r.event_id, r.new_data["name"], r.op, int(r.lsn_num)) for r in rows.orderBy(F.col("new_data")["id"]).collect()])

    progress = Progress(str(tmp_path / "state.json"))
    source = Source(lambda s, t: users, lambda s, t: [] if t == "log" else ["id"], lambda: live, mark, lambda: [("public", "users"), ("public", "log"), ("public", "hidden"), ("public", "cdc_state")])
    c = Coordinator(source, deliver, progress, 3, excluded=["hidden"], state_table="cdc_state", sleep=lambda _: None)
    assert c.enqueue_pending() == ["public.log", "public.users"]
    with pytest.raises(RuntimeError):
        c.enqueue("users")
    with pytest.raises(ValueError):
        c.enqueue("public.hidden")
    c.run()
    assert [(s.table, s.state, s.rows_copied) for s in c.status()] == [("log", "skipped", 0), ("users", "done", 6)]
    assert [[x[0] for x in g] for g in got] == [["bf:public.users:1", "bf:public.users:3"], ["bf:public.users:4", "bf:public.users:5", "bf:public.users:6"], ["bf:public.users:7"]]
    assert got[0][0][1:] == ("n1", "READ", 20)
    saved = progress.load()["public.users"]
    assert saved["done"] and saved["cursor"] == [7]
    again = Coordinator(source, deliver, progress, 3)
    again.resume()
    assert [s.state for s in again.status()] == ["done"] and not again.queue
    assert split_name("t") == ("public", "t") and split_name("a.t") == ("a", "t")
    for bad in ("", "a.", "a.b.c"):
        with pytest.raises(ValueError):
            split_name(bad)


# -- schema changes --------------------------------------------------------------------------------


def test_schema_changes(spark):
    got = {(r.relation_id, int(r.lsn_num)): (r.kinds, r.summary, r.breaking) for r in schema_diff.changes(relations(spark)).collect()}
    assert got == {
        (1, 30): (["column_added"], "added email", False),
        (1, 40): (["column_added", "column_dropped", "column_type_changed"], "added nickname; dropped name; id int4->int8", True),
        (1, 50): (["table_renamed", "replica_identity_changed"], "renamed from public.users; replica identity d->f", True),
        (2, 35): (["column_added", "key_changed"], "added code; key [id]->[code id]", True),
        (2, 45): (["column_dropped", "replica_identity_changed"], "dropped code; replica identity d->n", True),
    }


# -- attempts --------------------------------------------------------------------------------------


def tries(spark, *rows):
    return spark.createDataFrame([(s, e, n, o, f"{o}{n}" if o == "error" else None, T0 + timedelta(seconds=t)) for s, e, n, o, t in rows], "sink string, event_id string, attempt int, outcome string, error string, ts timestamp")


def test_dead_letters(spark):
    a = tries(
        spark, ("s", "a", 1, "error", 1), ("s", "a", 2, "error", 2), ("s", "a", 3, "error", 3), ("s", "b", 1, "error", 4), ("s", "b", 2, "ok", 5), ("s", "b", 3, "error", 6), ("s", "b", 4, "error", 7),
        ("s", "c", 1, "error", 1), ("s", "c", 2, "circuit_open", 2), ("s", "c", 3, "error", 3), ("t", "a", 1, "circuit_open", 1), ("t", "a", 2, "circuit_open", 2), ("t", "a", 3, "circuit_open", 3),
    )
    (p,) = attempts.parked(a).collect()
    assert (p.id, p.attempts, p.error, p.first_failed_at.second, p.last_failed_at.second) == ("s:a", 3, "error3", 1, 3)
    streak = {(r.event_id, r.island): r.failures for r in attempts.streaks(a).collect()}
    assert streak == {("a", 0): 3, ("b", 0): 1, ("b", 1): 2, ("c", 0): 2}
    assert attempts.parked(a, 1, most=1).where("NOT stalled").count() == 1
    store = attempts.upsert(attempts.parked(a), attempts.parked(a).withColumn("error", F.lit("later")))
    assert [(r.id, r.error) for r in store.collect()] == [("s:a", "later")]
    assert [attempts.list_limit(t) for t in (None, "", "x", "0", "-3", "7")] == [100, 100, 100, 100, 100, 7]


def test_breaker_replay(spark):
    calls = [("s", str(i), i, "error" if i < 5 or i == 41 else "ok", t) for i, t in [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 10), (41, 35), (6, 40), (7, 66), (8, 67)]]
    got = [(r.event_id, r.outcome, r.state) for r in attempts.breaker(tries(spark, *calls), 5, 30).orderBy("ts").collect()]
    assert got[3:] == [("3", "error", "closed"), ("4", "error", "open"), ("5", "circuit_open", "open"), ("41", "error", "open"), ("6", "circuit_open", "open"), ("7", "ok", "closed"), ("8", "ok", "closed")]


def test_error_classes(spark):
    rows = spark.createDataFrame([("circuit breaker is open",), ("context deadline exceeded",), ("read: timeout",), ("context canceled",), ("boom",)], "e string")
    assert [r[0] for r in rows.select(attempts.error_class(F.col("e"))).collect()] == ["circuit_open", "timeout", "timeout", "canceled", "other"]


# -- statistics ------------------------------------------------------------------------------------


def test_rates_never_fall_below_zero(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 30), ("a", 10, 20), ("b", 3, 1)], "k string, t long, events_total long")
    got = [(r.k, r.t, r.rate) for r in stats.throughput(rows, ["k"]).orderBy("k", "t").collect()]
    assert got == [("a", 0, None), ("a", 5, 4.0), ("a", 10, 0.0), ("b", 3, None)]


def test_formats(spark):
    rows = spark.createDataFrame([(999,), (1234,), (2_500_000,)], "n long")
    assert [r[0] for r in rows.select(stats.compact_number(F.col("n"))).collect()] == ["999", "1.2k", "2.5M"]
    assert [r[0] for r in rows.select(stats.compact_bytes(F.col("n"))).collect()] == ["999 B", "1.2 KiB", "2.4 MiB"]


# -- delivery --------------------------------------------------------------------------------------


class Flaky:
    def __init__(self, name, fail=0):
        self.name, self.fail, self.got, self.calls = name, fail, [], 0

    def initialize(self):
        self.started = True

    def healthy(self):
        return self.fail == 0

    def shutdown(self):
        if self.fail:
            raise RuntimeError(self.name)

    def process(self, events, batch):
        self.calls += 1
        if self.fail:
            self.fail -= 1
            raise RuntimeError(f"{self.name} is down")
        self.got.append((batch, sorted(r.event_id for r in events.collect())))


def pipeline(*sinks, **conf):
    registry = delivery.Registry()
    for s in sinks:
        registry.register(s)
    routes = Routing({s.name: Sink(s.name, True) for s in sinks})
    return delivery.Pipeline(routes, registry, Settings(**({"max_retries": 0} | conf)), sleep=lambda _: None)


@pytest.mark.parametrize("parallel", [False, True])
def test_every_sink_is_attempted_and_failure_fails_the_batch(spark, parallel):
    e, good, bad = log(spark, (1, "INSERT", {"id": "1"}, None, [])), Flaky("good"), Flaky("bad", 1)
    p = pipeline(bad, good, parallel_sinks=parallel)
    with pytest.raises(delivery.DeliveryFailed, match="bad is down"):
        p(e, 0)
    assert good.got == [(0, ["0/1"])]
    p(e, 0)  # replayed: delivered again, at least once
    assert bad.got == [(0, ["0/1"])] and len(good.got) == 2


def test_retries_back_off(spark):
    pauses = []
    calls = iter([RuntimeError(), RuntimeError(), None])

    def call():
        e = next(calls)
        if e:
            raise e

    assert delivery.with_retry(call, delivery.backoffs(3, 0.1, 0.15), pauses.append) == 2
    assert pauses == [0.1, 0.15] and delivery.backoffs(5, 0.1, 1.0) == [0.1, 0.2, 0.4, 0.8, 1.0]


def test_breaker_opens_and_recovers():
    now = [0.0]
    b = delivery.Breaker(2, 30, lambda: now[0])

    def fail():
        raise RuntimeError("x")

    for _ in range(2):
        with pytest.raises(RuntimeError, match="x"):
            b.call(fail)
    assert b.gauge == 2
    with pytest.raises(delivery.CircuitOpen):
        b.call(lambda: None)
    now[0] = 31
    with pytest.raises(RuntimeError, match="x"):
        b.call(fail)
    assert b.gauge == 2
    now[0] = 62
    b.call(lambda: None)
    assert b.gauge == 0


def test_parking_at_the_threshold(spark):
    e, bad = log(spark, (1, "INSERT", {"id": "1"}, None, [])), Flaky("bad", 4)
    p = pipeline(bad, dlq_threshold=3, breaker_threshold=9)
    for _ in range(2):
        with pytest.raises(delivery.DeliveryFailed):
            p(e, 7)
    p(e, 7)  # parked, the stream goes on
    s = Service(spark, p, streaming=True)
    assert [x["id"] for x in s.dead_letters()["entries"]] == ["bad:7"] and s.readiness() == 503
    assert s.retry("bad:7")[0] == 409 and p.letters.entries["bad:7"].attempts == 4
    assert s.retry("bad:7") == (200, {"retried": 1, "succeeded": 1, "failed": 0}) and s.retry("bad:7")[0] == 404
    assert s.discard("bad:7") == 404 and s.readiness() == 200


def test_full_queue_stalls(spark):
    e, bad = log(spark, (1, "INSERT", {"id": "1"}, None, [])), Flaky("bad", 9)
    p = pipeline(bad, dlq_threshold=1, dlq_max_entries=1, breaker_threshold=99)
    p(e, 1)
    with pytest.raises(delivery.DeliveryFailed, match="full"):
        p(e, 2)
    bad.fail = 0
    assert Service(spark, p).retry(everything=True)[1] == {"retried": 1, "succeeded": 1, "failed": 0}


def test_open_circuits_never_park(spark):
    e, bad = log(spark, (1, "INSERT", {"id": "1"}, None, [])), Flaky("bad", 99)
    p = pipeline(bad, dlq_threshold=3, breaker_threshold=1)
    for _ in range(5):
        with pytest.raises(delivery.DeliveryFailed):
            p(e, 1)
    assert bad.calls == 1 and not p.letters.entries


def test_shutdown_and_registry(spark):
    with pytest.raises(ValueError, match="no sink"):
        delivery.Pipeline(Routing({}), delivery.Registry())
    a, b = Flaky("a"), Flaky("b", 1)
    p = pipeline(a, b)
    p.stopping = True
    with pytest.raises(delivery.ShuttingDown):
        p(log(spark, (1, "INSERT", {"id": "1"}, None, [])), 0)
    r = p.registry
    with pytest.raises(ValueError):
        r.register(Flaky("a"))
    r.initialize()
    assert r.get("a") is a and r.health() == {"a": True, "b": False}
    with pytest.raises(ExceptionGroup):
        r.shutdown()
    r.unregister("a")
    with pytest.raises(KeyError):
        r.get("a")


def test_streaming_fan_out(spark, tmp_path):
    e = log(spark, (1, "INSERT", {"id": "1", "v": "a"}, None, []), (2, "UPDATE", {"id": "1", "v": "b"}, None, []), (3, "INSERT", {"id": "m", "topic": "t", "payload": "p"}, None, [], "outbox"))
    e.write.parquet(str(tmp_path / "in"))
    registry = delivery.Registry()
    key = template("{{.Prefix}}:{{.Table}}", "app")
    stream, mirror = AppendLog(str(tmp_path / "stream"), key), Mirror(str(tmp_path / "doc"), apply.row_key(["id"]))
    for s in (stream, mirror, Messages(str(tmp_path / "outbox"))):
        registry.register(s)
    box = Outbox("public", "outbox")
    p = delivery.Pipeline(Routing({"stream": Sink("stream", True), "document": Sink("document", True)}, box), registry, prepare={"outbox": lambda rows: outbox.messages(rows, box)})
    q = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")).writeStream.foreachBatch(p).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    p(e, 0)  # a replayed batch changes nothing
    assert stream.read(spark).count() == 2 and stream.read(spark, most=1).first().event_id == "0/2"
    assert {r.doc_key: r.document for r in mirror.read(spark).collect()} == {"1": {"id": "1", "v": "b"}}
    assert [r.id for r in spark.read.parquet(str(tmp_path / "outbox")).collect()] == ["m"]
    snap = Service(spark, p).snapshot(e)
    assert snap["total"] == 3 and snap["tables"][0]["table_name"] == "public.users" and snap["sinks"]["stream"]["processed"] == 2
    assert 'cdc_events_received_total{schema="public",table="users",operation="INSERT"} 1' in Service(spark, p).metrics(e)


def test_webhook(spark):
    import http.server
    import threading

    seen, answers = [], [200, 500]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((dict(self.headers), self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(answers[min(len(seen), 2) - 1])
            self.end_headers()
            self.wfile.write(b"no" * 400)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    hook = Webhook(f"http://127.0.0.1:{server.server_port}/", b"secret", "Bearer t")
    e = log(spark, (1, "INSERT", {"id": "1"}, None, []))
    hook.process(e, 0)
    headers, body = seen[0]
    assert headers["Authorization"] == "Bearer t"
    assert {k.lower() for k in headers} >= {"x-cdc-event-id", "x-cdc-signature", "x-cdc-timestamp"} and b'"new_data":{"id":"1"}' in body
    with pytest.raises(Exception, match="answered 500"):
        hook.process(e, 1)
    server.shutdown()


# -- supervision, deadlines, observers -----------------------------------------------------------------


def test_streams_are_restarted_with_doubling_pauses():
    from tidelog.streaming.supervisor import Supervisor

    now, starts, told, pauses = [0.0], [], [], []

    class Query:
        def __init__(self, lasts, fails):
            self.lasts, self.fails = lasts, fails

        def awaitTermination(self):
            now[0] += self.lasts
            if self.fails:
                raise RuntimeError("gone")

    plan = [Query(1, True)] * 7 + [Query(100, True), Query(1, True), Query(1, False)]
    s = Supervisor(lambda: starts.append(1) or plan[len(starts) - 1], lambda: told.append(len(starts)), pauses.append, clock=lambda: now[0])
    s.run()
    assert pauses == [1, 2, 4, 8, 16, 30, 30, 1, 2] and len(starts) == 10 and told == list(range(1, 10))
    with pytest.raises(RuntimeError, match="failed 2 times"):
        Supervisor(lambda: Query(0, True), sleep=lambda _: None).run(2)


def test_deadlines(spark):
    import time

    from tidelog.streaming.delivery import within

    e = log(spark, (1, "INSERT", {"id": "1"}, None, []))
    with pytest.raises(TimeoutError, match="deadline exceeded"):
        within(e, 0.2, lambda: time.sleep(0.5))
    within(e, 5.0, lambda: None)


def test_letters_stall_when_full_and_forget_on_success(spark, tmp_path):
    from tidelog.streaming.letters import LetterTables

    e = log(spark, *((i, "INSERT", {"id": str(i)}, None, []) for i in range(1, 5)))
    t = LetterTables(spark, str(tmp_path / "l"), threshold=2, most=1)

    def fail(rows):
        raise RuntimeError("down")

    two = e.where("lsn_num <= 2")
    with pytest.raises(RuntimeError, match="down"):
        t.guard("s", two, fail)
    assert t.guard("s", two, lambda rows: None) and t.counts.read().count() == 0  # a success clears the count
    with pytest.raises(RuntimeError, match="down"):
        t.guard("s", two, fail)
    with pytest.raises(delivery.QueueFull):
        t.guard("s", two, fail)
    assert t.depth() == 0
    again = LetterTables(spark, str(tmp_path / "l"), threshold=2, most=5)  # a new driver goes on where the old one was
    assert not again.guard("s", two, fail) and again.depth() == 2
    got = []
    assert again.guard("s", e, lambda rows: got.extend(sorted(r.event_id for r in rows.collect()))) and got == ["0/3", "0/4"]
    with pytest.raises(KeyError):
        again.discard("s:0/9")
    with pytest.raises(KeyError):
        again.retry("s:0/9", lambda sink, rows: None)
    assert again.retry("s:0/1", lambda sink, rows: None) == {"retried": 1, "succeeded": 1, "failed": 0} and again.depth() == 1


def test_auto_backfill_runs_once(spark):
    users = spark.createDataFrame([(1, "a")], "id long, name string")
    source = Source(lambda s, t: users, lambda s, t: ["id"], lambda: log(spark), lambda: 0, lambda: [("public", "users")])
    assert Coordinator(source, lambda r, b: None, mode="auto").start(True) == ["public.users"]
    assert Coordinator(source, lambda r, b: None, mode="auto").start(False) == [] == Coordinator(source, lambda r, b: None, mode="off").start(True)
