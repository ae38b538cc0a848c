import pytest
import yaml

from tidelog.sources import config

FILE = """
redis_stream:
  sync_all: true
  default_key_pattern: "d"
  tables:
    public.orders: "k1"
    orders: "k2"
redis_json:
  transform: {drop_columns: [password_hash]}
  tables:
    users: {key: "u", filter: 'op == "INSERT"', mask: {email: sha256}}
meilisearch:
  tables:
    public.products: products
    public.empty: ""
    empty: bare
    users: {index: people, mask: {email: redact}}
outbox:
  table: outbox
  columns: {topic: subject}
"""


def test_routing():
    r = config.routing(yaml.safe_load(FILE))
    stream, document, index = r.sinks["stream"], r.sinks["document"], r.sinks["index"]
    assert stream.selects("a", "b") and stream.key_pattern("public", "orders", "x") == "k1" and stream.key_pattern("other", "orders", "x") == "k2" and stream.key_pattern("a", "b", "x") == "d"
    assert document.selects("public", "users") and not document.selects("public", "orders")
    assert document.transform.drop_columns == ("password_hash",) and document.entry("crm", "users").transform == config.Transform('op == "INSERT"', (), (("email", "sha256"),))
    assert index.selects("public", "products") and not index.selects("public", "empty") and index.selects("crm", "empty") and not index.selects("public", "x")
    assert not r.sinks["bus"].selects("public", "users")
    assert (r.outbox.schema, r.outbox.table, r.outbox.topic, r.outbox.id, r.outbox.stream_prefix) == ("public", "outbox", "subject", "id", "events")


def test_without_a_file_keyed_mirrors_take_everything():
    r = config.load_routing(None)
    assert r.sinks["stream"].selects("a", "b") and r.sinks["document"].selects("a", "b") and not r.sinks["index"].selects("a", "b") and r.outbox is None


def test_settings():
    s = config.settings({"CDC_PROCESS_TIMEOUT": "1m30s", "CDC_PARALLEL_SINKS": "true", "CDC_EXCLUDED_TABLES": " a, public.b ,,", "CDC_BACKFILL_STATE_TABLE": "none", "CDC_DLQ_THRESHOLD": "x", "CDC_RETRY_BACKOFF_INITIAL": "250ms"})
    assert s.process_timeout == 90 and s.parallel_sinks and s.excluded_tables == {"a", "public.b"} and s.backfill_state_table == "" and s.dlq_threshold == 3 and s.backoff_initial == 0.25
    for bad in ({"HTTP_PORT": "0"}, {"CDC_BACKFILL_MODE": "never"}, {"CDC_BACKFILL_CHUNK_SIZE": "-1"}):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_replication_parameter_is_removed():
    f = config.without_replication
    assert f("postgres://u:p@h:5/d?replication=database&sslmode=off") == "postgres://u:p@h:5/d?sslmode=off"
    assert f("postgres://h/d?replication=database") == "postgres://h/d"
    assert f("host=h dbname=d") == "host=h dbname=d" and f("http://[bad") == "http://[bad"


def test_validation(spark):
    r = config.routing(yaml.safe_load(FILE) | {"webhook": {"tables": {"t": {"filter": "nope"}}}, "nats": {"tables": {"u": {"key": '{{.Field "email"}}', "mask": {"email": "hmac256"}}}}})
    found = config.validate(config.Settings(dlq_threshold=9), r, {"public.users": ("id",), "public.log": ()})
    by = {(f.check, f.status): f.detail for f in found}
    assert by["settings", "ok"] and "webhook.t" in [f.detail for f in found if f.status == "fail"][0]
    assert any("hmac256" in f.detail and f.status == "fail" for f in found)
    assert by["identity", "warn"] == "public.log has no primary key" and ("limits", "warn") in by and "masked column email" in by["keys", "warn"]
    assert config.exit_code(found) == 1 and config.exit_code(config.validate(config.Settings(), config.load_routing(None))) == 0
