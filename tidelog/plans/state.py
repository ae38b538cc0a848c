"""Queries over current state, routing, masks, keys and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, masks, payloads
from ..functions.expressions import compile_filter
from ..model import EVENT_LOG_SQL, ORDER_LOG_SQL, envelope, event_log, order_log, read
from ..operators import apply, dedupe, outbox, route, transform
from ..sources.config import Outbox, Sink, Table, Transform, routing
from .registry import Plans

plans = Plans()
query = plans.query

# -- current state [K2-K4] ------------------------------------------------------------------------

_STATE = "SELECT user_id, {columns}, last_pos, changes FROM ({agg}) WHERE last_op <> 'DELETE'"
_MERGE_SQL = """
WITH {log}, s AS (
  SELECT user_id, max(pos) AS last_pos, arg_max(op, pos) AS last_op, count(*) AS changes,
         max(CASE WHEN op IN ('INSERT', 'READ', 'DELETE'){update} THEN pos END) AS reset
  FROM log GROUP BY user_id),
t AS (SELECT l.user_id, arg_max(event_type, pos) AS event_type FROM log l JOIN s USING (user_id) WHERE op <> 'DELETE' AND pos >= reset GROUP BY 1),
p AS (SELECT l.user_id, arg_max(props, pos) AS props FROM log l JOIN s USING (user_id) WHERE op <> 'DELETE' AND NOT omitted AND pos >= reset GROUP BY 1)
SELECT s.user_id, t.event_type, p.props, s.last_pos, s.changes
FROM s LEFT JOIN t USING (user_id) LEFT JOIN p USING (user_id) WHERE last_op <> 'DELETE'
"""


@query(_MERGE_SQL.format(log=EVENT_LOG_SQL, update=" OR (op = 'UPDATE' AND NOT omitted)"))
def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return apply.merge_apply(log, ["user_id"], ["event_type", "props"], {"props": ~F.col("omitted")}, F.col("omitted"))


@query(_MERGE_SQL.format(log=EVENT_LOG_SQL, update=""))
def index_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return apply.merge_apply(log, ["user_id"], ["event_type", "props"], {"props": ~F.col("omitted")}, F.col("omitted"), flavour=apply.PARTIAL)


@query(f"WITH {EVENT_LOG_SQL} SELECT user_id, max(pos) AS last_pos, arg_max(op, pos) AS last_op FROM log GROUP BY user_id")
def latest_op_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.latest_operation(event_log(spark, sf_dir), ["user_id"])


@query(
    _MERGE_SQL.format(log=EVENT_LOG_SQL, update=" OR (op = 'UPDATE' AND NOT omitted)").replace("SELECT s.user_id, t.event_type, p.props, s.last_pos, s.changes", "SELECT s.user_id::VARCHAR AS doc_key, t.event_type, p.props, s.last_pos")
)
def mirror_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from change events, field by field, without a schema."""
    docs = apply.documents(envelope(spark, sf_dir), apply.row_key(["user_id"]))
    return docs.select("doc_key", F.col("document")["event_type"].alias("event_type"), F.col("document")["props"].alias("props"), F.col("lsn_num").cast("long").alias("last_pos"))


@query(
    """SELECT o_orderkey, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'F' END AS status FROM orders"""
)
def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 7386: a null member deletes, others replace."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    target = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    patch = F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("F")))
    merged = o.select("o_orderkey", payloads.merge_patch(target, patch).alias("m"))
    return merged.select("o_orderkey", F.col("m")["priority"].alias("priority"), F.col("m")["status"].alias("status"))


@query(
    f"""WITH {EVENT_LOG_SQL}, twice AS (SELECT * FROM log UNION ALL SELECT * FROM log WHERE pos % 10 = 0)
    SELECT pos, any_value(user_id) AS user_id, any_value(op) AS op FROM twice GROUP BY pos"""
)
def dedupe_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("pos", "user_id", "op")
    twice = log.unionByName(log.where("pos % 10 = 0"))
    return dedupe.once(twice, "pos", "user_id")


@query(
    f"""WITH {ORDER_LOG_SQL}, e AS (SELECT *, CASE WHEN op = 'UPDATE' AND id % 101 = 0 THEN 2 ELSE 1 END AS n FROM olog)
    SELECT op, sum(c)::BIGINT AS events FROM (
      SELECT CASE WHEN n = 2 THEN 'DELETE' ELSE op END AS op, 1 AS c FROM e UNION ALL SELECT 'INSERT', 1 FROM e WHERE n = 2) GROUP BY op"""
)
def key_changes_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An UPDATE that moves a row to another key as a DELETE and an INSERT."""
    log = order_log(spark, sf_dir)
    moved = (F.col("op") == "UPDATE") & (F.col("new_data")["id"].cast("long") % 101 == 0)
    log = log.withColumn("old_data", F.when(moved, F.create_map(F.lit("id"), F.concat(F.lit("-"), F.col("new_data")["id"]))).otherwise(F.col("old_data")))
    return apply.move_keys(log, ["id"]).groupBy("op").agg(F.count("*").alias("events"))


# -- exclusion and routing [F1-F7, F12] -------------------------------------------------------------

_TABLES_SQL = f"""WITH {EVENT_LOG_SQL}, {ORDER_LOG_SQL},
ev AS (SELECT 'public' AS schema, 'sessions' AS tbl, op, pos, NULL AS status FROM log UNION ALL SELECT 'public', 'orders', op, pos, status FROM olog
       UNION ALL SELECT 'audit', 'orders', 'INSERT', o_orderkey, NULL FROM orders) """


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelope(spark, sf_dir)
    o = order_log(spark, sf_dir)
    audit = o.where("op = 'INSERT'").withColumn("schema", F.lit("audit"))
    return e.unionByName(o).unionByName(audit)


@query(_TABLES_SQL + "SELECT schema, tbl AS \"table\", count(*) AS events FROM ev WHERE NOT (schema = 'audit' AND tbl = 'orders') AND tbl <> 'sessions' GROUP BY ALL")
def exclude_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.exclude(_mixed(spark, sf_dir), ["audit.orders"], "sessions").groupBy("schema", "table").agg(F.count("*").alias("events"))


_ROUTES = {
    "redis_stream": {"sync_all": True},
    "redis_json": {"tables": {"public.orders": "k"}},
    "meilisearch": {"tables": {"orders": "orders_index", "audit.orders": ""}},
    "webhook": {"tables": {"sessions": ""}},
    "nats": {},
}


@query(
    _TABLES_SQL
    + """SELECT sink, schema, tbl AS "table", count(*) AS events FROM ev, (VALUES ('stream'), ('document'), ('index'), ('webhook'), ('bus')) s(sink)
    WHERE sink = 'stream' OR (sink = 'document' AND schema = 'public' AND tbl = 'orders') OR (sink = 'index' AND tbl = 'orders' AND schema <> 'audit') OR (sink = 'webhook' AND tbl = 'sessions')
    GROUP BY ALL"""
)
def route_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.route(_mixed(spark, sf_dir), routing(_ROUTES)).groupBy("sink", "schema", "table").agg(F.count("*").alias("events"))


@query("SELECT * FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) WHERE lower(c_custkey::VARCHAR || ' ' || c_name || ' ' || c_mktsegment) LIKE '%mach%'")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.search(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "MaCh")


# -- outbox [F6, F7, P18] ---------------------------------------------------------------------------

_OUTBOX = Outbox("public", "outbox", default_topic="other")


@query(
    """SELECT 'events:' || CASE WHEN event_type = 'view' THEN 'other' ELSE event_type END AS stream, event_id::VARCHAR AS id, props AS payload,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS type, user_id::VARCHAR AS key FROM events WHERE event_id % 2 = 0"""
)
def outbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    image = F.create_map(
        F.lit("id"), F.col("event_id").cast("string"), F.lit("topic"), F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")),
        F.lit("event_type"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit("aggregate_id"), F.col("user_id").cast("string"), F.lit("payload"), F.col("props"),
    )
    rows = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 2 == 0, F.lit("INSERT")).otherwise(F.lit("UPDATE")).alias("op"), F.lit("public").alias("schema"), F.lit("outbox").alias("table"), image.alias("new_data")
    )
    return outbox.messages(rows, _OUTBOX).select("stream", "id", "payload", "type", "key")


# -- filters [F8] -----------------------------------------------------------------------------------


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, op, status FROM olog WHERE op <> 'DELETE' AND status = 'F'")
def filter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_log(spark, sf_dir).where(compile_filter('"status" in new && new.status == "F"'))
    return rows.select(F.col("lsn_num").cast("long").alias("pos"), "op", F.col("new_data")["status"].alias("status"))


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, op FROM olog WHERE op = 'DELETE' OR (customer > 500 AND status IN ('O', 'P')) OR id::VARCHAR LIKE '%9'")
def filter_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'op == "DELETE" || (new.customer > 500 && new.status in ["O", "P"]) || (has(new.id) && new.id.endsWith("9"))'
    # the id of a DELETE is in old, and deletes are taken already
    return order_log(spark, sf_dir).where(compile_filter(text)).select(F.col("lsn_num").cast("long").alias("pos"), "op")


@query(f"WITH {EVENT_LOG_SQL} SELECT pos, op, user_id::VARCHAR AS user_id FROM log WHERE op = 'UPDATE' AND NOT omitted AND props IS NOT NULL")
def filter_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = envelope(spark, sf_dir).where(compile_filter('op == "UPDATE" && "props" in new && new.props != null'))
    return rows.select(F.col("lsn_num").cast("long").alias("pos"), "op", F.col("new_data")["user_id"].alias("user_id"))


# -- masks [P1-P10] ---------------------------------------------------------------------------------

_KEY = b"a mask key"


def _hmac_sql(value: str, key: bytes = _KEY) -> str:
    padded = key.ljust(64, b"\0")
    pad = lambda b: "unhex('" + bytes(x ^ b for x in padded).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({value}))))"


_CUSTOMER = "SELECT c_custkey, {mask} AS masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'Zoë' ELSE c_name END AS v FROM customer)"
_MASK_SQL = {
    "redact": "CASE WHEN v IS NOT NULL THEN '[REDACTED]' END",
    "null": "NULL::VARCHAR",
    "sha256": "sha256(v)",
    "hmac256": f"CASE WHEN v IS NOT NULL THEN {_hmac_sql('v')} END",
    "last4": "CASE WHEN v IS NULL THEN NULL WHEN length(v) <= 4 THEN '****' ELSE repeat('*', length(v) - 4) || right(v, 4) END",
}


def _masked(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit("Zoë")).otherwise(F.col("c_name"))
        return read(spark, sf_dir, "customer").select("c_custkey", masks.mask(strategy, _KEY)(value).alias("masked"))

    return run


for _s in masks.STRATEGIES:
    query(_CUSTOMER.format(mask=_MASK_SQL[_s]), f"mask_{_s}")(_masked(_s))


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, op, CASE WHEN op <> 'DELETE' THEN sha256(customer::VARCHAR) END AS customer, CASE WHEN op <> 'DELETE' THEN 1 ELSE 0 END AS n_new FROM olog WHERE op = 'DELETE' OR status <> 'P'")
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then drop, then mask; sink-wide first, then the table's."""
    sink = Sink("stream", True, "", Transform('op == "DELETE" || new.status != "P"', ("status",)), {"public.orders": Table("", Transform('op == "DELETE" || !("status" in new)', ("id",), (("customer", "sha256"),)))})
    out = transform.transform(order_log(spark, sf_dir), sink)
    return out.select(F.col("lsn_num").cast("long").alias("pos"), "op", F.col("new_data")["customer"].alias("customer"), F.coalesce(F.size("new_data"), F.lit(0)).alias("n_new")).withColumn("n_new", F.when(F.col("n_new") < 0, 0).otherwise(F.col("n_new")))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    image = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    kept = c.select("c_custkey", masks.drop_keys(image, ["name"]).alias("m"))
    return kept.where(~F.map_contains_key("m", "name")).select("c_custkey", F.col("m")["segment"].alias("c_mktsegment"))


# -- keys, subjects, payloads [P11-P19] -------------------------------------------------------------


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, 'app:orders:' || CASE WHEN op = 'DELETE' THEN '' ELSE status END AS key FROM olog")
def key_template_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.template('{{.Prefix}}:orders:{{.Field "status"}}', "app")
    return order_log(spark, sf_dir).select(F.col("lsn_num").cast("long").alias("pos"), key.alias("key"))


@query(f"WITH {EVENT_LOG_SQL} SELECT pos, 'public-env:public:sessions:' || user_id::VARCHAR || ':' || op || ':' || CASE WHEN op = 'DELETE' OR omitted THEN '' ELSE coalesce(props, 'null') END AS key FROM log")
def key_template_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.template(keys.DEFAULT_DOCUMENT_KEY.replace('"id"', '"user_id"') + ':{{.Operation}}:{{.Field "props"}}', "{{.Schema}}-env")
    return envelope(spark, sf_dir).select(F.col("lsn_num").cast("long").alias("pos"), key.alias("key"))


@query("SELECT p_partkey, translate(p_name || '.' || p_type || '*>' || chr(9) || 'x', '*> ' || chr(9) || chr(10) || chr(13), '______') AS subject FROM part")
def subject_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", keys.sanitize(F.concat("p_name", F.lit("."), "p_type", F.lit("*>\tx"))).alias("subject"))


_META = "'{{\"{l}\":\"' || printf('%X', pos // 4294967296) || '/' || printf('%X', pos % 4294967296) || '\",\"{x}\":' || id || ',\"{t}\":\"1992-01-01T00:00:00Z\"}}'"
_OLD = "CASE WHEN op = 'DELETE' THEN '{\"id\":\"' || id || '\"}' ELSE 'null' END"
_NEW = "CASE WHEN op <> 'DELETE' THEN '{\"id\":\"' || id || '\",\"customer\":\"' || customer || '\",\"status\":\"' || status || '\"}' ELSE 'null' END"


def _fixed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log(spark, sf_dir).withColumn("ts", F.lit("1992-01-01 00:00:00").cast("timestamp"))


@query(
    f"""WITH {ORDER_LOG_SQL} SELECT pos, '{{"operation":"' || op || '","old_data":' || {_OLD} || ',"new_data":' || {_NEW} || ',"unchanged_toast_columns":[],"metadata":' || {_META.format(l="LSN", x="TransactionID", t="Timestamp")} || '}}' AS payload FROM olog"""
)
def payload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_time(spark, sf_dir).select(F.col("lsn_num").cast("long").alias("pos"), payloads.stream_payload().alias("payload"))


_ID = "printf('%X', pos // 4294967296) || '/' || printf('%X', pos % 4294967296)"
_BODY = f"""'{{"event_id":"' || {_ID} || '","operation":"' || op || '","schema":"public","table":"orders","old_data":' || {_OLD} || ',"new_data":' || {_NEW} || ',"unchanged_toast_columns":[],"metadata":' || {_META.format(l="lsn", x="transaction_id", t="timestamp")} || '}}'"""


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, {_BODY} AS payload FROM olog")
def payload_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_time(spark, sf_dir).select(F.col("lsn_num").cast("long").alias("pos"), payloads.message_payload().alias("payload"))


@query(f"WITH {ORDER_LOG_SQL} SELECT pos, 'public.orders' AS table_header, 'sha256=' || {_hmac_sql(f"('1700000000.' || {_BODY})", b'secret')} AS signature FROM olog")
def webhook_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixed_time(spark, sf_dir).withColumn("body", payloads.message_payload())
    headers = payloads.webhook_headers(F.col("body"), F.lit(1700000000), b"secret")
    return rows.select(F.col("lsn_num").cast("long").alias("pos"), headers["X-CDC-Table"].alias("table_header"), headers["X-CDC-Signature"].alias("signature"))


@query("SELECT l_orderkey::VARCHAR || chr(31) || l_linenumber::VARCHAR AS key, count(*) AS rows FROM lineitem GROUP BY 1")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.create_map(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("n"), F.col("l_linenumber").cast("string"))
    return read(spark, sf_dir, "lineitem").select(keys.canonical_key(image, ["o", "n"]).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
