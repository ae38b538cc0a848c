"""Queries over replication frames: captures built from `orders`, decoded and compared with the table [D1-D15, S7, S8]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import typed_message_payload, typed_row
from ..model import read
from ..sources import frames
from .registry import Plans

plans = Plans()
query = plans.query

LOGS = 8
COLUMNS = [("id", 20, 1), ("customer", 23, 0), ("status", 1042, 0), ("price", 1700, 0), ("priority", 25, 0), ("urgent", 16, 0), ("placed", 1114, 0)]


# -- frames as binary columns ------------------------------------------------------------------------------


def number(n: Column, size: int) -> Column:
    """A non-negative integer of `size` bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def raw(data: bytes) -> Column:
    return F.lit(bytearray(data))


def text(value: Column) -> Column:
    """A column's value as text; null if it is SQL NULL."""
    value = value.cast("string").cast("binary")
    return F.when(value.isNull(), raw(b"n")).otherwise(F.concat(raw(b"t"), number(F.octet_length(value), 4), value))


def row(*values: Column) -> Column:
    return F.concat(number(F.lit(len(values)), 2), *values)


def change(lsn: Column, *body: Column) -> Column:
    return F.concat(raw(b"w"), number(lsn, 8), number(lsn, 8), number(F.lit(0), 8), *body)


def relation(relation_id: int, table: str, columns: list[tuple[str, int, int]]) -> Column:
    body = b"R" + relation_id.to_bytes(4, "big") + b"public\0" + table.encode() + b"\0d" + len(columns).to_bytes(2, "big")
    body += b"".join(bytes([key]) + name.encode() + b"\0" + oid.to_bytes(4, "big") + b"\xff\xff\xff\xff" for name, oid, key in columns)
    return change(F.lit(0), raw(body))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, seq, frame): each order is a transaction of its log, positions 16 times its key on.

    An insert, an update of every third that doesn't ship the price, a delete of every seventeenth, a message of every
    101st, a truncation of both tables after every thousandth; keep-alives inside and between transactions; noise.
    """
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    at = lambda i: F.col("k") * 16 + i
    placed = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    cents = F.floor(F.col("o_totalprice") * 100).cast("long")
    price = F.concat(F.expr("cast(floor(o_totalprice * 100) as long) div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    every = lambda n, i=0: F.col("k") % n == i
    image = [text(F.col("k")), text(F.col("o_custkey")), text(F.lit("O")), text(price), text(F.when(~every(5), F.col("o_orderpriority"))), text(F.when(every(2), "t").otherwise("f")), text(F.date_format(F.timestamp_seconds(placed), "yyyy-MM-dd HH:mm:ss"))]
    new = [*image[:2], text(F.col("o_orderstatus")), raw(b"u"), *image[4:]]
    key = [image[0], *[raw(b"n")] * (len(image) - 1)]
    rel = number(F.lit(1), 4)
    steps = [
        (0, F.lit(True), change(at(0), raw(b"B"), number(at(14), 8), number((placed - 946684800) * 1_000_000, 8), number(F.col("k"), 4))),
        (1, F.lit(True), change(at(1), raw(b"I"), rel, raw(b"N"), row(*image))),
        (2, every(3), change(at(2), raw(b"U"), rel, raw(b"K"), row(*key), raw(b"N"), row(*new))),
        (3, every(17), change(at(3), raw(b"D"), rel, raw(b"K"), row(*key))),
        (4, every(101), change(at(4), raw(b"M\0"), number(at(4), 8), raw(b"note\0"), number(F.octet_length(F.col("k").cast("string")), 4), F.col("k").cast("string").cast("binary"))),
        (5, every(7), F.concat(raw(b"k"), number(at(15), 8), number(F.lit(0), 8), raw(b"\1"))),
        (6, every(1000), change(at(6), raw(b"T"), number(F.lit(2), 4), raw(b"\0"), rel, number(F.lit(2), 4))),
        (7, every(50), raw(b"N notice")),
        (8, F.lit(True), change(at(14), raw(b"C\0"), number(at(14), 8), number(at(14), 8), number(F.lit(0), 8))),
        (9, every(7, 1), F.concat(raw(b"k"), number(at(15), 8), number(F.lit(0), 8), raw(b"\0"))),
    ]
    made = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.when(on, frame).alias("frame")) for i, on, frame in steps)), lambda s: s["frame"].isNotNull())
    log = F.concat(F.lit("log"), (F.col("k") % LOGS).cast("string"))
    changes = o.select(log.alias("log"), "k", F.explode(made).alias("s")).select("log", (F.col("k") * 16 + F.col("s.i")).alias("seq"), "s.frame")
    described = spark.range(LOGS).select(F.concat(F.lit("log"), F.col("id").cast("string")).alias("log"), F.explode(F.array(F.struct(F.lit(-2).alias("seq"), relation(1, "orders", COLUMNS).alias("frame")), F.struct(F.lit(-1).alias("seq"), relation(2, "archive", [("id", 20, 1), ("shape", 99999, 0)]).alias("frame")))).alias("s")).select("log", F.col("s.seq").cast("long").alias("seq"), "s.frame")
    return described.unionByName(changes)


_O = """o AS (SELECT o_orderkey AS k, 'log' || (o_orderkey % 8)::VARCHAR AS log, o_custkey::VARCHAR AS customer, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
    floor(o_totalprice * 100)::BIGINT AS cents, epoch(date_trunc('second', o_orderdate))::BIGINT AS placed, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed_text, CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'f' END AS urgent FROM orders),
    p AS (SELECT *, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS price FROM o)"""
_HEX = "'0/' || upper(to_hex({}))"
_EVENTS = f"""WITH {_O}, e AS (
    SELECT log, k, 1 AS i, 'INSERT' AS op, 'orders' AS tbl, k::VARCHAR AS id, 'O' AS status, price, priority, '' AS omitted, NULL AS old_id, '' AS suffix FROM p
    UNION ALL SELECT log, k, 2, 'UPDATE', 'orders', k::VARCHAR, status, NULL, priority, 'price', k::VARCHAR, '' FROM p WHERE k % 3 = 0
    UNION ALL SELECT log, k, 3, 'DELETE', 'orders', NULL, NULL, NULL, NULL, '', k::VARCHAR, '' FROM p WHERE k % 17 = 0
    UNION ALL SELECT log, k, 6, 'TRUNCATE', t, NULL, NULL, NULL, NULL, '', NULL, s FROM p, (VALUES ('orders', '-0'), ('archive', '-1')) v(t, s) WHERE k % 1000 = 0) """


@query(
    _EVENTS
    + f"SELECT log, {_HEX.format('k * 16 + i')} || suffix AS event_id, op, tbl AS \"table\", k AS xid, placed AS ts, id, status, price, priority, omitted, old_id, op IN ('INSERT', 'UPDATE') AS knows_priority FROM e JOIN (SELECT k, placed FROM p) USING (k)"
)
def frames_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of inserts, updates, deletes and truncations, with transaction and time; a null column is there, an omitted one isn't."""
    e = frames.events(frames.decode(capture(spark, sf_dir)))
    new = lambda c: F.element_at("new_data", F.lit(c))
    return e.select(
        "log", "event_id", "op", "table", "xid", F.unix_timestamp("ts").alias("ts"), *(new(c).alias(c) for c in ("id", "status", "price", "priority")), F.array_join("unchanged_toast", ",").alias("omitted"),
        F.element_at("old_data", F.lit("id")).alias("old_id"), F.coalesce(F.map_contains_key("new_data", "priority"), F.lit(False)).alias("knows_priority"),
    )


_TYPED = """'{"customer":' || customer || ',"id":' || k::VARCHAR || ',"placed":"' || replace(placed_text, ' ', 'T') || 'Z","price":"' || price || '","priority":' || coalesce('"' || priority || '"', 'null') || ',"status":"O","urgent":' || CASE urgent WHEN 't' THEN 'true' ELSE 'false' END || '}'"""


@query(f"WITH {_O} SELECT {_HEX.format('k * 16 + 1')} AS event_id, {_TYPED} AS body FROM p")
def frames_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted rows as JSON: integers and booleans as such, exact decimals as strings, times in ISO 8601."""
    e = frames.events(frames.decode(capture(spark, sf_dir))).where("op = 'INSERT'")
    return e.select("event_id", typed_row(F.col("new_data"), F.col("types")).alias("body"))


_MESSAGE = "'{\"event_id\":\"' || " + _HEX.format("k * 16 + 3") + """ || '","operation":"DELETE","schema":"public","table":"orders","old_data":{"customer":null,"id":' || k::VARCHAR || ',"placed":null,"price":null,"priority":null,"status":null,"urgent":null},"new_data":null,"unchanged_toast_columns":[],"metadata":{"lsn":"' || """ + _HEX.format("k * 16 + 3") + """ || '","transaction_id":' || k::VARCHAR || ',"timestamp":"' || replace(placed_text, ' ', 'T') || 'Z"}}'"""


@query(f"WITH {_O} SELECT k, {_MESSAGE} AS payload FROM p WHERE k % 17 = 0")
def frames_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bus or web hook gets of a delete: typed old row, no new one."""
    e = frames.events(frames.decode(capture(spark, sf_dir))).where("op = 'DELETE'")
    return e.select(F.col("xid").alias("k"), typed_message_payload().alias("payload"))


@query(f"WITH {_O} SELECT log, max(CASE WHEN k % 7 = 1 THEN k * 16 + 15 ELSE k * 16 + 14 END) AS acked, max(CASE WHEN k % 7 IN (0, 1) THEN k * 16 + 15 ELSE k * 16 + 14 END) AS server_end, max(CASE WHEN k % 7 IN (0, 1) THEN k * 16 + 15 ELSE k * 16 + 14 END) - max(CASE WHEN k % 7 = 1 THEN k * 16 + 15 ELSE k * 16 + 14 END) AS lag FROM p GROUP BY log")
def frames_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keep-alive inside a transaction confirms nothing; commits and those between do. Lag is what the server is ahead."""
    per = frames.progress(frames.decode(capture(spark, sf_dir)))
    return per.select("log", *(F.col(c).cast("long").alias(c) for c in ("acked", "server_end", "lag")))


@query(f"WITH {_O} SELECT log, 'note' AS prefix, k::VARCHAR AS content, k * 16 + 4 AS lsn FROM p WHERE k % 101 = 0")
def frames_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.decode(capture(spark, sf_dir)).where("kind = 'message'")
    return rows.select("log", "message.prefix", F.col("message.content").cast("string").alias("content"), "message.lsn")


_NAMES = ", ".join(f"('orders', {i}, '{n}', {o}, {str(bool(k)).lower()})" for i, (n, o, k) in enumerate(COLUMNS)) + ", ('archive', 0, 'id', 20, true), ('archive', 1, 'shape', 99999, false)"


@query(f"SELECT 'log' || l::VARCHAR AS log, t AS \"table\", n AS name, i::INTEGER AS place, CASE o WHEN 20 THEN 'int8' WHEN 23 THEN 'int4' WHEN 1042 THEN 'bpchar' WHEN 1700 THEN 'numeric' WHEN 25 THEN 'text' WHEN 16 THEN 'bool' WHEN 1114 THEN 'timestamp' ELSE 'oid:' || o::VARCHAR END AS type, k AS key FROM range(8) r(l), (VALUES {_NAMES}) v(t, i, n, o, k)")
def frames_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described tables with their columns' types by name; unknown type ids are named by number."""
    rows = frames.decode(capture(spark, sf_dir)).where("kind = 'relation'")
    return rows.select("log", "relation.table", F.posexplode("relation.columns").alias("place", "c")).select("log", "table", "c.name", "place", "c.type", "c.key")


_BROKEN = {
    0: (b"S\0\0\0\1\1", "transactions in progress are never asked for"), 1: (b"I\0\0\0\x63N\0\0", "relation 99 was not described"), 2: (b"B\0\0", "frame is cut off"), 3: (b"c\0\0\0\1", "transactions in progress are never asked for"),
}


@query("SELECT n_nationkey::BIGINT AS seq, CASE n_nationkey % 4 WHEN 0 THEN 'transactions in progress are never asked for' WHEN 1 THEN 'relation 99 was not described' WHEN 2 THEN 'frame is cut off' ELSE 'transactions in progress are never asked for' END AS error FROM nation")
def frames_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of transactions in progress, of tables that weren't described, and cut-off ones are errors."""
    kind = F.col("n_nationkey") % 4
    body = reduce(lambda a, i: F.when(kind == i, raw(_BROKEN[i][0])).otherwise(a), (1, 2, 3), raw(_BROKEN[0][0]))
    rows = read(spark, sf_dir, "nation").select(F.lit("log").alias("log"), F.col("n_nationkey").cast("long").alias("seq"), change(F.lit(5), body).alias("frame"))
    return frames.decode(rows, fail=False).where("kind = 'error'").select("seq", "error")


@query("SELECT c_custkey, 'postgres://u' || c_custkey::VARCHAR || ':p@host/db' || CASE WHEN c_custkey % 3 = 0 THEN '?sslmode=disable' ELSE '' END AS url FROM customer")
def replication_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database addresses without their replication parameter [S13]."""
    from ..sources.config import without_replication

    c = read(spark, sf_dir, "customer").select("c_custkey")
    query = F.when(F.col("c_custkey") % 3 == 0, "?sslmode=disable&replication=database").when(F.col("c_custkey") % 3 == 1, "?replication=database").otherwise("")
    stripped = F.pandas_udf(lambda urls: urls.map(without_replication), "string")
    return c.select("c_custkey", stripped(F.concat(F.lit("postgres://u"), F.col("c_custkey").cast("string"), F.lit(":p@host/db"), query)).alias("url"))

