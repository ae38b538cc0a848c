"""Queries over backfill and schema changes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_LOG_SQL, envelope, event_log, lsn_num, lsn_of, read
from ..operators import backfill, schema_diff
from .registry import Plans

plans = Plans()
query = plans.query

# -- backfill [S10-S12, J1-J3, T12-T19] ---------------------------------------------------------------

#: Keys of a chunk; each chunk's marks are a tenth of its share of the log apart.
CHUNK = 10
_CHUNK_SQL = f"""WITH {EVENT_LOG_SQL}, n AS (SELECT max(pos) // (max(user_id) // {CHUNK} + 1) AS step FROM log),
    chunk AS (SELECT DISTINCT user_id // {CHUNK} AS chunk, user_id, user_id // {CHUNK} * step AS low, user_id // {CHUNK} * step + step // 10 AS high FROM log, n),
    live AS (SELECT DISTINCT pos // step AS chunk, user_id FROM log, n WHERE pos % step > 0 AND pos % step < step // 10) """


def _step(spark: SparkSession, sf_dir: str) -> int:
    top = event_log(spark, sf_dir).agg(F.max("pos").alias("pos"), F.max("user_id").alias("user")).first()
    return top.pos // (top.user // CHUNK + 1)


def _chunk(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Every key of the table in its chunk, with the chunk's marks."""
    rows = event_log(spark, sf_dir).select("user_id").distinct().withColumn("chunk", F.expr(f"user_id div {CHUNK}"))
    return rows.withColumn("key", F.col("user_id").cast("string")).withColumn("low", F.col("chunk") * step).withColumn("high", F.col("chunk") * step + step // 10)


def _seen(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    events = envelope(spark, sf_dir).withColumn("chunk", F.expr(f"cast(lsn_num as long) div {step}"))
    return backfill.seen_keys(events, "public", "sessions", ["user_id"], F.col("chunk") * step, F.col("chunk") * step + step // 10)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey, o_custkey) > (2000, 10) ORDER BY o_orderkey, o_custkey LIMIT 1000")
def backfill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], (2000, 10), 1000)


@query(_CHUNK_SQL + "SELECT chunk, user_id, user_id::VARCHAR AS key FROM chunk ANTI JOIN live USING (chunk, user_id)")
def backfill_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _step(spark, sf_dir)
    return backfill.supersede_chunks(_chunk(spark, sf_dir, step), _seen(spark, sf_dir, step)).select("chunk", "user_id", "key")


@query(_CHUNK_SQL + "SELECT chunk, count(*) AS rows, count(l) AS superseded, count(*) - count(l) AS delivered FROM chunk LEFT JOIN (SELECT *, 1 AS l FROM live) USING (chunk, user_id) GROUP BY chunk")
def backfill_superseded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _step(spark, sf_dir)
    return backfill.superseded_counts(_chunk(spark, sf_dir, step), _seen(spark, sf_dir, step))


@query(_CHUNK_SQL + "SELECT 'bf:public.sessions:' || user_id::VARCHAR AS event_id, 'READ' AS op, 'sessions' AS \"table\", user_id::VARCHAR AS user_id, printf('%X', high // 4294967296) || '/' || printf('%X', high % 4294967296) AS lsn, high AS pos FROM chunk ANTI JOIN live USING (chunk, user_id)")
def backfill_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _step(spark, sf_dir)
    left = backfill.supersede_chunks(_chunk(spark, sf_dir, step), _seen(spark, sf_dir, step))
    rows = backfill.read_events(left, "public", "sessions", ["user_id"], lsn_of(F.col("high")), F.col("high"))
    return rows.select("event_id", "op", "table", F.col("new_data")["user_id"].alias("user_id"), "lsn", F.col("lsn_num").cast("long").alias("pos"))


@query("""SELECT 'c' || (event_id // 100)::VARCHAR AS chunk, min(event_id) AS low, min(event_id) + 50 AS high FROM events WHERE event_id // 100 % 5 <> 4 GROUP BY 1""")
def backfill_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark messages to chunk windows: foreign slots and bad content are ignored, chunks without a high mark wait."""
    e = read(spark, sf_dir, "events").where("event_id % 100 IN (0, 50)").withColumn("chunk", F.expr("event_id div 100"))
    slot = F.when(F.col("chunk") % 5 == 4, F.lit("other")).otherwise(F.lit("main"))
    content = F.to_json(F.struct(slot.alias("slot"), F.concat(F.lit("c"), F.col("chunk").cast("string")).alias("chunk"), F.when(F.col("event_id") % 100 == 0, F.lit("low")).otherwise(F.lit("high")).alias("mark")))
    bad = read(spark, sf_dir, "events").where("event_id % 100 = 25").select(F.col("event_id").cast("decimal(20,0)").alias("lsn_num"), F.lit("{").alias("content"))
    marks = e.select(F.col("event_id").cast("decimal(20,0)").alias("lsn_num"), content.alias("content")).unionByName(bad)
    rows = backfill.windows(backfill.watermarks(marks, "main"))
    return rows.select("chunk", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query("""SELECT 's' || (n_regionkey)::VARCHAR AS schema, n_name AS "table" FROM nation WHERE n_nationkey % 3 <> 0 AND n_name <> (SELECT min(n_name) FROM nation WHERE n_nationkey % 3 = 1) AND n_nationkey % 4 <> 1""")
def backfill_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("schema"), F.col("n_name").alias("table"), "n_nationkey")
    published = n.where("n_nationkey % 3 <> 0").select("schema", "table")
    progress = n.where("n_nationkey % 4 = 1").select("schema", "table", F.lit("done").alias("state"))
    first = n.where("n_nationkey % 3 = 1").agg(F.min("table")).first()[0]
    return backfill.pending(published, progress, [first])


@query("""SELECT n_nationkey::BIGINT AS table_id, 'a' || n_nationkey::VARCHAR || ',b' || n_nationkey::VARCHAR AS columns FROM nation WHERE n_nationkey % 2 = 0""")
def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("table_id"))
    indexes = n.select("table_id", (F.col("table_id") % 2 == 0).alias("is_primary"), F.array(F.lit(2), F.lit(1)).alias("attnums"))
    attributes = n.select("table_id", F.explode(F.array(F.struct(F.lit(1).alias("attnum"), F.concat(F.lit("b"), "table_id").alias("name")), F.struct(F.lit(2).alias("attnum"), F.concat(F.lit("a"), "table_id").alias("name")))).alias("a")).select("table_id", "a.*")
    return backfill.primary_keys(indexes, attributes).select("table_id", F.array_join("columns", ",").alias("columns"))


@query("""SELECT count(*) AS n_tables, (SELECT string_agg(n_name, ', ') FROM (SELECT n_name FROM nation WHERE n_nationkey % 2 = 1 ORDER BY n_name LIMIT 5)) AS first_names FROM nation WHERE n_nationkey % 2 = 1""")
def no_identity_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("table_id"), F.col("n_name").alias("name"), F.lit("d").alias("identity"))
    return backfill.without_identity(n, n.where("table_id % 2 = 0").select("table_id"))


@query("SELECT event_id, printf('%X', event_id * 4294967 // 4294967296) || '/' || printf('%X', event_id * 4294967 % 4294967296) AS lsn, event_id * 4294967 AS pos FROM events")
def lsn_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", lsn_of(F.col("event_id") * 4294967).alias("lsn"))
    return rows.withColumn("pos", lsn_num(F.col("lsn")).cast("long"))


# -- schema changes [C1-C12, J4, J5] --------------------------------------------------------------------

_C = {"id": ("id", 23, "int4", True), "id8": ("id", 20, "int8", True), "name": ("name", 25, "text", False), "email": ("email", 1043, "varchar", False), "nick": ("nickname", 25, "text", False), "code": ("code", 25, "text", True)}
HISTORY = [
    (1, 10, "public", "users", "d", ("id", "name")),
    (1, 20, "public", "users", "d", ("id", "name")),
    (1, 30, "public", "users", "d", ("id", "name", "email")),
    (1, 40, "public", "users", "d", ("id8", "email", "nick")),
    (1, 50, "crm", "people", "f", ("id8", "email", "nick")),
    (2, 15, "public", "orders", "d", ("id", "name")),
    (2, 35, "public", "orders", "d", ("code", "id", "name")),
    (2, 45, "public", "orders", "n", ("name", "id")),
]


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, Decimal(p), s, t, i, [_C[c] for c in cs]) for r, p, s, t, i, cs in HISTORY], schema_diff.RELATION)


def _column_sql(c: str) -> str:
    name, oid, kind, key = _C[c]
    return f"{{'name': '{name}', 'oid': {oid}, 'type': '{kind}', 'key': {str(key).lower()}}}"


_HISTORY_SQL = "h AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {p}, '{s}', '{t}', '{i}', [{', '.join(map(_column_sql, cs))}])" for r, p, s, t, i, cs in HISTORY) + ") v(relation_id, pos, s, t, identity, cols))"
_DIFF_SQL = f"""
WITH {_HISTORY_SQL}, w AS (SELECT *, lag(s) OVER o AS ps, lag(t) OVER o AS pt, lag(identity) OVER o AS pi, lag(cols) OVER o AS pc FROM h WINDOW o AS (PARTITION BY relation_id ORDER BY pos)),
x AS (SELECT *, s <> ps OR t <> pt AS renamed, pi <> identity AS reident,
        list_filter(cols, lambda c: NOT list_contains(list_transform(pc, lambda p: p.name), c.name)) AS added,
        list_filter(pc, lambda p: NOT list_contains(list_transform(cols, lambda c: c.name), p.name)) AS dropped,
        list_filter(cols, lambda c: len(list_filter(pc, lambda p: p.name = c.name AND p.oid <> c.oid)) > 0) AS retyped,
        list_transform(list_filter(cols, lambda c: c.key), lambda c: c.name) AS k, list_transform(list_filter(pc, lambda c: c.key), lambda c: c.name) AS pk
      FROM w WHERE pc IS NOT NULL),
y AS (SELECT relation_id, pos,
        list_filter([CASE WHEN renamed THEN 'table_renamed' END, CASE WHEN len(added) > 0 THEN 'column_added' END, CASE WHEN len(dropped) > 0 THEN 'column_dropped' END,
                     CASE WHEN len(retyped) > 0 THEN 'column_type_changed' END, CASE WHEN reident THEN 'replica_identity_changed' WHEN k <> pk THEN 'key_changed' END], lambda z: z IS NOT NULL) AS kinds,
        list_filter([CASE WHEN renamed THEN 'renamed from ' || ps || '.' || pt END, CASE WHEN len(added) > 0 THEN 'added ' || array_to_string(list_transform(added, lambda c: c.name), ', ') END,
                     CASE WHEN len(dropped) > 0 THEN 'dropped ' || array_to_string(list_transform(dropped, lambda c: c.name), ', ') END,
                     CASE WHEN len(retyped) > 0 THEN array_to_string(list_transform(retyped, lambda c: c.name || ' ' || list_filter(pc, lambda p: p.name = c.name)[1].type || '->' || c.type), ', ') END,
                     CASE WHEN reident THEN 'replica identity ' || pi || '->' || identity WHEN k <> pk THEN 'key [' || array_to_string(pk, ' ') || ']->[' || array_to_string(k, ' ') || ']' END], lambda z: z IS NOT NULL) AS parts FROM x)
"""


@query(_DIFF_SQL + "SELECT relation_id::BIGINT AS relation_id, pos::BIGINT AS pos, array_to_string(kinds, ',') AS kinds, array_to_string(parts, '; ') AS summary, len(list_filter(kinds, lambda z: z <> 'column_added')) > 0 AS breaking FROM y WHERE len(kinds) > 0")
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema_diff.changes(relations(spark))
    return rows.select("relation_id", F.col("lsn_num").cast("long").alias("pos"), F.array_join("kinds", ",").alias("kinds"), "summary", "breaking")


@query(_DIFF_SQL + "SELECT count(*) AS changes, count(*) FILTER (len(list_filter(kinds, lambda z: z <> 'column_added')) > 0) AS breaking FROM y WHERE len(kinds) > 0")
def schema_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_diff.changes(relations(spark)).agg(F.count("*").alias("changes"), F.count_if("breaking").alias("breaking"))


@query(
    f"""WITH {_HISTORY_SQL}, e AS (SELECT event_id, event_id % 60 AS pos, 1 + event_id % 2 AS relation_id FROM events)
    SELECT event_id, arg_max(s || '.' || t, h.pos) AS full_name, len(arg_max(cols, h.pos))::INTEGER AS n_columns FROM e JOIN h ON e.relation_id = h.relation_id AND h.pos <= e.pos GROUP BY event_id
    UNION ALL SELECT event_id, NULL, NULL FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.relation_id = e.relation_id AND h.pos <= e.pos)"""
)
def relation_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 60).cast("decimal(20,0)").alias("lsn_num"), (F.col("event_id") % 2 + 1).alias("relation_id"))
    out = schema_diff.with_relation(e, relations(spark))
    name = F.when(F.col("schema").isNotNull(), F.concat_ws(".", "schema", "table"))
    return out.select("event_id", name.alias("full_name"), F.when(F.col("columns").isNotNull(), F.size("columns")).alias("n_columns"))


@query("SELECT event_id, event_id // 10 AS xid FROM events WHERE event_id % 10 <> 0")
def transaction_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame begins a transaction; the others take its id."""
    begin = F.col("event_id") % 10 == 0
    frames = read(spark, sf_dir, "events").select(
        "event_id", F.expr("event_id div 1000").alias("stream"), F.col("event_id").cast("decimal(20,0)").alias("lsn_num"), F.lit(0).alias("seq"),
        F.when(begin, F.lit("B")).otherwise(F.lit("I")).alias("kind"), F.when(begin, F.expr("event_id div 10")).alias("begin_xid"), F.col("ts").cast("timestamp").alias("commit_ts"),
    )
    return schema_diff.with_transaction(frames).where("kind <> 'B'").select("event_id", "xid")
