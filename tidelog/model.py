"""The data model: the change event, positions, and change logs derived from plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE, TRUNCATE, READ = OPERATIONS = ("INSERT", "UPDATE", "DELETE", "TRUNCATE", "READ")

_ROW = T.MapType(T.StringType(), T.StringType(), True)

#: One change of one row. A column that is absent from new_data and named in unchanged_toast was not
#: shipped and keeps its value; a key with a null value is SQL NULL.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("old_data", _ROW),
        T.StructField("new_data", _ROW),
        T.StructField("unchanged_toast", T.ArrayType(T.StringType())),
        T.StructField("lsn", T.StringType()),
        T.StructField("lsn_num", T.DecimalType(20, 0)),
        T.StructField("seq", T.LongType()),
        T.StructField("xid", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

#: The same with the type id of each column, as decoded frames have it; sinks write typed values from it.
EVENT_TYPED = T.StructType([*EVENT.fields, T.StructField("types", T.MapType(T.StringType(), T.LongType(), True))])


def lsn_text(position: int) -> str:
    """X/Y, both in upper-case hexadecimal, of an unsigned 64-bit position."""
    return f"{position >> 32:X}/{position & 0xFFFFFFFF:X}"


def lsn_number(text: str) -> int:
    high, low = text.split("/")
    return (int(high, 16) << 32) | int(low, 16)


def lsn_num(lsn: Column) -> Column:
    """The position as a decimal(20,0): positions are ordered by it, never by their text."""
    half = lambda i: F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)).cast("decimal(20,0)")


def lsn_of(position: Column) -> Column:
    """The text form of a non-negative bigint position."""
    return F.concat(F.hex(F.shiftrightunsigned(position, 32)), F.lit("/"), F.hex(position.bitwiseAND(F.lit(0xFFFFFFFF))))


def full_name(schema: str = "schema", table: str = "table") -> Column:
    return F.concat_ws(".", F.col(schema), F.col(table))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- change logs derived from the bundled tables ---------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed log over `events`, keyed by user_id: pos, op, user_id, event_type, value, props, omitted.

    A row of type `error` that isn't its user's first is a DELETE, the first row and the one after an
    error are INSERTs, the rest UPDATEs; an UPDATE of type `view` doesn't ship props.
    """
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    before = F.lag("event_type").over(by_user)
    op = (
        F.when((F.col("event_type") == "error") & before.isNotNull(), F.lit(DELETE))
        .when(before.isNull() | (before == "error"), F.lit(INSERT))
        .otherwise(F.lit(UPDATE))
    )
    rows = read(spark, sf_dir, "events").withColumn("op", op)
    omitted = (F.col("op") == UPDATE) & (F.col("event_type") == "view")
    return rows.select(F.col("event_id").alias("pos"), "op", "user_id", "event_type", "value", F.when(~omitted, F.col("props")).alias("props"), omitted.alias("omitted"), F.col("ts").cast("timestamp").alias("ts"))


EVENT_LOG_SQL = """
log AS (SELECT event_id AS pos, user_id, event_type, value, ts, op,
               CASE WHEN NOT (op = 'UPDATE' AND event_type = 'view') THEN props END AS props,
               op = 'UPDATE' AND event_type = 'view' AS omitted
        FROM (SELECT *, CASE WHEN event_type = 'error' AND prev IS NOT NULL THEN 'DELETE'
                             WHEN prev IS NULL OR prev = 'error' THEN 'INSERT' ELSE 'UPDATE' END AS op
              FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)))
"""


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as change events (EVENT) of table public.sessions."""
    log = event_log(spark, sf_dir)
    image = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"))
    shipped = F.map_filter(image, lambda k, _: ~((k == "props") & F.col("omitted")))
    key = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))
    lsn = lsn_of(F.col("pos"))
    return log.select(
        lsn.alias("event_id"),
        "op",
        F.lit("public").alias("schema"),
        F.lit("sessions").alias("table"),
        F.when(F.col("op") == DELETE, key).alias("old_data"),
        F.when(F.col("op") != DELETE, shipped).alias("new_data"),
        F.when(F.col("omitted"), F.array(F.lit("props"))).otherwise(F.array().cast("array<string>")).alias("unchanged_toast"),
        lsn.alias("lsn"),
        F.col("pos").cast("decimal(20,0)").alias("lsn_num"),
        F.lit(0).cast("bigint").alias("seq"),
        F.expr("pos div 10").alias("xid"),
        "ts",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three changes of each order, as change events of public.orders, positions by key."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("ts"))
    steps = F.array(F.lit("INSERT"), F.lit("UPDATE"), F.when(F.col("o_orderkey") % 17 == 0, F.lit("DELETE")))
    rows = o.select("*", F.posexplode(F.filter(steps, lambda s: s.isNotNull())).alias("step", "op"))
    status = F.when(F.col("op") == INSERT, F.lit("O")).otherwise(F.col("o_orderstatus"))
    image = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("status"), status)
    key = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"))
    pos = F.col("o_orderkey") * 4 + F.col("step")
    return rows.select(
        lsn_of(pos).alias("event_id"), "op", F.lit("public").alias("schema"), F.lit("orders").alias("table"),
        F.when(F.col("op") == DELETE, key).alias("old_data"), F.when(F.col("op") != DELETE, image).alias("new_data"),
        F.array().cast("array<string>").alias("unchanged_toast"), lsn_of(pos).alias("lsn"), pos.cast("decimal(20,0)").alias("lsn_num"),
        F.lit(0).cast("bigint").alias("seq"), F.col("o_orderkey").alias("xid"), "ts",
    )


ORDER_LOG_SQL = """
olog AS (SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN op = 'INSERT' THEN 'O' ELSE o_orderstatus END AS status, op, o_orderkey * 4 + step AS pos
         FROM orders, (VALUES (0, 'INSERT'), (1, 'UPDATE'), (2, 'DELETE')) s(step, op)
         WHERE op <> 'DELETE' OR o_orderkey % 17 = 0)
"""
