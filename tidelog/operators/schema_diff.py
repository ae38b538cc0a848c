"""Schema changes from relation descriptions [C1-C12, C15, J4, J5]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATION = "relation_id long, lsn_num decimal(20,0), schema string, table string, identity string, columns array<struct<name:string,type_oid:long,type:string,key:boolean>>"
#: Names of common type ids.
TYPE_NAMES = {16: "bool", 17: "bytea", 20: "int8", 21: "int2", 23: "int4", 25: "text", 114: "json", 700: "float4", 701: "float8", 1042: "bpchar", 1043: "varchar", 1082: "date", 1083: "time", 1114: "timestamp", 1184: "timestamptz", 1186: "interval", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}


def type_name(oid: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, oid.cast("int")), F.concat(F.lit("oid:"), oid.cast("string")))


def _named(columns: Column, name: Column) -> Column:
    return F.get(F.filter(columns, lambda c: c["name"] == name), 0)


def changes(relations: DataFrame, final_lsn: Column | None = None) -> DataFrame:
    """One row for each description that differs from the one before it of the same relation id.

    added, dropped, retyped, previous names, identities and keys, ordered kinds, breaking and summary.
    Type modifiers are not compared; a rename of a column is a drop and an addition.
    """
    order = Window.partitionBy("relation_id").orderBy("lsn_num")
    before = F.lag(F.struct("schema", "table", "identity", "columns")).over(order)
    rows = relations.withColumn("p", before).where("p IS NOT NULL")
    cur, old = F.col("columns"), F.col("p.columns")
    key = lambda cs: F.transform(F.filter(cs, lambda c: c["key"]), lambda c: c["name"])
    rows = rows.select(
        "relation_id",
        "lsn_num" if final_lsn is None else F.coalesce(F.nullif(F.col("lsn_num"), F.lit(0).cast("decimal(20,0)")), final_lsn).alias("lsn_num"),
        "schema", "table", F.col("p.schema").alias("previous_schema"), F.col("p.table").alias("previous_table"),
        F.col("identity"), F.col("p.identity").alias("previous_identity"), key(cur).alias("key_now"), key(old).alias("key_before"),
        F.filter(cur, lambda c: ~F.exists(old, lambda o: o["name"] == c["name"])).alias("added"),
        F.filter(old, lambda o: ~F.exists(cur, lambda c: o["name"] == c["name"])).alias("dropped"),
        F.filter(F.transform(cur, lambda c: F.struct(c["name"].alias("name"), _named(old, c["name"])["type_oid"].alias("from_oid"), _named(old, c["name"])["type"].alias("from_type"), c["type_oid"].alias("to_oid"), c["type"].alias("to_type"))), lambda c: c["from_oid"].isNotNull() & (c["from_oid"] != c["to_oid"])).alias("retyped"),
    )
    renamed = (F.col("schema") != F.col("previous_schema")) | (F.col("table") != F.col("previous_table"))
    identity = F.col("identity") != F.col("previous_identity")
    kinds = F.array(
        F.when(renamed, F.lit("table_renamed")),
        F.when(F.size("added") > 0, F.lit("column_added")),
        F.when(F.size("dropped") > 0, F.lit("column_dropped")),
        F.when(F.size("retyped") > 0, F.lit("column_type_changed")),
        F.when(identity, F.lit("replica_identity_changed")).when(F.col("key_now") != F.col("key_before"), F.lit("key_changed")),
    )
    rows = rows.withColumn("kinds", F.filter(kinds, lambda k: k.isNotNull())).where(F.size("kinds") > 0)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ", ")
    parts = F.array(
        F.when(renamed, F.concat(F.lit("renamed from "), "previous_schema", F.lit("."), "previous_table")),
        F.when(F.size("added") > 0, F.concat(F.lit("added "), names("added"))),
        F.when(F.size("dropped") > 0, F.concat(F.lit("dropped "), names("dropped"))),
        F.when(F.size("retyped") > 0, F.array_join(F.transform("retyped", lambda x: F.concat(x["name"], F.lit(" "), x["from_type"], F.lit("->"), x["to_type"])), ", ")),
        F.when(identity, F.concat(F.lit("replica identity "), "previous_identity", F.lit("->"), "identity")).when(
            F.col("key_now") != F.col("key_before"), F.concat(F.lit("key ["), F.array_join("key_before", " "), F.lit("]->["), F.array_join("key_now", " "), F.lit("]"))
        ),
    )
    rows = rows.withColumn("summary", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; "))
    return rows.withColumn("breaking", F.exists("kinds", lambda k: k != "column_added"))


def notifications(found: DataFrame, prefix: str = "cdc") -> DataFrame:
    """(stream, table, lsn, breaking, payload) of changes(): what is published on <prefix>:schema; the payload is the change as JSON."""
    whole = F.struct("relation_id", F.col("lsn_num").cast("string").alias("lsn"), "schema", "table", "previous_schema", "previous_table", "identity", "previous_identity", "added", "dropped", "retyped", "kinds", "summary", "breaking")
    return found.select(F.lit(f"{prefix}:schema").alias("stream"), F.concat_ws(".", "schema", "table").alias("table"), F.col("lsn_num").cast("string").alias("lsn"), F.col("breaking").cast("string").alias("breaking"), F.to_json(whole).alias("payload"))


def with_relation(rows: DataFrame, relations: DataFrame, most_versions: int = 100_000) -> DataFrame:
    """Each row with the relation that was current at its position (as-of): versions become intervals.

    Descriptions are few; they are broadcast only if they are at most `most_versions`, else joined by id.
    """
    order = Window.partitionBy("relation_id").orderBy("lsn_num")
    versions = relations.withColumn("_to", F.lead("lsn_num").over(order)).withColumnsRenamed({"lsn_num": "_from", "relation_id": "_rid"})
    if versions.limit(most_versions + 1).count() <= most_versions:
        versions = F.broadcast(versions)
    hit = (F.col("relation_id") == F.col("_rid")) & (F.col("lsn_num") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("lsn_num") < F.col("_to")))
    return rows.join(versions, hit, "left").drop("_rid", "_from", "_to")


def with_transaction(frames: DataFrame, stream: str = "stream") -> DataFrame:
    """xid and commit time of the latest Begin before each frame of its stream (a log shard)."""
    order = Window.partitionBy(stream).orderBy("lsn_num", "seq").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("kind") == "B", F.struct("begin_xid", "commit_ts"))
    return frames.withColumn("_b", F.last(begun, ignorenulls=True).over(order)).withColumn("xid", F.col("_b.begin_xid")).withColumn("ts", F.col("_b.commit_ts")).drop("_b")
