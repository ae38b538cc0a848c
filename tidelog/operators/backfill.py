"""Lock-free snapshot backfill [S10-S12, J1-J3, F9-F11, T12-T23]: chunks, watermarks, superseded rows, progress."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical_key
from ..model import EVENT, READ, TRUNCATE

WATERMARK = "slot string, chunk string, mark string"


def page(table: DataFrame, key: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next rows by key after the cursor: a row-value comparison and a top-n, never a full sort."""
    rows = table
    if cursor is not None:
        after = F.struct(*(F.col(k) for k in key)) > F.struct(*(F.lit(v).cast(table.schema[k].dataType).alias(k) for k, v in zip(key, cursor, strict=True)))
        first = F.col(key[0]) >= F.lit(cursor[0])  # reaches the scan
        rows = rows.where(first & after)
    return rows.orderBy(*key).limit(limit)


def watermarks(messages: DataFrame, slot: str) -> DataFrame:
    """(lsn_num, chunk, mark) of this slot's watermark messages; foreign slots and bad content are ignored."""
    mark = F.from_json(F.col("content").cast("string"), WATERMARK)
    rows = messages.select("lsn_num", mark.alias("m"))
    return rows.where((F.col("m.slot") == slot) & F.col("m.mark").isin("low", "high")).select("lsn_num", F.col("m.chunk").alias("chunk"), F.col("m.mark").alias("mark"))


def windows(marks: DataFrame) -> DataFrame:
    """(chunk, low, high) of every chunk whose two marks were seen in order."""
    pair = lambda m: F.max(F.when(F.col("mark") == m, F.col("lsn_num")))
    return marks.groupBy("chunk").agg(pair("low").alias("low"), pair("high").alias("high")).where("low < high")


def seen_keys(events: DataFrame, schema: str, table: str, key: list[str], low: Column, high: Column) -> DataFrame:
    """Keys of the table that changed strictly between the marks, old and new ones, and whether it was truncated.

    Events with a `chunk` keep it; the marks may then be columns too.
    """
    rows = events.where((F.col("schema") == schema) & (F.col("table") == table) & (F.col("lsn_num") > low) & (F.col("lsn_num") < high))
    more = ["chunk"] if "chunk" in events.columns else []
    keys = F.array(canonical_key(F.col("new_data"), key), canonical_key(F.col("old_data"), key))
    return rows.select(*more, (F.col("op") == TRUNCATE).alias("truncated"), F.explode(F.when(F.col("op") == TRUNCATE, F.array(F.lit(""))).otherwise(F.filter(keys, lambda k: k.isNotNull()))).alias("key")).distinct()


def supersede(chunk: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """Chunk rows that no change overtook: an anti join; a truncate in the window overtakes all."""
    truncated = seen.where("truncated").limit(1).select(F.lit(1).alias("_t"))
    left = chunk.join(seen.where(~F.col("truncated")).select(key), key, "left_anti")
    return left.join(truncated, F.lit(True), "left_anti")


def supersede_chunks(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """The same for many chunks at once: rows and seen keys carry their `chunk`, and only meet inside it."""
    cut = seen.where("truncated").select("chunk").distinct()
    left = rows.join(seen.where(~F.col("truncated")).select("chunk", "key"), ["chunk", "key"], "left_anti")
    return left.join(cut, "chunk", "left_anti")


def superseded_counts(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """chunk, rows, superseded, delivered of many chunks."""
    left = supersede_chunks(rows, seen).groupBy("chunk").agg(F.count("*").alias("delivered"))
    both = rows.groupBy("chunk").agg(F.count("*").alias("rows")).join(left, "chunk", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    return both.select("chunk", "rows", (F.col("rows") - F.col("delivered")).alias("superseded"), "delivered")


def superseded_count(chunk: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """rows, superseded, delivered of a chunk."""
    hit = chunk.join(seen.where(~F.col("truncated")).select(key).withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("rows"), F.count("_hit").alias("superseded"), (F.count("*") - F.count("_hit")).alias("delivered"))


def read_events(rows: DataFrame, schema: str, table: str, columns: list[str], high_lsn: Column, high: Column, key: str = "key") -> DataFrame:
    """READ events at the high mark. The id is bf:<table>:<key>, the same on every attempt."""
    data = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
    made = rows.select(
        F.concat(F.lit(f"bf:{schema}.{table}:"), F.col(key)).alias("event_id"), F.lit(READ).alias("op"), F.lit(schema).alias("schema"), F.lit(table).alias("table"),
        F.lit(None).cast("map<string,string>").alias("old_data"), data.alias("new_data"), F.array().cast("array<string>").alias("unchanged_toast"),
        high_lsn.alias("lsn"), high.cast("decimal(20,0)").alias("lsn_num"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("xid"), F.current_timestamp().alias("ts"),
    )
    return made.select(*EVENT.names)


def pending(published: DataFrame, progress: DataFrame, excluded: Iterable[str], state_table: str = "") -> DataFrame:
    """Tables to enqueue: published, not excluded, not the state table, not done, running or queued; by name."""
    names = sorted({*excluded, *([state_table] if state_table else [])})
    rows = published.where(~(F.concat_ws(".", "schema", "table").isin(*names) | F.col("table").isin(*names))) if names else published
    busy = progress.where(F.col("state").isin("done", "running", "pending")).select("schema", "table")
    return rows.join(busy, ["schema", "table"], "left_anti").orderBy("schema", "table")


def primary_keys(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_id, columns) in key order, from catalog rows (table_id, is_primary, attnum array) and (table_id, attnum, name)."""
    keys = indexes.where("is_primary").select("table_id", F.posexplode("attnums").alias("at", "attnum"))
    named = keys.join(attributes, ["table_id", "attnum"]).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("k"))
    return named.select("table_id", F.transform("k", lambda x: x["name"]).alias("columns"))


def without_identity(tables: DataFrame, primary: DataFrame, shown: int = 5) -> DataFrame:
    """Tables with the default identity and no primary key: their number and the first names."""
    rows = tables.where("identity = 'd'").join(primary.select("table_id"), "table_id", "left_anti")
    return rows.agg(F.count("*").alias("n_tables"), F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, shown), ", ").alias("first_names"))
