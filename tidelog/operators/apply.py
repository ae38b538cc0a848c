"""Current state from a change log [K2-K4]: one aggregate by key, no window, no sort.

Each column keeps its latest shipped value with its position; the latest reset (a row that replaces
the whole document) tells which of them still count. Both are maxima, so they are combined on the map
side and a hot key costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical_key
from ..model import DELETE, INSERT, READ, TRUNCATE, UPDATE

FULL_SET = "full_set"  # an UPDATE without omitted columns replaces the document
PARTIAL = "partial"  # every UPDATE is a partial one, as for a search index


def resets(op: Column, omitted: Column, flavour: str) -> Column:
    whole = op.isin(INSERT, READ, DELETE)
    return whole | ((op == UPDATE) & ~omitted) if flavour == FULL_SET else whole


def merge_apply(log: DataFrame, key: list[str], columns: list[str], shipped: dict[str, Column] | None = None, omitted: Column | None = None, order: str = "pos", flavour: str = FULL_SET) -> DataFrame:
    """Typed logs: the live keys with their columns, `last_pos` and `changes`.

    shipped[c] says whether a row ships column c (default: all but DELETEs do). A column that nothing
    shipped since the last reset is null.
    """
    shipped, omitted = shipped or {}, F.lit(False) if omitted is None else omitted
    op, pos = F.col("op"), F.col(order)
    last = [F.max(F.when((op != DELETE) & shipped.get(c, F.lit(True)), F.struct(pos.alias("at"), F.col(c).alias("v")))).alias(f"_{c}") for c in columns]
    state = log.groupBy(*key).agg(
        F.max(F.struct(pos.alias("at"), op.alias("op"))).alias("_last"),
        F.max(F.when(resets(op, omitted, flavour), pos)).alias("_reset"),
        F.count("*").alias("changes"),
        *last,
    )
    state = state.where(F.col("_last.op") != DELETE)
    kept = [F.when(F.coalesce(F.col(f"_{c}.at") >= F.col("_reset"), F.lit(True)), F.col(f"_{c}.v")).alias(c) for c in columns]
    return state.select(*key, *kept, F.col("_last.at").alias("last_pos"), "changes")


def latest_operation(log: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    last = log.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("at"), "op")).alias("l"))
    return last.select(*key, F.col("l.at").alias("last_pos"), F.col("l.op").alias("last_op"))


def documents(events: DataFrame, key: Column, flavour: str = FULL_SET) -> DataFrame:
    """Schemaless mirror of change events: (doc_key, document map, lsn_num) of every live document.

    A full SET stores nulls; a merge removes them (RFC 7386). TRUNCATE is ignored by the mirror and
    resets every document of its table in the index flavour. Rows without data or key are skipped.
    Fields are aggregated one by one, so no key's history is ever gathered in memory.
    """
    order = F.struct("lsn_num", "seq")
    rows = events.withColumn("_order", order)
    if flavour == PARTIAL:
        cut = events.where(F.col("op") == TRUNCATE).groupBy(F.col("schema").alias("_s"), F.col("table").alias("_t")).agg(F.max(order).alias("_cut"))
        rows = rows.join(cut, (F.col("schema") == F.col("_s")) & (F.col("table") == F.col("_t")), "left").where(F.col("_cut").isNull() | (F.col("_order") > F.col("_cut"))).drop("_s", "_t", "_cut")
    rows = rows.where(F.col("op") != TRUNCATE).withColumn("doc_key", key)
    data = F.when(F.col("op") == DELETE, F.col("old_data")).otherwise(F.col("new_data"))
    rows = rows.where(data.isNotNull() & F.col("doc_key").isNotNull())
    omitted = F.size("unchanged_toast") > 0
    reset = resets(F.col("op"), omitted, flavour)
    rows = rows.withColumn("_reset", reset)
    state = rows.groupBy("doc_key").agg(F.max(F.struct(F.col("_order").alias("at"), "op")).alias("last"), F.max(F.when(F.col("_reset"), F.col("_order"))).alias("since"))
    state = state.where(F.col("last.op") != DELETE)
    fields = rows.where(F.col("op") != DELETE).select("doc_key", "_order", "_reset", F.explode("new_data").alias("name", "value"))
    latest = fields.groupBy("doc_key", "name").agg(F.max(F.struct(F.col("_order").alias("at"), F.col("_reset").alias("whole"), "value")).alias("f"))
    alive = latest.join(state, "doc_key").where(F.col("since").isNull() | (F.col("f.at") >= F.col("since")))
    alive = alive.where(F.col("f.whole") | F.col("f.value").isNotNull())
    built = alive.groupBy("doc_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "f.value"))).alias("document"))
    return state.join(built, "doc_key", "left").select("doc_key", "document", F.col("last.at.lsn_num").alias("lsn_num"))


def row_key(columns: list[str]) -> Column:
    """A document key from the row's key columns: of the new row, or of the old one for a DELETE."""
    return F.when(F.col("op") == DELETE, canonical_key(F.col("old_data"), columns)).otherwise(canonical_key(F.col("new_data"), columns))


def move_keys(events: DataFrame, columns: list[str]) -> DataFrame:
    """Option: an UPDATE that changes the key becomes a DELETE of the old key and an INSERT of the new one."""
    before, after = canonical_key(F.col("old_data"), columns), canonical_key(F.col("new_data"), columns)
    moved = (F.col("op") == UPDATE) & before.isNotNull() & after.isNotNull() & (before != after)
    steps = F.when(moved, F.array(F.lit(DELETE), F.lit(INSERT))).otherwise(F.array(F.col("op")))
    rows = events.withColumn("_moved", moved).select("*", F.posexplode(steps).alias("_i", "_op"))
    out = rows.withColumn("op", F.col("_op")).withColumn("seq", F.col("seq") * 2 + F.col("_i"))
    out = out.withColumn("new_data", F.when(F.col("_moved") & (F.col("_op") == DELETE), F.lit(None)).otherwise(F.col("new_data")))
    return out.drop("_moved", "_i", "_op")
