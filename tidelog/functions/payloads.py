"""Wire forms of an event [P16, section 1.6]: what each kind of sink sends. Null members are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}
_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _metadata(lsn: str, xid: str, ts: str) -> Column:
    return F.struct(F.col("lsn").alias(lsn), F.col("xid").alias(xid), F.date_format("ts", _TIME).alias(ts))


#: Type ids whose text is not sent as a string.
BOOL, BYTEA, INT8, INT2, INT4, JSON, FLOAT4, FLOAT8, DATE, TIMESTAMP, TIMESTAMPTZ, JSONB = 16, 17, 20, 21, 23, 114, 700, 701, 1082, 1114, 1184, 3802


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def typed_value(text: Column, oid: Column) -> Column:
    """A column's text as JSON by its type id: booleans, integers, finite floats and JSON as such, times in ISO 8601,
    bytes in base64; uuid, numeric, unknown types and what can't be read stay strings."""
    day, clock = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d(?:\.\d+)?"
    at = F.regexp_replace(text, " ", "T")
    zoned = F.regexp_replace(F.regexp_replace(at, r"([+-]\d\d)$", "$1:00"), r"[+-]00:00$", "Z")
    return (
        F.when(text.isNull(), F.lit("null"))
        .when((oid == BOOL) & text.isin("t", "f"), F.when(text == "t", F.lit("true")).otherwise(F.lit("false")))
        .when(oid.isin(INT2, INT4, INT8) & F.regexp_like(text, F.lit(r"^(0|-?[1-9]\d*)$")), text)
        .when(oid.isin(FLOAT4, FLOAT8) & F.regexp_like(text, F.lit(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")), text)
        .when(oid.isin(JSON, JSONB) & F.try_parse_json(text).isNotNull(), text)
        .when((oid == DATE) & F.regexp_like(text, F.lit(f"^{day}$")), quoted(F.concat(text, F.lit("T00:00:00Z"))))
        .when((oid == TIMESTAMP) & F.regexp_like(text, F.lit(f"^{day} {clock}$")), quoted(F.concat(at, F.lit("Z"))))
        .when((oid == TIMESTAMPTZ) & F.regexp_like(text, F.lit(f"^{day} {clock}[+-]\\d\\d(:\\d\\d)?$")), quoted(zoned))
        .when((oid == BYTEA) & F.regexp_like(text, F.lit(r"^\\x([0-9a-f]{2})*$")), quoted(F.base64(F.unhex(F.substring(text, F.lit(3), F.length(text))))))
        .otherwise(quoted(text))
    )


def typed_row(data: Column, types: Column) -> Column:
    """A row as a JSON object with typed values, columns by name; null for no row."""
    each = F.transform(F.array_sort(F.map_keys(data)), lambda k: F.concat(quoted(k), F.lit(":"), typed_value(F.element_at(data, k), F.coalesce(F.element_at(types, k), F.lit(0)))))
    return F.when(data.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}")))


def _typed(members: dict[str, Column]) -> Column:
    """A JSON object of members that are JSON already."""
    parts = [x for i, (name, value) in enumerate(members.items()) for x in (F.lit(f'{"," if i else "{"}"{name}":'), value)]
    return F.concat(*parts, F.lit("}"))


def _rows() -> dict[str, Column]:
    toast = F.coalesce(F.to_json("unchanged_toast"), F.lit("null"))
    return {"old_data": typed_row(F.col("old_data"), F.col("types")), "new_data": typed_row(F.col("new_data"), F.col("types")), "unchanged_toast_columns": toast}


def typed_stream_payload() -> Column:
    """stream_payload of events with `types`: values by their types."""
    return _typed({"operation": quoted(F.col("op")), **_rows(), "metadata": F.to_json(_metadata("LSN", "TransactionID", "Timestamp"), KEEP_NULLS)})


def typed_message_payload() -> Column:
    """message_payload of events with `types`: values by their types."""
    head = {"event_id": quoted(F.col("event_id")), "operation": quoted(F.col("op")), "schema": quoted(F.col("schema")), "table": quoted(F.col("table"))}
    return _typed(head | _rows() | {"metadata": F.to_json(_metadata("lsn", "transaction_id", "timestamp"), KEEP_NULLS)})


def stream_payload() -> Column:
    """For append logs: neither schema nor table inside, metadata with capital keys."""
    body = F.struct(F.col("op").alias("operation"), "old_data", "new_data", F.col("unchanged_toast").alias("unchanged_toast_columns"), _metadata("LSN", "TransactionID", "Timestamp").alias("metadata"))
    return F.to_json(body, KEEP_NULLS)


def message_payload() -> Column:
    """For web hooks and message buses: with id, schema and table, metadata with small keys."""
    body = F.struct(
        "event_id", F.col("op").alias("operation"), "schema", "table", "old_data", "new_data", F.col("unchanged_toast").alias("unchanged_toast_columns"), _metadata("lsn", "transaction_id", "timestamp").alias("metadata")
    )
    return F.to_json(body, KEEP_NULLS)


def webhook_headers(body: Column, timestamp: Column, secret: bytes | None = None, vendor: str = "CDC") -> Column:
    """Headers as a map; timestamp and signature only if requests are signed."""
    from .masks import signature
    from ..model import full_name

    pairs = [F.lit(f"X-{vendor}-Event-Id"), F.col("event_id"), F.lit(f"X-{vendor}-Table"), full_name(), F.lit(f"X-{vendor}-Operation"), F.col("op")]
    if secret:
        pairs += [F.lit(f"X-{vendor}-Timestamp"), timestamp.cast("string"), F.lit(f"X-{vendor}-Signature"), signature(body, timestamp.cast("string"), secret)]
    return F.create_map(*pairs)


def merge_patch(target: Column, patch: Column) -> Column:
    """RFC 7386 on flat objects: a null member of the patch deletes, others replace or add."""
    kept = F.map_filter(target, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))
