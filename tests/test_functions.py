"""Filters, masks, keys, payloads: values worked out by hand or by Python's own library."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys, masks, payloads
from tidelog.functions.expressions import FilterError, compile_filter
from tidelog.model import EVENT, lsn_num, lsn_number, lsn_of, lsn_text


def event(spark, **values):
    row = {"event_id": "0/1A2B3C", "op": "UPDATE", "schema": "public", "table": "users", "unchanged_toast": [], "lsn": "0/1A2B3C", "seq": 0, "xid": 4242} | values
    return spark.createDataFrame([tuple(row.get(n) for n in EVENT.names)], EVENT)


def value(df, column):
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('op == "UPDATE"', True),
        ('op != "UPDATE"', False),
        ('new.status == "live"', True),
        ('"status" in new && new.status == "live"', True),
        ('"gone" in new && new.gone == "x"', False),
        ('new.gone == "x" && op == "INSERT"', False),  # the other side decides
        ('op == "UPDATE" || new.gone == "x"', True),
        ("new.note == null", True),
        ("new.status != null", True),
        ("old.age > 17 && old.age <= 18.0", True),
        ("-1 < 2", True),
        ("!(table in ['users', 'x'])", False),
        ('new["status"].startsWith("li") && new.status.endsWith("e") && new.status.contains("iv")', True),
        ('new.status.matches("^l.v")', True),
        ("size(new.status) == 4 && new.status.size() == 4 && size([1, 2]) == 2", True),
        ("has(new.status) && !has(new.gone)", True),
        ("new.flag == true", True),
        ('schema == "public" ? op == "UPDATE" : false', True),
        ("size(new) == 3 && old.age == 18", True),
        ('"it\\\'s" == "it\'s"', True),
    ],
)
def test_filter(spark, text, want):
    e = event(spark, new_data={"status": "live", "note": None, "flag": "t"}, old_data={"age": "18"})
    assert value(e, compile_filter(text)) is want


@pytest.mark.parametrize("text", ["", "new.x ==", 'op == "a', "op", "new.status", "nope == 1", "op == 1", "f(1)", "1 < 'a'", "(op == 'x'", "op == 'x')", "op.trim() == 'x'", "new in old", "!op", "null < 1"])
def test_filter_fails_early(text):
    with pytest.raises(FilterError):
        compile_filter(text)


@pytest.mark.parametrize("text", ['new.gone == "x"', 'op == "UPDATE" && new.gone == "x"', "new.status > 3"])
def test_filter_error_is_visible(spark, text):
    with pytest.raises(Exception, match="can't be evaluated"):
        event(spark, new_data={"status": "live"}).where(compile_filter(text)).collect()


def test_nil_rows_are_empty(spark):
    assert value(event(spark), compile_filter('!("a" in new) && size(old) == 0')) is True


def test_masks(spark):
    rows = spark.createDataFrame([("4111111111111111",), ("abcd",), ("",), ("Zoë€x",), (None,)], "v string")
    got = {s: [r[0] for r in rows.select(masks.mask(s, b"k" * 70)(F.col("v"))).collect()] for s in masks.STRATEGIES}
    texts = ["4111111111111111", "abcd", "", "Zoë€x"]
    assert got["redact"] == ["[REDACTED]"] * 4 + [None] and got["null"] == [None] * 5
    assert got["sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in texts] + [None]
    assert got["hmac256"] == [hmac.new(b"k" * 70, t.encode(), "sha256").hexdigest() for t in texts] + [None]
    assert got["last4"] == ["************1111", "****", "****", "*oë€x", None]
    for bad in ("rot13", "hmac256"):
        with pytest.raises(ValueError, match="strategy"):
            masks.mask(bad)


def test_mask_map_keeps_absent_and_null(spark):
    e = event(spark, new_data={"a": "1", "n": None, "z": "9"})
    got = value(e, masks.mask_map(F.col("new_data"), {"a": "redact", "n": "redact", "gone": "redact", "z": "null"}))
    assert got == {"a": "[REDACTED]", "n": None, "z": None}
    assert value(e, masks.drop_keys(F.col("new_data"), ["a", "gone"])) == {"n": None, "z": "9"}


def test_key_templates(spark):
    e = event(spark, new_data={"id": "7", "name": None}, old_data={"id": "6", "was": "x"})
    t = lambda p, prefix="app": value(e, keys.template(p, prefix))
    assert t("{{.Prefix}}:{{.Schema}}:{{.Table}}") == "app:public:users"
    assert t('{{.Operation}}/{{.ID}}/{{.Field "id"}}/{{ .Field "was" }}/{{.Field `name`}}/{{.Field "none"}}') == "UPDATE/0/1A2B3C/7/x/null/"
    assert t("{{.Prefix}}-x", '{{.Table}}{{.Prefix}}{{.Field "id"}}') == "users7-x"
    assert t("") == ""
    for bad in ("{{.Nope}}", "{{.Field}}", "{{.Field id}}", "{{.Table"):
        with pytest.raises(ValueError, match="key pattern"):
            keys.template(bad)
    assert value(e, keys.sanitize(F.lit("a.b*c> d\te\nf\rg"))) == "a.b_c__d_e_f_g"
    assert value(e, keys.canonical_key(F.col("new_data"), ["id", "name"])) == "7\x1fnull"
    assert value(e, keys.canonical_key(F.col("new_data"), ["id", "gone"])) is None


def test_payloads(spark):
    e = event(spark, new_data={"id": "7", "note": None}, unchanged_toast=["body"]).withColumn("ts", F.lit("2023-11-14 22:13:20").cast("timestamp"))
    body = json.loads(value(e, payloads.stream_payload()))
    assert body == {"operation": "UPDATE", "old_data": None, "new_data": {"id": "7", "note": None}, "unchanged_toast_columns": ["body"], "metadata": {"LSN": "0/1A2B3C", "TransactionID": 4242, "Timestamp": "2023-11-14T22:13:20Z"}}
    text = value(e, payloads.message_payload())
    message = json.loads(text)
    assert message["event_id"] == "0/1A2B3C" and message["table"] == "users" and message["metadata"] == {"lsn": "0/1A2B3C", "transaction_id": 4242, "timestamp": "2023-11-14T22:13:20Z"}
    rows = e.withColumn("body", payloads.message_payload())
    plain = value(rows, payloads.webhook_headers(F.col("body"), F.lit(1700000000)))
    assert plain == {"X-CDC-Event-Id": "0/1A2B3C", "X-CDC-Table": "public.users", "X-CDC-Operation": "UPDATE"}
    signed = value(rows, payloads.webhook_headers(F.col("body"), F.lit(1700000000), b"s"))
    assert signed["X-CDC-Signature"] == "sha256=" + hmac.new(b"s", f"1700000000.{text}".encode(), "sha256").hexdigest() and signed["X-CDC-Timestamp"] == "1700000000"


def test_merge_patch(spark):
    e = event(spark, old_data={"a": "1", "b": "2", "c": None}, new_data={"b": None, "d": "4", "a": "9"})
    assert value(e, payloads.merge_patch(F.col("old_data"), F.col("new_data"))) == {"c": None, "d": "4", "a": "9"}


@pytest.mark.parametrize("n", [0, 1, 0x1A2B3C, 0xFFFFFFFF, 1 << 32, (1 << 62) + 5])
def test_positions(spark, n):
    text = lsn_text(n)
    assert lsn_number(text) == n
    row = spark.range(1).select(lsn_of(F.lit(n).cast("long")).alias("t"), lsn_num(F.lit(text)).alias("n")).first()
    assert row.t == text and int(row.n) == n
    assert int(spark.range(1).select(lsn_num(F.lit("FFFFFFFF/FFFFFFFF"))).first()[0]) == (1 << 64) - 1


def test_filters_grow_in_step_with_their_text(spark):
    """One copy of each side: twenty && are as many conditions, nested conditions too."""
    import time

    rows = spark.createDataFrame([("1", {"a": "3", "b": "x"}), ("2", {"b": "y"})], "event_id string, new_data map<string,string>")
    rows = rows.selectExpr("event_id", "'INSERT' AS op", "'s' AS schema", "'t' AS table", "new_data", "cast(null as map<string,string>) AS old_data")
    long = " && ".join(f"(new.a > {i} || new.b == 'y')" for i in range(-20, 3))
    deep = "(" * 12 + "new.b == 'x'" + " || has(new.a))" * 12
    began = time.perf_counter()
    assert [r.event_id for r in rows.where(compile_filter(long)).collect()] == ["1", "2"]
    assert [r.event_id for r in rows.where(compile_filter(deep)).collect()] == ["1"]
    assert time.perf_counter() - began < 20
    assert len(str(rows.where(compile_filter(long))._jdf.queryExecution().analyzed())) < 40_000


@pytest.mark.parametrize(
    ("text", "want"),
    [("new.a + 1 == 4", True), ("new.a * 2 - 6 == 0 && -1 < 0", True), ("7 % 4 == new.a", True), ("new.a / 2 == 1.5", True), ("'p' + new.b == 'px'", True), ("2 + 2 * 2 == 6", True), ("(new.a > 2 ? new.a : 0) == 3", True), ("1 / 0 == 1 || new.a == 3", True), ("1 / 0 == 1", None), ("new.b + 1 == 2", None), ("(new.c == 1 ? 1 : 2) == 2", None)],
)
def test_arithmetic_in_filters(spark, text, want):
    rows = spark.createDataFrame([("1", {"a": "3", "b": "x"})], "event_id string, new_data map<string,string>")
    rows = rows.selectExpr("event_id", "'INSERT' AS op", "'s' AS schema", "'t' AS table", "new_data", "cast(null as map<string,string>) AS old_data")
    if want is None:
        with pytest.raises(Exception, match="can't be evaluated"):
            rows.where(compile_filter(text)).collect()
    else:
        assert (rows.where(compile_filter(text)).count() == 1) is want


@pytest.mark.parametrize("text", ["new.a + new.b == 1", "1 + 'a' == 1", "new.all(x, x > 1)", "true + 1 == 2", "duration('1s') > 1"])
def test_filters_that_are_refused(text):
    with pytest.raises(FilterError):
        compile_filter(text)
