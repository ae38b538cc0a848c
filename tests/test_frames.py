"""The decoder on hand-built frames, and stream equal to batch."""

import struct

import pytest

from tidelog.sources import frames as fr

USERS = [("id", 20, 1), ("name", 25, 0), ("body", 25, 0)]


def cstr(s):
    return s.encode() + b"\0"


def wal(payload, lsn=0, end=0):
    return b"w" + struct.pack(">QQq", lsn, end or lsn, 0) + payload


def keepalive(end, reply=0):
    return b"k" + struct.pack(">QqB", end, 0, reply)


def begin(final, xid):
    return wal(b"B" + struct.pack(">QqI", final, 86_400_000_000, xid), final)


def commit(end):
    return wal(b"C" + struct.pack(">BQQq", 0, end - 1, end, 0), end)


def relation(oid=1, schema="public", table="users", identity="d", columns=USERS, lsn=0):
    body = b"R" + struct.pack(">I", oid) + cstr(schema) + cstr(table) + identity.encode() + struct.pack(">H", len(columns))
    return wal(body + b"".join(struct.pack(">B", k) + cstr(n) + struct.pack(">Ii", t, -1) for n, t, k in columns), lsn)


def row(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v.encode())) + v.encode()
    return out


def insert(lsn, *values, oid=1):
    return wal(b"I" + struct.pack(">I", oid) + b"N" + row(*values), lsn)


def update(lsn, new, old=None, oid=1):
    return wal(b"U" + struct.pack(">I", oid) + (b"K" + row(*old) if old else b"") + b"N" + row(*new), lsn)


def test_rows():
    d = fr.Decoder()
    d.decode(begin(100, 7))
    assert d.decode(relation()).relation["columns"][0] == {"name": "id", "type_oid": 20, "type": "int8", "key": True}
    (e,) = d.decode(insert(90, "1", None, "x")).events
    assert (e["op"], e["new_data"], e["old_data"], e["event_id"], e["xid"], e["ts"].isoformat()) == ("INSERT", {"id": "1", "name": None, "body": "x"}, None, "0/5A", 7, "2000-01-02T00:00:00+00:00")
    (e,) = d.decode(update(91, ("1", "b", ...), ("1", None, None))).events
    assert e["new_data"] == {"id": "1", "name": "b"} and e["unchanged_toast"] == ["body"] and e["old_data"]["id"] == "1"
    (e,) = d.decode(wal(b"D" + struct.pack(">I", 1) + b"K" + row("1", None, None), 92)).events
    assert (e["op"], e["new_data"], e["old_data"]["id"]) == ("DELETE", None, "1")
    d.decode(relation(2, table="orders"))
    found = d.decode(wal(b"T" + struct.pack(">IBII", 2, 0, 1, 2), 93)).events
    assert [(e["event_id"], e["table"], e["op"]) for e in found] == [("0/5D-0", "users", "TRUNCATE"), ("0/5D-1", "orders", "TRUNCATE")]


def test_positions_are_confirmed_between_transactions():
    d = fr.Decoder()
    assert d.decode(keepalive(50)).ack == 50
    d.decode(begin(100, 7))
    got = d.decode(keepalive(60, 1))
    assert got.ack is None and got.server_end == 60 and got.reply
    assert d.decode(commit(101)).ack == 101 and d.decode(keepalive(102)).ack == 102


def test_rows_of_one_position_are_told_apart():
    d = fr.Decoder()
    d.decode(relation())
    ids = [d.decode(insert(90, str(i), None, None)).events[0] for i in range(3)]
    assert [(e["event_id"], e["seq"]) for e in ids] == [("0/5A", 0), ("0/5A#1", 1), ("0/5A#2", 2)]


def test_messages_and_errors():
    d = fr.Decoder()
    got = d.decode(wal(b"M" + struct.pack(">BQ", 0, 55) + cstr("wm") + struct.pack(">I", 2) + b"{}"))
    assert got.message == ("wm", b"{}", 55) and not got.events and got.ack is None
    with pytest.raises(fr.FrameError, match="not described"):
        d.decode(insert(1, "1", oid=9))
    with pytest.raises(fr.FrameError, match="in progress"):
        d.decode(wal(b"S" + struct.pack(">IB", 1, 1)))
    with pytest.raises(fr.FrameError, match="cut off"):
        d.decode(wal(b"B\0\0"))
    assert d.decode(b"x").events == [] and d.decode(b"").events == []
    assert d.decode(relation(3, columns=[("a", 999999, 0)])).relation["columns"][0]["type"] == "oid:999999"


def capture(path):
    fr.write_capture(path, "000", [relation(), begin(10, 1), insert(11, "1", "a", None), insert(12, "2", "b", None), commit(13), keepalive(14)])
    fr.write_capture(path, "001", [begin(20, 2), update(21, ("1", "c", ...)), commit(22), begin(30, 3), insert(31, "3", "z", None)])


def test_stream_equals_batch_and_waits_for_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    capture(path)
    fr.register(spark)
    whole = spark.read.format("cdc_frames").load(path).select("event_id", "op", "new_data").collect()
    assert len(whole) == 4

    def run():
        q = spark.readStream.format("cdc_frames").option("transactionsPerPartition", 1).load(path).select("event_id", "op", "new_data").writeStream
        q = q.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == sorted(map(str, whole[:3]))  # the last transaction is open
    fr.write_capture(path, "002", [commit(32)])
    assert run() == sorted(map(str, whole))


def test_ranges_resume_from_their_state(spark, tmp_path):
    """A described table is known to every range after it; a batch read is cut into as many tasks; old files aren't opened again."""
    path = str(tmp_path / "log")
    many = [relation(), *(f for i in range(1, 30) for f in (begin(i * 10, i), insert(i * 10 + 1, str(i), "a", None), commit(i * 10 + 2), keepalive(i * 10 + 3)))]
    fr.write_capture(path, "000", many[:61])
    fr.write_capture(path, "001", [*many[61:], relation(columns=USERS[:2]), begin(400, 40), insert(401, "40", "z"), commit(402)])
    fr.register(spark)
    rows = spark.read.format("cdc_frames").option("transactionsPerPartition", 7).load(path)
    assert rows.rdd.getNumPartitions() > 5
    got = {int(r.new_data["id"]): (r.xid, sorted(r.new_data), r.types["id"]) for r in rows.collect()}
    assert got == {i: (i, ["body", "id", "name"], 20) for i in range(1, 30)} | {40: (40, ["id", "name"], 20)}
    places = list(fr.boundaries(path, fr.Place()))
    middle = next(p for p in places if p.file == "001")
    assert [p.offset() for p in fr.boundaries(path, middle)] == [p.offset() for p in places[places.index(middle) + 1 :]]
    (tmp_path / "log" / "000").unlink()
    stream = fr._Stream(path, 5)
    stream.latest = middle
    assert stream.latestOffset() == places[-1].offset()
    ranges = stream.partitions(middle.offset(), places[-1].offset())
    assert max(int(r[5]["id"]) for p in ranges for r in stream.read(p)) == 40
    assert stream.partitions(places[-1].offset(), places[-1].offset()) == []
