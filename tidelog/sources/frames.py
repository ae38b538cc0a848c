"""Replication frames [S1, S7, S8, D1-D15]: the pgoutput binary protocol as rows, batch and streaming.

A capture is a folder of files; each holds length-prefixed (4 bytes, big-endian) copy-data frames in
log order, files in the order of their names. Decoding carries relation and transaction state. Planning walks
the frames' heads (of descriptions, begins and commits the whole frame) and cuts the capture between
transactions; each range is decoded by a task of its own, from the state at its start. A stream's offset
is a file, a place in it and that state, so what a batch committed is never read again. The folder has to be
one that the driver and all executors share. decode() takes frames as rows instead, many logs side by side.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..model import DELETE, EVENT_TYPED, INSERT, TRUNCATE, UPDATE, lsn_text
from ..operators.schema_diff import TYPE_NAMES

_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


class FrameError(ValueError):
    pass


@dataclass
class Relation:
    relation_id: int
    schema: str
    table: str
    identity: str
    columns: list[tuple[str, int, bool]]  # name, type id, part of the key

    def row(self, lsn: int) -> dict:
        columns = [{"name": n, "type_oid": o, "type": TYPE_NAMES.get(o, f"oid:{o}"), "key": k} for n, o, k in self.columns]
        return {"relation_id": self.relation_id, "lsn_num": Decimal(lsn), "schema": self.schema, "table": self.table, "identity": self.identity, "columns": columns}


@dataclass
class Decoded:
    """What one frame gave."""

    events: list[dict] = field(default_factory=list)
    relation: dict | None = None
    message: tuple[str, bytes, int] | None = None
    ack: int | None = None
    server_end: int | None = None
    reply: bool = False


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise FrameError("frame is cut off")
        (out,) = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FrameError("frame is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FrameError("string is not ended")
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out


@dataclass
class Decoder:
    """State of one log: relations by id and the open transaction."""

    relations: dict[int, Relation] = field(default_factory=dict)
    open: bool = False
    xid: int = 0
    final: int = 0
    committed: datetime = _EPOCH
    last: tuple[int, int] = (-1, -1)

    def decode(self, frame: bytes) -> Decoded:
        if not frame:
            return Decoded()
        r = _Reader(frame)
        kind = r.take(">c")
        if kind == b"k":
            end, _, reply = r.take(">Q"), r.take(">q"), r.take(">B")
            # a position is confirmed only between transactions
            return Decoded(ack=None if self.open else end, server_end=end, reply=bool(reply))
        if kind != b"w":
            return Decoded()
        start, end, _ = r.take(">Q"), r.take(">Q"), r.take(">q")
        out = self._change(start, r)
        out.server_end = end
        return out

    def _change(self, lsn: int, r: _Reader) -> Decoded:
        kind = r.take(">c").decode("latin-1")
        if kind == "B":
            self.final, micros, self.xid = r.take(">Q"), r.take(">q"), r.take(">I")
            self.committed, self.open = _EPOCH + timedelta(microseconds=micros), True
            return Decoded()
        if kind == "C":
            r.take(">B"), r.take(">Q")
            self.open = False
            return Decoded(ack=r.take(">Q"))
        if kind == "R":
            rel = Relation(r.take(">I"), r.text() or "pg_catalog", r.text(), r.take(">c").decode("latin-1"), [])
            for _ in range(r.take(">H")):
                flags, name, oid, _ = r.take(">B"), r.text(), r.take(">I"), r.take(">i")
                rel.columns.append((name, oid, bool(flags & 1)))
            self.relations[rel.relation_id] = rel
            return Decoded(relation=rel.row(lsn or self.final))
        if kind == "I":
            rel = self._relation(r)
            self._expect(r, b"N")
            return Decoded([self._event(lsn, INSERT, rel, None, self._tuple(r, rel))])
        if kind == "U":
            rel, old = self._relation(r), None
            mark = r.take(">c")
            if mark in (b"K", b"O"):
                old = self._tuple(r, rel)
                mark = r.take(">c")
            if mark != b"N":
                raise FrameError("an update holds no new row")
            return Decoded([self._event(lsn, UPDATE, rel, old, self._tuple(r, rel))])
        if kind == "D":
            rel = self._relation(r)
            if r.take(">c") not in (b"K", b"O"):
                raise FrameError("a delete holds no old row")
            return Decoded([self._event(lsn, DELETE, rel, self._tuple(r, rel), None)])
        if kind == "T":
            many, _ = r.take(">I"), r.take(">B")
            return Decoded([self._event(lsn, TRUNCATE, self._known(r.take(">I")), None, None, f"-{i}") for i in range(many)])
        if kind == "M":
            flags, at = r.take(">B"), r.take(">Q")
            del flags
            prefix = r.text()
            return Decoded(message=(prefix, r.raw(r.take(">I")), at))
        if kind in "SEcA":
            raise FrameError("transactions in progress are never asked for")
        return Decoded()  # origins, types and what later versions add

    def _known(self, relation_id: int) -> Relation:
        if relation_id not in self.relations:
            raise FrameError(f"relation {relation_id} was not described")
        return self.relations[relation_id]

    def _relation(self, r: _Reader) -> Relation:
        return self._known(r.take(">I"))

    def _expect(self, r: _Reader, mark: bytes) -> None:
        if r.take(">c") != mark:
            raise FrameError(f"expected row mark {mark!r}")

    def _tuple(self, r: _Reader, rel: Relation) -> tuple[dict, list[str]]:
        data, omitted = {}, []
        for i in range(r.take(">H")):
            kind = r.take(">c")
            name = rel.columns[i][0] if i < len(rel.columns) else f"column_{i}"
            if kind == b"n":
                data[name] = None
            elif kind == b"u":
                omitted.append(name)
            elif kind in (b"t", b"b"):
                data[name] = r.raw(r.take(">i")).decode("utf-8", "replace")
            else:
                raise FrameError(f"unknown value kind {kind!r}")
        return data, omitted

    def _event(self, lsn: int, op: str, rel: Relation, old, new, suffix: str = "") -> dict:
        """Rows that share a position are told apart by seq, and by the id's suffix from the second on."""
        seq = self.last[1] + 1 if self.last[0] == lsn else 0
        self.last = (lsn, seq)
        text = lsn_text(lsn)
        event_id = text + (suffix or (f"#{seq}" if seq else ""))
        return {
            "event_id": event_id, "op": op, "schema": rel.schema, "table": rel.table, "old_data": old[0] if old else None, "new_data": new[0] if new else None,
            "unchanged_toast": new[1] if new else [], "lsn": text, "lsn_num": Decimal(lsn), "seq": seq, "xid": self.xid, "ts": self.committed,
            "types": {n: oid for n, oid, _ in rel.columns},
        }


#: What decode() returns for each frame that gave something; kind is event, relation, message, status or error.
DECODED = (
    "log string, seq long, kind string, event " + EVENT_TYPED.simpleString() + ", relation struct<relation_id:bigint,lsn_num:decimal(20,0),schema:string,table:string,identity:string,"
    "columns:array<struct<name:string,type_oid:bigint,type:string,key:boolean>>>, message struct<prefix:string,content:binary,lsn:bigint>, ack decimal(20,0), server_end decimal(20,0), reply boolean, error string"
)


def decode(rows: DataFrame, fail: bool = True) -> DataFrame:
    """Frames of many logs, as rows (log, seq, frame), decoded: each log in its order by one task, logs side by side.

    A frame that can't be decoded is an error: raised, or with fail=False a row of kind error; decoding goes on behind it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(DECODED))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, decoder = None, Decoder()
        for b in batches:
            out = []
            for name, seq, frame in zip(*(b.column(c).to_pylist() for c in ("log", "seq", "frame")), strict=True):
                if name != log:
                    log, decoder = name, Decoder()
                row = {"log": name, "seq": seq}
                try:
                    got = decoder.decode(frame or b"")
                except FrameError as e:
                    if fail:
                        raise
                    out.append(row | {"kind": "error", "error": str(e)})
                    continue
                for e in got.events:
                    maps = {k: None if e[k] is None else list(e[k].items()) for k in ("old_data", "new_data", "types")}
                    out.append(row | {"kind": "event", "event": e | maps})
                if got.relation:
                    out.append(row | {"kind": "relation", "relation": got.relation})
                if got.message:
                    out.append(row | {"kind": "message", "message": dict(zip(("prefix", "content", "lsn"), got.message, strict=True))})
                if got.ack is not None or got.server_end is not None:
                    ends = [None if x is None else Decimal(x) for x in (got.ack, got.server_end)]
                    out.append(row | {"kind": "status", "ack": ends[0], "server_end": ends[1], "reply": got.reply})
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    dealt = rows.select("log", "seq", "frame").repartition("log").sortWithinPartitions("log", "seq")
    return dealt.mapInArrow(run, DECODED)


def events(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'event'").select("log", "event.*")


def progress(decoded: DataFrame) -> DataFrame:
    """(log, acked, server_end, lag) of each log: the highest confirmed position, and how far the server is ahead of it, never negative."""
    per = decoded.where("kind = 'status'").groupBy("log").agg(F.max("ack").alias("acked"), F.max("server_end").alias("server_end"))
    lag = F.col("server_end") - F.coalesce("acked", F.lit(0).cast("decimal(20,0)"))
    return per.withColumn("lag", F.greatest(lag, F.lit(0).cast("decimal(21,0)")))


def frames(path: str) -> Iterator[bytes]:
    """Frames of a capture; a frame that the last file doesn't hold whole yet is left for later."""
    for name in sorted(os.listdir(path)):
        if name.startswith((".", "_")):
            continue
        with open(os.path.join(path, name), "rb") as f:
            data = f.read()
        at = 0
        while at + 4 <= len(data):
            (n,) = struct.unpack_from(">I", data, at)
            if at + 4 + n > len(data):
                break
            yield data[at + 4 : at + 4 + n]
            at += 4 + n


def write_capture(path: str, name: str, many: list[bytes]) -> None:
    os.makedirs(path, exist_ok=True)
    tmp = os.path.join(path, f".{name}")
    with open(tmp, "wb") as f:
        f.write(b"".join(struct.pack(">I", len(x)) + x for x in many))
    os.replace(tmp, os.path.join(path, name))


def _row(event: dict) -> tuple:
    return tuple(event[name] for name in EVENT_TYPED.names)


@dataclass
class Place:
    """Between two transactions of a capture: a file, a place in it, and the relations that were described before."""

    file: str = ""
    at: int = 0
    state: str = "[]"

    def decoder(self) -> Decoder:
        return Decoder({r[0]: Relation(*r[:4], [(n, o, k) for n, o, k in r[4]]) for r in json.loads(self.state)})

    def offset(self) -> dict:
        return {"file": self.file, "at": self.at, "state": self.state}

    @classmethod
    def after(cls, file: str, at: int, decoder: Decoder) -> Place:
        return cls(file, at, json.dumps([[r.relation_id, r.schema, r.table, r.identity, r.columns] for r in decoder.relations.values()]))


def _files(path: str, first: str) -> list[str]:
    return [n for n in sorted(os.listdir(path)) if not n.startswith((".", "_")) and n >= first]


def boundaries(path: str, start: Place, stop: Place | None = None) -> Iterator[Place]:
    """Every place between transactions after `start`, up to `stop`; row changes are passed over unread."""
    decoder = start.decoder()
    for name in _files(path, start.file):
        at, size = start.at if name == start.file else 0, os.path.getsize(os.path.join(path, name))
        with open(os.path.join(path, name), "rb") as f:
            while at + 4 <= size:
                if stop is not None and (name, at) >= (stop.file, stop.at):
                    return
                f.seek(at)
                head = f.read(4 + 26)
                (n,) = struct.unpack_from(">I", head)
                if at + 4 + n > size:
                    break  # not written whole yet
                at += 4 + n
                if head[4:5] == b"w" and head[29:30] in (b"R", b"B", b"C"):
                    f.seek(at - n)
                    decoder.decode(f.read(n))
                if not decoder.open:
                    yield Place.after(name, at, decoder)


def frames_between(path: str, start: Place, stop: Place) -> Iterator[bytes]:
    for name in _files(path, start.file):
        at, size = start.at if name == start.file else 0, os.path.getsize(os.path.join(path, name))
        with open(os.path.join(path, name), "rb") as f:
            f.seek(at)
            while at + 4 <= size and (name, at) < (stop.file, stop.at):
                (n,) = struct.unpack(">I", f.read(4))
                if at + 4 + n > size:
                    break
                yield f.read(n)
                at += 4 + n
        if name >= stop.file:
            return


class _Range(InputPartition):
    def __init__(self, start: Place, stop: Place):
        self.start, self.stop = start, stop


def _ranges(path: str, start: Place, stop: Place | None, every: int) -> list[_Range]:
    """Cuts after each so many transactions."""
    out, last, n = [], start, 0
    place = start
    for place in boundaries(path, start, stop):
        n += 1
        if n == every:
            out.append(_Range(last, place))
            last, n = place, 0
    if n:
        out.append(_Range(last, place))
    return out


class _Reads:
    path: str

    def read(self, partition: _Range) -> Iterator[tuple]:
        decoder = partition.start.decoder()
        for frame in frames_between(self.path, partition.start, partition.stop):
            for e in decoder.decode(frame).events:
                yield _row(e)


class _Batch(_Reads, DataSourceReader):
    def __init__(self, path: str, every: int):
        self.path, self.every = path, every

    def partitions(self) -> list[InputPartition]:
        """All whole transactions, and what an open one at the end holds so far."""
        out = _ranges(self.path, Place(), None, self.every)
        last = out[-1].stop if out else Place()
        return [*out, _Range(last, Place("\uffff"))]


class _Stream(_Reads, DataSourceStreamReader):
    def __init__(self, path: str, every: int):
        self.path, self.every, self.latest = path, every, Place()

    def initialOffset(self) -> dict:
        return Place().offset()

    def latestOffset(self) -> dict:
        """The end of the last whole transaction; found from where the last call left off."""
        for place in boundaries(self.path, self.latest):
            self.latest = place
        return self.latest.offset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(self.path, Place(**start), Place(**end), self.every)

    def commit(self, end: dict) -> None:
        """Nothing to release: the capture stays, the checkpoint remembers the place."""


class FrameSource(DataSource):
    """spark.read / spark.readStream .format("cdc_frames").load(path); option transactionsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "cdc_frames"

    def schema(self) -> StructType:
        return EVENT_TYPED

    def _every(self) -> int:
        return int(self.options.get("transactionsPerPartition", "10000"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], self._every())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._every())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
