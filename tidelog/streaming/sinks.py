"""Sinks over files and HTTP [K1, K2, K4-K7, K9]: idempotent by batch, so a replayed batch changes nothing."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import message_payload, stream_payload, typed_message_payload, typed_stream_payload, webhook_headers
from ..functions.keys import field
from ..model import full_name
from ..operators.apply import FULL_SET
from ..operators.dedupe import once_in_window
from .delivery import EventsFailed


class _Base:
    name = ""

    def initialize(self) -> None:
        """Nothing to prepare."""

    def healthy(self) -> bool:
        return True

    def shutdown(self) -> None:
        """Nothing to release."""


class AppendLog(_Base):
    """(key, event_id, payload) rows appended as Parquet, one folder a batch: a replay overwrites its own."""

    def __init__(self, path: str, key: Column, payload: Column | None = None, name: str = "stream", most: int | None = None):
        self.name, self.path, self.key, self.payload, self.most = name, path, key, payload, most

    def body(self, events: DataFrame) -> Column:
        """What is written of an event: typed values where the events carry their columns' types."""
        return self.payload if self.payload is not None else typed_stream_payload() if "types" in events.columns else stream_payload()

    def process(self, events: DataFrame, batch: int) -> None:
        rows = events.select(self.key.alias("key"), "event_id", self.body(events).alias("payload"), "lsn_num", "seq")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """What is kept: the newest entries of each key, as many as the sink keeps or as `most` says."""
        from ..operators.stats import last_rows

        most = most or self.most
        rows = spark.read.parquet(self.path)
        return last_rows(rows.withColumn("_o", F.struct("lsn_num", "seq")), "_o", most, ["key"]).drop("_o") if most else rows


class MessageBus(AppendLog):
    """The same for a bus: subject, and the event id by which redeliveries within two minutes are dropped."""

    def __init__(self, path: str, subject: Column, name: str = "bus"):
        super().__init__(path, subject, None, name)

    def consume(self, spark: SparkSession) -> DataFrame:
        """The bus as a stream of messages; an id that was seen within the window is dropped."""
        return once_in_window(spark.readStream.schema(spark.read.parquet(self.path).schema).parquet(self.path), time="ts")

    def process(self, events: DataFrame, batch: int) -> None:
        rows = events.select(self.key.alias("key"), "event_id", self.body(events).alias("payload"), "lsn_num", "seq", "ts")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def body(self, events: DataFrame) -> Column:
        return typed_message_payload() if "types" in events.columns else message_payload()


class Mirror(_Base):
    """Documents by key. Batches are appended as changes; state is their merge.

    Each batch is a folder of its own, so a replay overwrites itself and the merge is idempotent. read() merges all of it:
    for a large history merge into a table of your own from time to time and start a new folder.
    """

    def __init__(self, path: str, key: Column, flavour: str = FULL_SET, name: str = "document"):
        self.name, self.path, self.key, self.flavour = name, path, key, flavour

    def process(self, events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        from ..operators.apply import documents

        return documents(spark.read.parquet(self.path).drop("batch"), self.key, self.flavour)


class Webhook(_Base):
    """One POST for each event, from the executors; any answer but 2xx is an error with a piece of the body."""

    def __init__(self, url: str, secret: bytes | None = None, authorization: str = "", timeout: float = 5.0, name: str = "webhook", clock: Callable[[], Column] = F.unix_timestamp, row: Column | None = None):
        self.name, self.url, self.secret, self.authorization, self.timeout, self.clock = name, url, secret, authorization, timeout, clock
        self.row = F.concat_ws(":", full_name(), field("id")) if row is None else row

    def process(self, events: DataFrame, batch: int) -> None:
        body = typed_message_payload() if "types" in events.columns else message_payload()
        rows = events.select("event_id", body.alias("body"), webhook_headers(body, self.clock(), self.secret).alias("headers"), "lsn_num", "seq", self.row.alias("row"))
        # changes of one row (by its id, unless told otherwise) go out in their order, from one task
        rows = rows.repartition("row").sortWithinPartitions("lsn_num", "seq")
        url, authorization, timeout = self.url, self.authorization, self.timeout

        def send(row) -> str | None:
            headers = dict(row.headers) | {"Content-Type": "application/json"} | ({"Authorization": authorization} if authorization else {})
            request = urllib.request.Request(url, row.body.encode(), headers, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return None if 200 <= answer.status < 300 else f"webhook answered {answer.status}: {answer.read(512)!r}"
            except urllib.error.HTTPError as e:
                return f"webhook answered {e.code}: {e.read(512)!r}"
            except OSError as e:
                return f"webhook: {e}"

        def post(batches: Iterator) -> Iterator:
            import pandas as pd

            stopped: dict[str, str] = {}  # rows with a failed event: what follows it has to wait
            for b in batches:
                failed = []
                for row in b.itertuples(index=False):
                    error = f"held back behind {stopped[row.row]}" if row.row in stopped else send(row)
                    if error:
                        stopped.setdefault(row.row, row.event_id)
                        failed.append((row.event_id, error))
                yield pd.DataFrame(failed, columns=["event_id", "error"])

        failed = rows.mapInPandas(post, "event_id string, error string").persist(StorageLevel.DISK_ONLY)
        if failed.count():
            raise EventsFailed(failed)
        failed.unpersist()


class Messages(_Base):
    """Outbox messages (already built rows) appended by batch; `delete`, if given, then gets the ids of what was published.

    A failed deletion is only noted: the messages are out.
    """

    def __init__(self, path: str, name: str = "outbox", delete: Callable[[DataFrame], None] | None = None):
        self.name, self.path, self.delete = name, path, delete
        self.notes: list[str] = []

    def process(self, events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.delete is not None:
            try:
                self.delete(events.select("id"))
            except Exception as e:
                self.notes = [*self.notes[-99:], f"batch {batch}: {e}"]


class Progress:
    """Backfill progress by table: a small file, replaced atomically; an empty path keeps nothing."""

    def __init__(self, path: str = ""):
        self.path = path

    def load(self) -> dict[str, dict]:
        if not self.path or not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def save(self, table: str, cursor: list | None, done: bool, updated_at: str) -> None:
        if self.path:
            self._write(self.load() | {table: {"cursor": cursor, "done": done, "updated_at": updated_at}})

    def clear(self, table: str) -> None:
        if self.path:
            self._write({k: v for k, v in self.load().items() if k != table})

    def _write(self, state: dict) -> None:
        tmp = f"{self.path}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(tmp, self.path)
