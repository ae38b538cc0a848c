"""Keeps a stream running [S3, T23]: restarts it from its checkpoint, with pauses that double up to a cap."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

FIRST_PAUSE, LONGEST_PAUSE = 1.0, 30.0


class Supervisor:
    """start() makes the query; restarted, if given, is called before each start but the first."""

    def __init__(self, start: Callable[[], StreamingQuery], restarted: Callable[[], None] | None = None, sleep: Callable[[float], None] | None = None, good: float = LONGEST_PAUSE, clock: Callable[[], float] = time.monotonic):
        self.start, self.restarted, self.good, self.clock = start, restarted, good, clock
        self.stopping = threading.Event()
        self.sleep = sleep or self.stopping.wait
        self.pauses: list[float] = []
        self.errors: list[str] = []

    def run(self, most: int | None = None) -> None:
        """Until stop() is called, the query ends without an error, or it has been started `most` times."""
        pause, starts = FIRST_PAUSE, 0
        while not self.stopping.is_set():
            if starts and self.restarted:
                self.restarted()
            starts, began = starts + 1, self.clock()
            try:
                self.start().awaitTermination()
                return
            except Exception as e:
                self.errors = [*self.errors[-99:], str(e)]
            if most is not None and starts >= most:
                raise RuntimeError(f"the stream failed {starts} times; last: {self.errors[-1]}")
            if self.clock() - began >= self.good:  # it ran well for a while
                pause = FIRST_PAUSE
            self.pauses.append(pause)
            self.sleep(pause)
            pause = min(LONGEST_PAUSE, pause * 2)

    def stop(self) -> None:
        self.stopping.set()
