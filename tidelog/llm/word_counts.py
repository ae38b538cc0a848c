"""Word counts over a whole corpus, gathered in bounded memory."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as tx

FLUSH_WORDS = 250_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SCHEMA = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def partial_counts(lower: bool, least_share: float, end: bytes | None = None):
    """A mapInArrow function: (word, n, docs) partial counts, flushed before memory grows.

    With least_share > 0 this is lossy counting: a flush leaves out words that hold less than that
    share of what it counted, so a total falls short by at most that share of all words.
    `end`, if given, is counted once for each text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0

        def flush() -> pa.RecordBatch:
            bar = max(1, least_share * total)
            kept = [(w, n) for w, n in seen.items() if n >= bar]
            words, ns = [w for w, _ in kept], [n for _, n in kept]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64()), pa.array([total if i == 0 else 0 for i in range(len(kept))], pa.int64())], schema=_SCHEMA)

        for b in tx.slices(batches):
            for t in tx.as_bytes(b.column(0)):
                words = (t.translate(LOWER) if lower else t).split()
                seen.update(words)
                total += len(words)
                if end is not None:
                    seen[end] += 1
                    total += 1
                if len(seen) > FLUSH_WORDS:
                    yield flush()
                    seen, total = Counter(), 0
        if seen:
            yield flush()

    return run


def counts(docs: DataFrame, lower: bool = False, least_share: float = 0.0, end: bytes | None = None) -> DataFrame:
    """(word binary, n long) summed over all rows; hot words are pre-aggregated in each task."""
    rows = shared.in_arrow(docs.select("text"), partial_counts(lower, least_share, end), "word binary, n long, docs long")
    return shared.saved(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("total")))
