"""Labelled rows for the learned operators: a bounded, deterministic sample of the training fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on; beyond it more rows don't change the fit noticeably.
SAMPLE_ROWS = 20_000


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the fold that no label is learned from; a null id is in no fold and never trained on."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def sample(labels: DataFrame, label: str, modulus: int | None, remainder: int | None, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y) of at most `limit` labelled ids outside the held-out fold, picked by a hash of the id.

    Ids that are labelled twice keep the smaller label; labels other than 0 and 1 count as none.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if modulus is not None:
        rows = rows.where(fold("doc_id", modulus) != remainder)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def join_sample(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The sampled documents with y. The sample's row limit bounds what is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
