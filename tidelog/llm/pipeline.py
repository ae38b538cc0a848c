"""The corpus pipeline: filter, join near copies, cut repeats, mix, encode.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that
go on, with the columns of `documents`; the last returns the encoder's rows. run() applies them in
turn, each stage's result as Parquet in the shared folder; the last one's stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, mixing, ngram_join, quality_classifier, shared, suffix_dedup


def _wrapped(docs: DataFrame, *beside: str) -> DataFrame:
    """All columns but the text in one struct, so that no name of theirs meets one of an operator's."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_doc"), *beside)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them.

    Null and empty texts are judged like any other; repeated rows share a verdict; an empty table stays empty. Texts
    pass through the counting pass beside their counts, in batches of bounded bytes: nothing is shuffled.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(_wrapped(docs, "text"), model, ["_doc", "text"])
    return scored.where("predicted = 1").select("_doc.*", "text").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that 5-gram Jaccard links of 0.8 or more connect.

    Null ids are in no group and stay; of repeated rows one stays.
    """
    groups = ngram_join.join(docs.select("doc_id", "text"), 5, 0.8)
    marks = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("_class"), F.count("*").alias("_n"))
    rows = _wrapped(docs, "doc_id", "text").join(marks, "doc_id", "left").where(F.col("_class").isNull() | (F.col("_class") == F.col("doc_id")))
    single = rows.where(F.coalesce(F.col("_n"), F.lit(1)) == 1)
    repeated = rows.where("_n > 1").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select("_doc.*", "text").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that an earlier place holds; n_chars follows the text.

    A character that a cut went through is left out. Null and empty texts become empty and stay; rows under one id
    are told apart by their text, exact repeats of a row keep each other; an empty table stays empty.
    """
    cut = suffix_dedup.dedup(_wrapped(docs, "doc_id", "text"), ["_doc"], 100, result="text").select("_doc.*", F.col("kept").alias("text"))
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; text-less ones stay as often as their source's epochs and draw say.

    Rows meet their group by id, source, size and key, so rows under equal or null ids are told apart by their text.
    Only of a group of rows alike that is taken in part (two a source at most) are the rows numbered. An empty table
    stays empty; other columns pass through, whatever their names.
    """
    groups = mixing.shares(docs).where("epochs > 0 OR extra > 0").select(*(F.col(c).alias(f"_{c}") for c in (*mixing.ALIKE, "n", "epochs", "extra")))
    rows = _wrapped(docs, "doc_id", "source", "text").withColumn("size", mixing.size_of()).withColumn("key", mixing.key_of())
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in mixing.ALIKE]
    rows = rows.join(groups, alike).select("_doc", "text", *(f"_{c}" for c in (*mixing.ALIKE, "n", "epochs", "extra")))
    part = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_n"))
    number = F.row_number().over(Window.partitionBy(*(f"_{c}" for c in mixing.ALIKE)).orderBy(F.lit(1)))
    copies = rows.where(~part).select("_doc", "text", (F.col("_epochs") + F.when(F.col("_extra") > 0, F.lit(1)).otherwise(F.lit(0))).alias("_copies"))
    numbered = rows.where(part).withColumn("_i", number).select("_doc", "text", (F.col("_epochs") + F.when(F.col("_i") <= F.col("_extra"), F.lit(1)).otherwise(F.lit(0))).alias("_copies"))
    taken = copies.unionByName(numbered).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
    return taken.select("_doc.*", "text").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document; null and empty texts have no ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(docs, path, bpe.compile_lexicon(docs, path), ["doc_id"])


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared.folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            _drop(spark, f"{at}/{k - 1}")
    return docs
