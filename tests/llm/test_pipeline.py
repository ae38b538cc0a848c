"""The pipeline stage by stage against brute force, on the awkward rows."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_operators import ROWS, grams, key, removed_by_hand, targets_by_hand

import corpus_pipeline
from tidelog.llm import mixing, pipeline, quality_classifier


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in ROWS if i != 78]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, _n string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "BPE encoding"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = {n: f for n, f in corpus_pipeline.STAGES}

    kept = stage["quality classifier"](spark, docs, tables).cache()
    assert kept.columns == docs.columns
    model = quality_classifier.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = quality_classifier.score(docs.select("doc_id", "text", "source"), model, ["doc_id", "text", "source"]).where("predicted = 1")
    assert Counter(rows(kept)) == Counter((r.doc_id, r.text, r.source) for r in want.collect())

    single = stage["n-gram Jaccard join"](spark, docs, tables).cache()
    assert single.columns == docs.columns
    all_rows = sorted(rows(docs), key=lambda r: key(r[0]))
    keep, seen = [], []
    group: dict[int, int] = {}
    sets = [(i, grams(t)) for i, t, _ in all_rows]
    for a, (i, x) in enumerate(sets):
        group[a] = a
        for b in range(a):
            j, y = sets[b]
            if i is not None and j is not None and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    for a, r in enumerate(all_rows):
        if r[0] is None or (group[a] == a and r not in seen):
            keep.append(r)
        seen.append(r)
    assert Counter(rows(single)) == Counter(keep)

    cut = stage["suffix-array dedup"](spark, single, tables).cache()
    assert cut.columns == docs.columns
    by_hand = removed_by_hand([(i, (t or "").encode()) for i, t, _ in keep], 100, lambda kept: kept.decode("utf-8", "ignore"))
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter((d[0], d[4]) for d in by_hand.elements())
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = stage["mixing sources"](spark, cut, tables).cache()
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for _, t, s in rows(cut):
        size[s] += len(t.encode().split())
    for _, t, s in rows(mixed):
        taken[s] += len(t.encode().split())
    target = targets_by_hand(size)
    largest = max(len(t.encode().split()) for _, t, _ in rows(cut))
    assert all(abs(taken[s] - target[s]) <= largest for s in size)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text, r.source) for r in cut.collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = Counter()
    for i, n, _, _, words in con.execute(mixing.SQL).fetchall():
        want[i, n] += words // n if n else 0
    assert Counter((i, len(t.encode().split())) for i, t, _ in rows(mixed) if t.split()) == +want

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stage["BPE encoding"](spark, mixed, tables).collect())
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows(mixed)]
    assert coded == Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids)


def test_mix_takes_rows_alike_one_by_one(spark):
    """Rows without an id, rows alike that are taken in part, ids shared by different texts and sources."""
    rows_ = [(None, "a b c", "x")] * 9 + [(None, "d e f", "x")] * 4 + [(1, "g h i", "x"), (1, "j k l", "y"), (1, "j k l", "x"), (2, "m " * 30, "y"), (None, None, None), (3, "", "y")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows_], "doc_id long, text string, source string, size string, _copies string").repartition(3)
    taken = Counter(rows(pipeline.mix(spark, docs, "")))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows_, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = Counter()
    for i, n, _, _, words in con.execute(mixing.SQL).fetchall():
        want[i, n] += words // n if n else 0
    got = Counter()
    for (i, t, _), k in taken.items():
        if t:
            got[i, len(t.split())] += k
    assert got == +want
    assert pipeline.mix(spark, docs, "").columns == docs.columns


def test_empty_tables(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).collect() == []


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == [str(len(corpus_pipeline.STAGES) - 1)]
