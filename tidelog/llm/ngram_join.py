"""Jaccard similarity join on word n-grams: MinHash bands propose, full n-gram sets decide.

1. One pass over whole texts: md5 of the text, band hashes of its n-gram set. Equal texts are one
   class; only its smallest id goes on, so a group of copies costs one row a task.
2. Band hashes are shuffled; the smallest id of a band that others share leads it, and all that share a band meet
   in its leader's group. Groups are not closed further: a chain of texts makes many small groups, not one.
3. The texts are read again; those that no group can want are passed over before the shuffle. Inside a group every pair of different n-gram sets is compared exactly, by
   matrix products; a pair with several groups counts in that of its smallest common leader. A group beyond BLOCK
   texts is dealt in pairs of blocks, so no task holds an unbounded group, and pairs are counted where they are
   compared, never emitted. Verified links alone are closed to classes (connected components).

A text of fewer than n words is one n-gram; a text without words (null, empty, blanks) has no links.
Rows with a null id are returned without links or group. Repeated rows are copies of each other. Very long texts are
read whole; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared
from . import text as tx

BLOCK = 768
#: 64-bit words of the bitmap that tells which texts a group may want: at most as many rows are sent to all tasks.
SIEVE_WORDS = 1 << 19


def bands_for(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs of that similarity still meet with that probability."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngrams(w: tx.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram; a text of fewer words is one n-gram of all its words."""
    h = w.hashes()
    g, first = w.windows(n, h)
    doc = w.doc[first]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            at = w.lo[short] + i
            on = at < w.hi[short]
            extra[on] = tx.mix(extra[on] * np.uint64(0x9E3779B97F4A7C15) + h[at[on]] + np.uint64(i + 1))
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    band_salt = tx.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def compute(texts: list[bytes]) -> dict:
        w = tx.split(texts)
        g, doc = ngrams(w, n)
        out: list = [None] * len(texts)
        if len(g):
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            x = (g >> np.uint64(32)).astype(np.uint32)
            keys = np.empty((len(at), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(at), band_salt[b], np.uint64)
                for r in range(b * rows, (b + 1) * rows):
                    v = x * mul[r] + add[r]
                    v ^= v >> np.uint32(15)
                    key = tx.mix(key + np.minimum.reduceat(v, at).astype(np.uint64))
                keys[:, b] = key
            for d, k in zip(doc[at].tolist(), keys.view(np.int64).tolist(), strict=True):
                out[d] = k
        return {"bands": out}

    return compute


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, bands): bands is null for a text without words."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    run = tx.per_text({"bands": pa.list_(pa.int64())}, _signer(n, bands, rows), ["doc_id", "digest"])
    return shared.in_arrow(marked, run, "doc_id long, digest string, bands array<long>")


def shingle_sets(n: int):
    def compute(texts: list[bytes]) -> dict:
        g, doc = ngrams(tx.split(texts), n)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        return {"grams": [np.unique(g[a:b]).view(np.int64) for a, b in zip(edge, edge[1:], strict=False)]}

    return compute


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None, slab: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of slabs of the incidence matrix; grams of one set alone are left out."""
    rows = left + (right or [])
    n = len(rows)
    size = np.fromiter(map(len, rows), np.int64, n)
    column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(n), size)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    m, a = int(column[-1]) + 1 if len(column) else 0, len(left)
    out = np.zeros((a, n - a if right is not None else a), np.float64)
    for lo in range(0, m, slab):
        i, j = np.searchsorted(column, [lo, lo + slab])
        x = np.zeros((n, min(slab, m - lo)), np.float32)
        x[row[i:j], column[i:j] - lo] = 1
        out += x[:a] @ (x[a:] if right is not None else x[:a]).T
    return out


def _labels(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over the links, inside one block."""
    label, reach = ids.copy(), linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def _verify(similarity: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        weight = table.column("copies").to_numpy()
        grams = [g.values.to_numpy() for g in table.column("grams").combine_chunks()]
        block = table.column("block").to_numpy()
        leader, i, j = (k.as_py() for k in key)
        before = [x[x < leader] for x in (g.values.to_numpy() for g in table.column("leaders").combine_chunks())]
        size = np.fromiter(map(len, grams), np.float64, len(grams))
        n = len(ids)
        linked = np.zeros((n, n), bool)
        a = np.flatnonzero(block == i)
        b = np.flatnonzero(block == j) if i != j else a
        if len(a) and len(b):
            take = lambda x: ([x[k] for k in a], [x[k] for k in b] if i != j else None)
            x = intersections(*take(grams))
            on = x >= similarity * (size[a][:, None] + size[b][None, :] - x) - 1e-9
            if any(map(len, before)):
                on &= intersections(*take(before)) == 0  # those meet in an earlier leader's group
            linked[np.ix_(a, b)] = on
            linked[np.ix_(b, a)] |= on.T
        np.fill_diagonal(linked, False)
        return pa.table({"rep": ids, "links": linked @ weight, "label": _labels(ids, linked)})

    return run


def sieve(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, and by chance a few others, without a shuffle of rows: by one bit of a bounded bitmap for each key."""
    word = lambda k: F.pmod(F.xxhash64(k), F.lit(SIEVE_WORDS))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({k}), 58) AS int))")
    bits = wanted.groupBy(word(key).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    return rows.join(F.broadcast(bits), (word(key) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit(key)) != 0), "left_semi")


def join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9995, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_class, class_id, n_links) of every row.

    text_class: smallest id with an equal text. class_id: smallest id reachable over links, itself
    included. n_links: other rows whose n-gram set has at least that Jaccard similarity.
    """
    bands, rows = bands_for(similarity, recall)
    signed = shared.saved(signatures(docs, n, bands, rows))
    known = signed.where("doc_id IS NOT NULL AND bands IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = shared.saved(classes)
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared_bands = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = banded.join(shared_bands, "band").select("rep", "leader").distinct()
    sizes = member.groupBy("leader").agg(F.count("*").alias("n"))
    groups = member.join(sizes, "leader").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("leader", "n"))).alias("groups"))  # at most one for each band
    groups = shared.saved(groups.join(classes.select("rep", "digest", "copies"), "rep").withColumnRenamed("rep", "doc_id"))
    # one row of the documents for each candidate class: its smallest id, with the class's text
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    texts = sieve(texts, groups, "doc_id").join(groups, "doc_id")
    texts = texts.where(F.md5(F.col("text").cast("binary")) == F.col("digest")).dropDuplicates(["doc_id", "digest"])
    sets = shared.in_arrow(
        texts.select(F.col("doc_id").alias("rep"), "groups", "copies", "text"), tx.per_text({"grams": pa.list_(pa.int64())}, shingle_sets(n), ["rep", "groups", "copies"]), "rep long, groups array<struct<leader:bigint,n:bigint>>, copies long, grams array<long>"
    )
    dealt = sets.select("rep", "copies", "grams", F.col("groups.leader").alias("leaders"), F.explode("groups").alias("g")).select("rep", "copies", "grams", "leaders", "g.leader", F.ceil(F.col("g.n") / block).alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    compared = dealt.select("leader", "i", "j", "rep", "copies", "block", "leaders", "grams").groupBy("leader", "i", "j").applyInArrow(_verify(similarity), "rep long, links long, label long")
    compared = shared.saved(compared)
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components.connected(compared.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    rep = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    # a hundred thousand copies of one text meet one row here: a join that can be split
    out = signed.select("doc_id", "digest", (F.col("doc_id").isNotNull() & F.col("bands").isNotNull()).alias("whole"))
    out = out.join(rep, "digest", "left")
    one = lambda c: F.when(F.col("whole"), c)
    return out.select(
        "doc_id",
        F.coalesce(one(F.col("rep")), F.col("doc_id")).alias("text_class"),
        F.coalesce(one(F.coalesce("component", "rep")), F.col("doc_id")).alias("class_id"),
        F.coalesce(one(F.col("copies") - 1 + F.coalesce("links", F.lit(0))), F.lit(0)).cast("long").alias("n_links"),
    )


#: DuckDB's SQL for the same over `documents` with unique ids: all pairs of texts that share a 5-gram.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN [hash(ws[i : i + 4]) FOR i IN range(1, len(ws) - 3)] ELSE [hash(ws)] END)) AS k FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meet JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
many AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS text_class, class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w JOIN class USING (doc_id) LEFT JOIN many USING (doc_id)
"""
