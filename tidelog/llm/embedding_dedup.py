"""Near-duplicate vectors inside a label, by a forest of random-projection trees.

Every tree splits by a random direction a level; cut points are medians on a bounded sample, every row
is routed. Rows close to a cut go both ways (spill), so a pair is lost in a tree only if a cut parts it
by more than two margins. Leaves are compared exactly, in double precision. Where two vectors meet in
several leaves, only the first of them counts, so links are counted where they are found and pairs
are never emitted. Links inside a leaf are reduced to its components, and those are joined.

Scale: equal vectors of a label are one class (pre-aggregated); a tree is as deep as a label's size
asks for; a leaf of more than 2*LEAF classes is compared exactly by pairs of blocks, over tasks.

Vectors that are null, empty or zero, or hold null or non-finite parts, and rows without label or id, link
with nothing and are kept. Vectors of different lengths never link; only lengths with a label that needs cutting get a forest,
so dirty data costs no plan for each length. Repeated rows are copies of each other; a cosine of exactly the threshold
links. Long vectors go through whole; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared
from .ngram_join import _labels

LEAF = 512
TREES = 6
#: Vectors that the cut points are fitted on, at most.
SAMPLE = 16_384
FITTED_LEVELS = 9
MOST_LEVELS = 40


class Forest:
    """Directions (tree, level) and cut points by the node of the first FITTED_LEVELS levels."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, similarity: float, seed: int = 7):
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.trees, self.levels = trees, levels
        self.directions = rng.standard_normal((trees, max(1, levels), dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.margin = 0.5 * math.sqrt(2 * (1 - similarity) / dim)
        self.cuts: list[list[np.ndarray]] = []
        for t in range(trees):
            node, cuts = np.zeros(len(sample), np.int64), []
            for level in range(levels):
                p = sample @ self.directions[t, level]
                fitted = min(level, FITTED_LEVELS)
                node_now = node >> (level - fitted)
                cut = np.full(1 << fitted, np.median(p) if len(p) else 0.0)
                for n in np.unique(node_now):
                    cut[n] = np.median(p[node_now == n])
                cuts.append(cut)
                node = node * 2 + (p > cut[node_now])
            self.cuts.append(cuts)

    def route(self, unit: np.ndarray, depth: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every row, at its depth; a row near a cut is in both leaves."""
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        done_row, done_node = [], []
        for level in range(self.levels + 1):
            end = depth[row] <= level
            done_row.append(row[end])
            done_node.append(node[end] + (1 << level))  # a leading 1 tells depths apart
            row, node = row[~end], node[~end]
            if not len(row) or level == self.levels:
                break
            p = (unit @ self.directions[tree, level])[row]
            cut = self.cuts[tree][level][node >> (level - min(level, FITTED_LEVELS))]
            right, left = p > cut - self.margin, p <= cut + self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
        return np.concatenate(done_row), np.concatenate(done_node)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return flat[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _route(forests):
    """mapInArrow: a row for each leaf of each class, with the class's leaves in all trees; `forests` are by vector length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                yield from one(forests.value.get(dim) or Forest(np.zeros((0, dim)), 1, 0, 1.0), b.take(pa.array(np.flatnonzero(dims == dim))))

    def one(f: Forest, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = _unit(_vectors(b.column("embedding")))
        depth = b.column("depth").to_numpy().astype(np.int64)
        rows, trees, leaves = [], [], []
        for t in range(f.trees):
            here = np.flatnonzero((depth > 0) | (t == 0))  # without a cut all trees are the same
            row, leaf = f.route(unit[here], depth[here], t)
            rows.append(here[row])
            trees.append(np.full(len(row), t))
            leaves.append(leaf)
        row, tree, leaf = map(np.concatenate, (rows, trees, leaves))
        code = tree * (1 << (MOST_LEVELS + 1)) + leaf
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        start = np.searchsorted(row, np.arange(b.num_rows + 1))
        codes = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(code)).take(pa.array(row))
        picked = b.take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [picked.column("label"), picked.column("dim"), pa.array(code), picked.column("rep"), picked.column("copies"), picked.column("embedding"), codes], ["label", "dim", "leaf", "rep", "copies", "embedding", "codes"]
        )

    return run


def _met_before(codes: list[np.ndarray], leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows share a leaf with a smaller code than this one."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    flat = np.concatenate(codes)
    on = flat < leaf
    row, flat = row[on], flat[on]
    out = np.zeros((len(a), len(b)), bool)
    if not len(flat):
        return out
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    row, column = row[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    if not len(row):
        return out
    x = np.zeros((len(codes), int(column.max()) + 1), np.float32)
    x[row, column] = 1
    return (x[a] @ x[b].T) > 0


def _compare(similarity: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, leaf, i, j = (k.as_py() for k in key)
        table = table.combine_chunks()
        ids, weight, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        unit = _unit(_vectors(table.column("embedding").chunk(0)))
        codes = [c.values.to_numpy() for c in table.column("codes")]
        a = np.flatnonzero(block == i)
        b = np.flatnonzero(block == j) if i != j else a
        linked = np.zeros((len(ids), len(ids)), bool)
        if len(a) and len(b):
            on = unit[a] @ unit[b].T >= similarity
            linked[np.ix_(a, b)] = on
            linked[np.ix_(b, a)] |= on.T
        np.fill_diagonal(linked, False)
        label = _labels(ids, linked)
        if linked.any():
            some = np.flatnonzero(linked.any(0))
            seen = _met_before([codes[k] for k in some], leaf, np.arange(len(some)), np.arange(len(some)))
            linked[np.ix_(some, some)] &= ~seen
        return pa.table({"rep": ids, "links": linked @ weight, "label": label})

    return run


def dedup(vectors: DataFrame, similarity: float = 0.98, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    parts = F.col("embedding")
    finite = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & parts.isNotNull() & finite & F.exists(parts, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    digest = F.when(F.col("usable"), F.md5(parts.cast("string").cast("binary")))
    rows = rows.withColumn("digest", digest)
    good = rows.where("usable").withColumn("dim", F.size("embedding"))
    classes = shared.saved(good.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    depth = F.when(F.col("n") <= 2 * leaf, F.lit(0)).otherwise(F.least(F.lit(MOST_LEVELS), F.ceil(F.log2(F.col("n") / leaf)).cast("int")))
    sizes = shared.saved(sizes.withColumn("depth", depth.cast("int")))
    forests: dict[int, Forest] = {}
    for dim, levels in sorted(tuple(r) for r in sizes.where("depth > 0").groupBy("dim").agg(F.max("depth")).collect()):  # lengths with a label of over 2 * leaf classes
        picked = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("digest")).select("embedding").limit(sample).toPandas()["embedding"]
        forests[dim] = Forest(_unit(np.stack([np.asarray(v, np.float64) for v in picked])), trees, int(levels), similarity)
    kind, label = (vectors.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    own = classes.join(sizes.select("label", "dim", "depth"), ["label", "dim"]).select("label", "dim", "rep", "copies", "embedding", "depth")
    routed = shared.in_arrow(own, _route(spark.sparkContext.broadcast(forests)), f"label {label}, dim int, leaf long, rep long, copies long, embedding {kind}, codes array<long>")
    full = routed.groupBy("label", "dim", "leaf").agg(F.count("*").alias("n"))
    full = full.withColumn("blocks", F.when(F.col("n") <= 2 * leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / leaf)).cast("long")).where("n > 1").drop("n")
    dealt = routed.join(full, ["label", "dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    compared = dealt.select("label", "dim", "leaf", "i", "j", "rep", "copies", "embedding", "codes", "block").groupBy("label", "dim", "leaf", "i", "j").applyInArrow(_compare(similarity), "rep long, links long, label long")
    compared = shared.saved(compared)
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components.connected(compared.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    rep = classes.select("label", "dim", "digest", "rep", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left").drop("dim")
    out = rows.select("vec_id", "label", "digest").join(rep, ["label", "digest"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


#: DuckDB's SQL for the same over `embeddings` with unique ids: all pairs inside a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_inner_product(x.e, y.e) / x.size / y.size >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN class USING (vec_id) LEFT JOIN many USING (vec_id)
"""
