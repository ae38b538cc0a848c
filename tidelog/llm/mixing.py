"""Mixing sources to target weights, with DataFrame operations only.

Targets: sources in code-point order weigh 3, 1, 2, 3, ... (or as given) and share `share` times all
sizes; no target passes `most` times its source's size, and the excess is shared again by weight.
Documents: a source takes whole epochs first. The rest of its target is filled by Efraimidis-Spirakis
sampling: key -ln(u)/quality with u from the md5 of id and text, ascending within the source, sizes
prefix-summed up to the budget; one more document, the one whose size is nearest to what is left, closes the gap.

Scale: the words are counted once into a slim table (id, source, size, key, rows alike; no texts). Prefix sums
never gather a source in one task: its keys are cut into buckets by value, buckets are summed, and
only the one bucket per source that the budget ends in is summed row by row. Keys depend on the text too, so
equal or null ids don't share one, and rows that are alike in all four columns are one row with a count.
The targets' windows hold one row for each source, in one task: meant for up to some hundred thousand sources.

Edge cases: a null text has size 0; null sources are one source, the last; rows with equal ids are told apart by
their text; of rows alike, as many are taken as the budget reaches; documents of size 0 take 0 words, however often
they are taken; a very long text counts as any other; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows that one bucket of a source should hold; buckets follow the table's size.
BUCKET_ROWS = 50_000


def size_of(text: str = "text") -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: str = "text") -> Column:
    """A weight in [0.05, 1]: the more of the text is symbols, the less."""
    clean = F.length(F.translate(F.col(text), "#*$%&|<>", ""))
    share = F.when(F.length(text) > 0, 1.0 - clean / F.length(text)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * F.coalesce(share, F.lit(0.0)))


def uniform(doc_id: str = "doc_id", text: str = "text") -> Column:
    """In (0, 1), from the first 52 bits of an md5 of the id's text and the text's md5; nulls count as ''."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    head = F.substring(F.md5(whole.cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def key_of(quality: Column | None = None) -> Column:
    """The sampling key: the smaller, the sooner a document is taken."""
    return -F.ln(uniform()) / (quality_of() if quality is None else quality)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source, water-filled exactly.

    Sources are sorted by most*size/weight; those below the level are capped, and the level is what is
    left of the total over the weights that are left. The windows hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level)
    # the level of the first source that is not capped; all are capped only if share >= most
    final = F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(everything)
    return per.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


#: What tells documents apart here; rows alike in these are one group.
ALIKE = ["doc_id", "source", "size", "key"]


def shares(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(ALIKE, n, source_size, target, epochs, extra): all n rows of a group are taken `epochs` times, and `extra` of them once more."""
    slim = docs.select("doc_id", "source", size_of().alias("size"), key_of(quality).alias("key"))
    slim = shared.saved(slim.groupBy(*ALIKE).agg(F.count("*").alias("n")))  # texts are read once
    target = targets(slim.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    buckets = max(64, -(-slim.count() // bucket_rows))
    slim = slim.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1.0) * F.lit(float(buckets))).cast("long"))
    sums = slim.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("s"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    target = target.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    t, s = target.alias("t"), sums.alias("s")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cum = s.join(t, same("s.source", "t.source")).select("t.*", F.col("s.bucket"), F.col("s.s")).withColumn("upto", F.sum("s").over(upto))
    # the bucket in which the budget ends, and what the buckets before it take
    ends = cum.groupBy("source", "source_size", "target", "epochs", "budget").agg(
        F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("s")).alias("before")))).alias("end")
    )
    ends = ends.select("source", "source_size", "target", "epochs", "budget", F.col("end.bucket").alias("end_bucket"), F.coalesce("end.before", F.lit(0)).alias("before"))
    d = slim.alias("d").join(ends.alias("e"), same("d.source", "e.source")).select("d.doc_id", "d.size", "d.key", "d.n", "d.bucket", "e.*")
    rows_in = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    inside = d.where(at_end).withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(rows_in), F.lit(0)))
    fit = F.floor((F.col("budget") - F.col("before")) / F.col("size")).cast("long")
    fit = fit - F.when(F.col("before") + fit * F.col("size") > F.col("budget"), F.lit(1)).otherwise(F.lit(0))  # the quotient may be rounded up
    inside = inside.withColumn("fit", F.when(F.col("before") > F.col("budget"), F.lit(0)).when(F.col("size") == 0, F.col("n")).otherwise(F.least("n", F.greatest(F.lit(0), fit))))
    outside = d.where(~at_end).withColumn("fit", F.when(F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(True)), F.col("n")).otherwise(F.lit(0)))
    d = inside.unionByName(outside).withColumn("fit", F.when(F.col("budget") > 0, F.col("fit")).otherwise(F.lit(0)).cast("long"))
    d = shared.saved(d.drop("before", "bucket", "end_bucket"))
    # the gap that is left, and the one document more that brings the source nearest to its target
    gap = d.groupBy("source").agg((F.first("budget") - F.sum(F.col("fit") * F.col("size"))).alias("gap"))
    g = d.where((F.col("fit") < F.col("n")) & (F.col("size") > 0) & (F.col("budget") > 0)).alias("d").join(gap.alias("g"), same("d.source", "g.source"))
    better = g.where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    filler = better.groupBy("d.source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), F.col("key"), F.col("doc_id"), F.col("size"))).alias("f"))
    d = d.alias("d").join(filler.alias("f"), same("d.source", "f.source"), "left").select("d.*", "f.f")
    filled = F.col("f").isNotNull() & (F.col("fit") < F.col("n")) & (F.col("key") == F.col("f.key")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("size") == F.col("f.size"))
    extra = F.col("fit") + F.when(filled, F.lit(1)).otherwise(F.lit(0))
    return d.select(*ALIKE, "n", "source_size", "target", "epochs", extra.cast("long").alias("extra"))


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken = copies * size."""
    groups = shares(docs, quality, weights, share, most, bucket_rows)
    each = groups.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("epochs") + F.when(F.col("i") <= F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


#: DuckDB's SQL for the mix of `documents` with the default weights.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * CASE WHEN length(text) > 0 THEN 1.0::DOUBLE - length(translate(text, '#*$%&|<>', ''))::DOUBLE / length(text)::DOUBLE ELSE 0.0::DOUBLE END) AS weight,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM d),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
q AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
f AS (SELECT *, max(CASE WHEN cap >= level * w THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, target - epochs * source_size AS budget FROM e),
s AS (SELECT k.doc_id, k.size, k.key, b.*, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source),
m AS (SELECT *, budget > 0 AND upto <= budget AS picked FROM s),
g AS (SELECT *, budget - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT picked AND size > 0 AND budget > 0 AND abs(gap - size) < gap DESC, abs(gap - size), key, doc_id, size) AS place FROM g)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN picked OR (place = 1 AND size > 0 AND budget > 0 AND abs(gap - size) < gap) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
