"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics.

Sequential covering: each rule grows by the threshold that gains most (FOIL's gain) on two thirds of
the rows still uncovered, is pruned from its end on the last third, and the rows that it covers go.
The list becomes one ordered CASE expression; what no rule covers is kept.

Edge cases: a null or empty text has no words and fails the base rules; without usable labels the
list is empty and only the base rules decide; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, stats
from .quality_classifier import Condition, conjunction, cuts, holds

Rule = tuple[tuple[Condition, ...], bool]  # conditions, verdict (kept)


def learn(x: dict[str, np.ndarray], y: np.ndarray, most: int = 12, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules that reject label 0; y is 1 for documents to keep."""
    n, bad = len(y), y == 0
    if n < 20 or not bad.any() or bad.all():
        return []
    at = {k: cuts(v, 64) for k, v in x.items()}
    prune = (np.arange(n) * 2654435761 >> 7) % 3 == 0
    left, rules = np.ones(n, bool), []
    for _ in range(most):
        path: tuple[Condition, ...] = ()
        inside = left & ~prune
        while len(path) < 4 and bad[inside].any() and not bad[inside].all():
            p0 = bad[inside].sum()
            base = np.log2(p0 / inside.sum())
            best: tuple[float, Condition | None] = (1e-6, None)
            for name, edges in at.items():
                if not len(edges):
                    continue
                b = np.searchsorted(edges, x[name][inside], side="left")
                size = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
                hit = np.cumsum(np.bincount(b, bad[inside], minlength=len(edges) + 1))[:-1]
                for above, s, h in ((False, size, hit), (True, inside.sum() - size, p0 - hit)):
                    gain = np.where((s >= least) & (h > 0), h * (np.log2(np.maximum(h, 1e-9) / np.maximum(s, 1)) - base), -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (name, above, float(edges[k])))
            if best[1] is None:
                break
            path = (*path, best[1])
            inside &= holds((best[1],), x, n)
        if not path:
            break
        worth = lambda c: (m := left & prune & holds(c, x, n)) is not None and (bad[m].sum() - (~bad[m]).sum()) / max(1, m.sum())
        while len(path) > 1 and worth(path[:-1]) >= worth(path):
            path = path[:-1]
        covered = left & holds(path, x, n)
        if covered.sum() < least or bad[covered].mean() < precision:
            break
        rules.append((path, False))
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression over the statistics: the first rule that holds decides, else keep."""
    out = F.lit(True)
    for conditions, kept in reversed(rules):
        out = F.when(conjunction(conditions), F.lit(kept)).otherwise(out)
    return out


def base_failed(least_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int | None = None, remainder: int | None = None, limit: int = labelled.SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most `limit` labelled documents that pass the base rules."""
    picked = labelled.join_sample(docs, labelled.sample(labels, label, modulus, remainder, limit))
    names = list(stats.RATIOS)
    rows = stats.with_ratios(stats.with_counts(picked, ["doc_id", "y"])).where(~base_failed()).select("doc_id", "y", *names).toPandas().sort_values(["doc_id", "y", *names])
    return learn({k: rows[k].to_numpy(float) for k in names}, rows["y"].to_numpy(int))


def apply(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """The kept columns, all counts, base_failed and kept, of every row."""
    rows = stats.with_ratios(stats.with_counts(docs, keep))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))).drop(*stats.RATIOS)
