"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees propose rules (every path from a root), a lasso logistic regression keeps few
of them, and the kept rules become one Spark column: a sigmoid over a sum of CASE expressions.

Edge cases: a null or empty text has all statistics 0 and is scored like any other; without usable
labels every document scores 0.5; null ids are scored, never trained on; repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, stats

MOST_RULES = 60
Condition = tuple[str, bool, float]  # feature, True for >, threshold


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The probability of label 1 as one Spark expression over the statistics."""
        z = F.lit(self.bias)
        for conditions, weight in self.rules:
            z = z + F.when(conjunction(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        z = np.full(n, self.bias)
        for conditions, weight in self.rules:
            z += weight * holds(conditions, x, n)
        return 1 / (1 + np.exp(-z))


def conjunction(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, above, at in conditions:
        out = out & ((F.col(name) > F.lit(at)) if above else (F.col(name) <= F.lit(at)))
    return out


def holds(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, above, at in conditions:
        out &= (x[name] > at) == above
    return out


def cuts(x: np.ndarray, bins: int = 32) -> np.ndarray:
    """Split points half way between neighbouring distinct values, at most bins-1, at the quantiles."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    q = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    q = q[q < len(values) - 1]
    return (values[q] + values[q + 1]) / 2


def grow(x: dict[str, np.ndarray], binned: dict[str, np.ndarray], at: dict[str, np.ndarray], residual: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Condition, ...], np.ndarray]]:
    """One regression tree on the residual: every node's path and the rows in it."""
    out: list[tuple[tuple[Condition, ...], np.ndarray]] = []

    def node(path: tuple[Condition, ...], rows: np.ndarray, level: int) -> None:
        if path:
            out.append((path, rows))
        if level == depth or len(rows) < 2 * least:
            return
        best, total = None, residual[rows].sum()
        for name, edges in at.items():
            if not len(edges):
                continue
            b = binned[name][rows]
            n = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
            s = np.cumsum(np.bincount(b, residual[rows], minlength=len(edges) + 1))[:-1]
            m = len(rows) - n
            ok = (n >= least) & (m >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -1)
            k = int(gain.argmax())
            if gain[k] > (best[0] if best else total**2 / len(rows) + 1e-9):
                best = (gain[k], name, float(edges[k]))
        if best:
            _, name, edge = best
            above = x[name][rows] > edge
            node((*path, (name, False, edge)), rows[~above], level + 1)
            node((*path, (name, True, edge)), rows[above], level + 1)

    node((), np.arange(len(residual)), 0)
    return out


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, least: int = 10, rate: float = 0.3, lasso: float = 5e-4, steps: int = 400) -> RuleEnsemble:
    n = len(y)
    if n < 20 or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))))
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    at = {k: cuts(v) for k, v in x.items()}
    binned = {k: np.searchsorted(at[k], v, side="left") for k, v in x.items()}
    least = min(least, max(2, n // 50))
    z, rules = np.full(n, bias), {}
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        nodes = grow(x, binned, at, y - q, depth, least)
        if not nodes:
            break
        for path, _ in nodes:
            rules.setdefault(tuple(sorted(set(path))), None)
        inner = {path[:-1] for path, _ in nodes}
        for path, rows in nodes:
            if path not in inner:
                w = (q[rows] * (1 - q[rows])).sum() + 1.0
                z[rows] += rate * (y[rows] - q[rows]).sum() / w
    paths = list(rules)
    r = np.stack([holds(c, x, n) for c in paths], 1).astype(np.float32)
    keep = (r.mean(0) > 1 / n) & (r.mean(0) < 1)
    paths, r = [c for c, k in zip(paths, keep, strict=True) if k], r[:, keep]
    w, b = _lasso_logistic(r, y.astype(np.float32), bias, lasso, steps)
    while np.count_nonzero(w) > MOST_RULES:  # a sparser one, so that the expression stays compilable
        lasso *= 1.6
        w, b = _lasso_logistic(r, y.astype(np.float32), bias, lasso, steps)
    return RuleEnsemble(b, [(c, float(v)) for c, v in zip(paths, w, strict=True) if v != 0])


def _lasso_logistic(r: np.ndarray, y: np.ndarray, bias: float, lasso: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean logistic loss plus lasso * |w|; the bias is free."""
    n, m = r.shape
    probe = np.ones(m, np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = r.T @ (r @ probe)
        probe /= max(np.linalg.norm(probe), 1e-12)
    step = 4 / (np.linalg.norm(r @ probe) ** 2 / n + 1) if m else 1.0
    w, b = np.zeros(m, np.float32), bias
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        d = 1 / (1 + np.exp(-(r @ v + c))) - y
        new = v - step * (r.T @ d) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_b = c - step * float(d.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return np.asarray(w, np.float64), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int | None = 5, remainder: int | None = 0, limit: int = labelled.SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on at most `limit` labelled documents outside the held-out fold."""
    picked = labelled.join_sample(docs, labelled.sample(labels, label, modulus, remainder, limit))
    names = list(stats.RATIOS)
    rows = stats.with_ratios(stats.with_counts(picked, ["doc_id", "y"])).select("doc_id", "y", *names).toPandas().sort_values(["doc_id", "y", *names])
    return fit({k: rows[k].to_numpy(float) for k in names}, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The kept columns, score and predicted, of every row."""
    rows = stats.with_ratios(stats.with_counts(docs, keep))
    return rows.select(*keep, model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
