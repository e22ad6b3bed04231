"""Operator 8: quality classifier as a sparse rule ensemble.

Shallow boosted trees over statistics of whole texts are read as conjunctive rules (every path from the root), a lasso-penalised logistic regression picks and weights few of them, and
the result is compiled into one Spark column expression. Trees and weights are fitted on at most ``most_rows`` labelled rows, those of the least id hashes; scoring is
a projection over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import shape_statistics

Condition = tuple[str, bool, float]  # statistic, whether above, bound
THRESHOLD = 0.3


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1, from the columns of ``shape_statistics``."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, bound in conditions:
                holds = holds & (F.col(name) > bound if above else F.col(name) <= bound)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, residual: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list, np.ndarray]:
    """One regression tree on gradients: its paths as lists of (column, above, bound), and its Newton step for each row."""
    paths, step = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple) -> None:
        best = (1e-9, None, None)
        if len(path) < depth:
            base = residual[rows].sum() ** 2 / len(rows)
            for j, bounds in enumerate(cuts):
                cell = np.searchsorted(bounds, x[rows, j])  # cell k: bounds[k-1] < x <= bounds[k]
                n = np.cumsum(np.bincount(cell, minlength=len(bounds) + 1))[:-1]
                s = np.cumsum(np.bincount(cell, residual[rows], minlength=len(bounds) + 1))[:-1]
                fits = (n >= least) & (len(rows) - n >= least)
                if fits.any():
                    gain = np.where(fits, s**2 / np.maximum(n, 1) + (residual[rows].sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - base, 0)
                    if gain.max() > best[0]:
                        best = (gain.max(), j, float(bounds[gain.argmax()]))
        if path:
            paths.append(path)
        if best[1] is None:
            step[rows] = residual[rows].sum() / (curve[rows].sum() + 1e-3)
            return
        above = x[rows, best[1]] > best[2]
        split(rows[~above], (*path, (best[1], False, best[2])))
        split(rows[above], (*path, (best[1], True, best[2])))

    split(np.arange(len(x)), ())
    return paths, step


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 400, seed: int = 3) -> RuleModel:
    """Fit on rows of statistics ``x`` and labels ``y``. Without both labels present the model is the smoothed share of label 1 (a half for no rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    logit, found = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        rows = rng.permutation(len(y))[: max(50, len(y) // 2)]
        mine = sorted(rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)].tolist())
        paths, _ = _grow(x[rows][:, mine], (y - p)[rows], (p * (1 - p))[rows], [cuts[j] for j in mine], depth, max(5, len(rows) // 400))
        for path in paths:
            found.setdefault(tuple(sorted({(mine[j], above, bound) for j, above, bound in path})))
        leaf = np.zeros(len(y))
        for path in (p for p in paths if not any(len(q) > len(p) and q[: len(p)] == p for q in paths)):
            holds = _holds(x, tuple((mine[j], a, b) for j, a, b in path))
            leaf[holds] = np.clip((y - p)[holds].sum() / ((p * (1 - p))[holds].sum() + 1e-3), -4, 4)
        logit += 0.3 * leaf
    rules = sorted(found)
    z = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float32)
    mean, sd = z.mean(axis=0), z.std(axis=0)
    kept = np.flatnonzero(sd > 1e-3)
    rules, z, mean, sd = [rules[k] for k in kept], z[:, kept], mean[kept], sd[kept]
    z = (z - mean) / sd
    weight, bias = _lasso(z, y, penalty, steps)
    chosen = [(tuple((names[j], a, b) for j, a, b in rules[k]), float(weight[k] / sd[k])) for k in np.flatnonzero(weight)]
    return RuleModel(float(bias - (weight * mean / sd).sum()), chosen)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, bound in rule:
        out &= (x[:, j] > bound) if above else (x[:, j] <= bound)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, k = z.shape
    probe = np.ones(k) / max(1, k) ** 0.5
    for _ in range(30):  # largest eigenvalue of z'z / n
        probe = z.T @ (z @ probe) / n
        size = np.linalg.norm(probe) or 1.0
        probe /= size
    rate = 4 / (1.1 * size + 1)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ miss) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        bias = c - rate * miss.mean()
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, c = new + (old - 1) / t * (new - w), bias + (old - 1) / t * (bias - b)
        w, b = new, bias
    return w, b


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, **options) -> RuleModel:
    """``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality``. At most ``most_rows`` labelled ids outside the held-out fifth are learned from; rows with a null are ignored, and of
    several labels of an id the highest counts. Of documents whose ids repeat at most ``2 * most_rows`` rows are taken, in order of id and statistics."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = shape_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # bounded by most_rows
    names = [c for c in rows.columns if c not in ("doc_id", "text", "_label")]
    got = rows.select("doc_id", "_label", *names).orderBy("doc_id", *names).limit(2 * most_rows).toPandas()
    return fit_rules(got[names].to_numpy(np.float64), got["_label"].to_numpy(np.float64), names, **options)


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out, score`` (0 to 1) and ``predicted`` (1 where the score is at least 0.3); columns that had these names are replaced. Null
    and empty texts have statistics of 0. The other columns travel in a struct, so no name can clash with a statistic's."""
    rows = shape_statistics(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))).withColumn("_score", model.score())
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return rows.select(*kept, held_out("_row.doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
