"""Operator 1: quality rules by robust multivariate outliers, in DataFrame operations only.

Base rules reject texts of few words or of much repetition. For the others, statistics of each text are transformed to near symmetry, and the minimum-covariance-determinant
estimate of location and scatter is found per language and source: the three quarters of a group's texts whose covariance has the least determinant. Three deterministic starts
(correlations of hyperbolic tangents, of spatial signs, and of the central rows, about medians and quartile ranges) take two concentration steps each; of each group the one with
the least determinant goes on until it settles, and a last step takes all rows within the chi-squared 0.975 bound. Texts beyond the bound of ``tail`` are outliers.

Counts are whole numbers and mostly 0, which would leave a group without any scatter; as randomised residuals do, they get a fraction from the text's hash. Equal vectors count once
in an estimate, so copies don't make a group narrow. A group's scatter is drawn towards the scatter within groups over all texts by the weight of ``prior`` rows, so small groups
need no rule of their own; there is no other floor than a numerical one.

A concentration step is one grouped aggregate: rows are summed by cells of their distance, so the step's quantile and the moments of the rows below it come from the same sums, and one
source may hold any share of the rows. Estimates are joined by broadcast while their number is below ``BROADCAST_GROUPS``, and by a skew-split shuffle beyond.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .stats import WINDOW, base_statistics

# Fixed values of the contract.
LEAST_WORDS, REPEAT_PERCENT = 20, 30
BROADCAST_GROUPS = 5_000
#: Cells: of a statistic (for medians and quartiles) and of the binary logarithm of a squared distance.
_STEP, _CELLS = 1 / 256, 16
_TINY = 1e-12


def transformed() -> dict[str, Column]:
    """The vector's columns, from ``text`` and those of ``base_statistics``."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    bits = F.xxhash64(F.coalesce("text", F.lit("")))
    fraction = lambda k: F.shiftrightunsigned(bits, 20 * k).bitwiseAND((1 << 20) - 1) / float(1 << 20)
    return {
        "log_words": F.log1p("n_words"),
        "log_word_length": F.log(chars / n),
        "symbol_share": F.sqrt((F.col("n_symbols") + fraction(0)) / (chars + 1)),
        "dup_line_share": F.sqrt((F.col("n_dup_lines") + fraction(1)) / (n + 1)),
        "log_repeat_share": F.log((F.col("n_repeat_words") + WINDOW * fraction(2) + 1) / (n + 1)),
        "variety": F.log1p("n_distinct") / F.log1p(n),
    }


def chi_squared(p: int, q: float) -> float:
    """Quantile of the chi-squared distribution (Wilson and Hilferty's approximation)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def chi_squared_below(p: int, x: float) -> float:
    """Distribution function of chi-squared, by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    k = 1
    while term > 1e-16 * total:
        term *= x / (a + k)
        total += term
        k += 1
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def consistency(p: int, bound: float) -> float:
    """What the covariance of normal rows whose squared distance is below ``bound`` is to be multiplied by."""
    return chi_squared_below(p, bound) / chi_squared_below(p + 2, bound)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _sums(values: list[str]) -> list[Column]:
    p = len(values)
    return [F.count("*").alias("s"), *[F.expr(f"sum({x})").alias(f"s_{i}") for i, x in enumerate(values)], *[F.expr(f"sum({values[i]} * {values[j]})").alias(f"s_{i}_{j}") for i, j in _pairs(p)]]


def _moments(p: int) -> tuple[list[str], dict[tuple[int, int], str]]:
    """Means and covariances from ``_sums``, as SQL; a single row has covariances of 0."""
    n = "greatest(s, 1)"
    return [f"coalesce(s_{i} / {n}, 0D)" for i in range(p)], {(i, j): f"coalesce((s_{i}_{j} - s_{i} * s_{j} / {n}) / greatest({n} - 1, 1), 0D)" for i, j in _pairs(p)}


def _inverted(table: DataFrame, p: int, keep: list[str]) -> DataFrame:
    """``keep``, the inverse of the scatter ``c_i_j`` in columns ``p_i_j``, and ``logdet``: sweeps of the matrix, one projection each."""
    at = lambda i, j: f"c_{max(i, j)}_{min(i, j)}"
    rest = ["logdet + ln(_pivot) AS logdet", *keep]
    table = table.selectExpr("*", "0D AS logdet")
    for k in range(p):
        table = table.selectExpr("*", f"greatest({at(k, k)}, {_TINY}D) AS _pivot")
        table = table.selectExpr(*rest, *[f"{f'-1 / _pivot' if i == j == k else f'{at(i, j)} / _pivot' if k in (i, j) else f'{at(i, j)} - {at(i, k)} * {at(k, j)} / _pivot'} AS {at(i, j)}" for i, j in _pairs(p)])
    return table.selectExpr(*keep, "logdet", *[f"-{at(i, j)} AS p_{i}_{j}" for i, j in _pairs(p)])


class _Groups:
    """Groups of distinct vectors with their written estimates."""

    def __init__(self, rows: DataFrame, names: list[str], share: float, prior: float):
        self.rows, self.names, self.p, self.share, self.prior = rows, names, len(names), share, prior
        self.start = materialize(self._quartiles())
        self.small = self.start.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        p = range(self.p)
        central = self.joined(self.start).selectExpr("_group", *[f"({x} - m_{i}) / d_{i} AS z_{i}" for i, x in enumerate(names)])
        central = central.selectExpr("*", f"sqrt({' + '.join(f'z_{i} * z_{i}' for i in p)} + {_TINY}D) AS _norm")
        kinds = [[f"tanh(z_{i})" for i in p], [f"z_{i} / _norm" for i in p], [f"if(_norm * _norm <= {self.p}, z_{i}, null)" for i in p]]
        told = ", ".join(f"named_struct('_k', {k}, {', '.join(f"'y_{i}', {v}" for i, v in enumerate(y))})" for k, y in enumerate(kinds))
        central = central.selectExpr("_group", f"inline(array({told}))").filter("y_0 is not null")
        shapes = central.groupBy("_group", "_k").agg(*_sums([f"y_{i}" for i in p]))
        shapes = shapes.join(self._small(self.start), "_group")
        self.within = self._scatter_within(materialize(shapes))
        self.estimates = self._first()

    def _small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table

    def joined(self, table: DataFrame) -> DataFrame:
        return self.rows.join(self._small(table), "_group")

    def _quartiles(self) -> DataFrame:
        """``_group, n`` and, of each statistic, ``m_i`` (median) and ``d_i`` (quartile range over 1.349, a cell at least)."""
        cells = self.rows.select("_group", F.posexplode(F.array(*self.names)).alias("_k", "_x")).groupBy("_group", "_k", F.floor(F.col("_x") / _STEP).alias("_cell")).agg(F.count("*").alias("_n"))
        w = W.partitionBy("_group", "_k")
        cells = cells.withColumn("_upto", F.sum("_n").over(w.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
        q = lambda share: F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col("_cell"))) * _STEP
        each = cells.groupBy("_group", "_k").agg(F.max("_all").alias("n"), (q(0.5) + _STEP / 2).alias("m"), F.greatest((q(0.75) - q(0.25)) / 1.349, F.lit(_STEP)).alias("d"))
        pick = lambda c: [F.max(F.when(F.col("_k") == i, F.col(c))).alias(f"{c}_{i}") for i in range(self.p)]
        return each.groupBy("_group").agg(F.max("n").alias("n"), *pick("m"), *pick("d"))

    def _scatter_within(self, shapes: DataFrame) -> dict[tuple[int, int], float]:
        """Scatter of central rows about their groups' medians, over all groups: one row of numbers."""
        self.shapes = shapes
        total = shapes.filter("_k = 2").agg(F.sum("s").alias("s"), *[F.expr(f"sum(s_{i}_{j} * d_{i} * d_{j})").alias(f"s_{i}_{j}") for i, j in _pairs(self.p)]).first()
        c = consistency(self.p, self.p)
        return {(i, j): c * total[f"s_{i}_{j}"] / total["s"] if total["s"] else float(i == j) for i, j in _pairs(self.p)}

    def _drawn(self, table: DataFrame, mean: list[str], scatter: dict[tuple[int, int], str]) -> DataFrame:
        """Estimates as written rows: ``_group, _k, n, m_i``, the inverse of the scatter drawn towards the scatter within groups, and ``logdet``."""
        keep = ["_group", "_k", "n", *[f"m_{i}" for i in range(self.p)]]
        weight = f"({self.prior}D / (n + {self.prior}D))"
        table = table.selectExpr("_group", "_k", "n", *[f"{m} AS m_{i}" for i, m in enumerate(mean)], *[f"(1 - {weight}) * {c} + {weight} * {self.within[i, j]!r}D AS c_{i}_{j}" for (i, j), c in scatter.items()])
        return materialize(_inverted(table, self.p, keep))

    def _first(self) -> DataFrame:
        """The three starts: medians, and the quartile ranges with each kind's correlations."""
        _, c = _moments(self.p)
        scale = [f"d_{i} / sqrt(greatest({c[i, i]}, {_TINY}D))" for i in range(self.p)]
        return self._drawn(self.shapes, [f"m_{i}" for i in range(self.p)], {(i, j): f"{c[i, j]} * {scale[i]} * {scale[j]}" for i, j in _pairs(self.p)})

    def distances(self, rows: DataFrame) -> DataFrame:
        """Adds ``_d``, the squared Mahalanobis distance under each of the group's estimates."""
        far = [f"({x} - m_{i})" for i, x in enumerate(self.names)]
        total = " + ".join(f"{1 if i == j else 2} * p_{i}_{j} * {far[i]} * {far[j]}" for i, j in _pairs(self.p))
        return rows.join(self._small(self.estimates), "_group").withColumn("_d", F.expr(f"greatest({total}, 0D)"))

    def cells(self, sums: bool = True) -> DataFrame:
        """Sums of the rows by cell of their distance: ``_group, _k, _cell, s...`` with ``_upto`` (rows up to the cell), ``_all`` and ``_near`` (the cell that reaches the share)."""
        found = self.distances(self.rows).groupBy("_group", "_k", F.expr(f"floor(log2(_d + {_TINY}D) * {_CELLS})").alias("_cell")).agg(*_sums(self.names if sums else []), F.max("n").alias("n"))
        w = W.partitionBy("_group", "_k")
        found = found.withColumn("_upto", F.sum("s").over(w.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("s").over(w))
        return found.withColumn("_near", F.min(F.when(F.col("_upto") >= self.share * F.col("_all"), F.col("_cell"))).over(w))

    def _edge(self) -> Column:
        """Upper edge of the cell that reaches the share, over the chi-squared quantile: 1 for normal rows."""
        return F.pow(F.lit(2.0), (F.col("_near") + 1) / _CELLS) / chi_squared(self.p, self.share)

    def concentrate(self, last: bool = False) -> None:
        """One step: location and scatter of the rows below the group's quantile of the distance; the ``last`` one takes all within the scaled chi-squared 0.975 bound."""
        bound = chi_squared(self.p, 0.975 if last else self.share)
        top = F.floor(F.log2(self._edge() * bound) * _CELLS) if last else F.col("_near")
        names = ["s", *[f"s_{i}" for i in range(self.p)], *[f"s_{i}_{j}" for i, j in _pairs(self.p)]]
        sums = self.cells().filter(F.col("_cell") <= F.greatest(top, F.col("_near"))).groupBy("_group", "_k").agg(*[F.sum(x).alias(x) for x in names], F.max("n").alias("n"))
        mean, c = _moments(self.p)
        self.estimates = self._drawn(sums, mean, {k: f"{consistency(self.p, bound)!r}D * {v}" for k, v in c.items()})

    def keep_least(self) -> None:
        """Of each group's estimates the one with the least determinant."""
        least = self.estimates.groupBy("_group").agg(F.min(F.struct("logdet", "_k")).alias("_l")).select("_group", F.col("_l._k").alias("_k"))
        self.estimates = materialize(self.estimates.join(self._small(least), ["_group", "_k"]))

    def settle(self, most: int, change: float) -> None:
        """Further steps while a group's logarithm of the determinant changes by more than ``change``."""
        for _ in range(most):
            before = self.estimates.select("_group", F.col("logdet").alias("_before"))
            self.concentrate()
            if self.estimates.join(self._small(before), "_group").filter(F.abs(F.col("logdet") - F.col("_before")) > change).isEmpty():
                return

    def scales(self) -> DataFrame:
        """``_group, _scale``: what distances are divided by so that the share of rows lies below the chi-squared quantile (1 at least)."""
        return materialize(self.cells(sums=False).groupBy("_group").agg(F.max(F.greatest(self._edge(), F.lit(1.0))).alias("_scale")))


def mcd_distances(points: DataFrame, names: list[str], group: list[str], share: float = 0.75, prior: float = 50.0, starts: int = 2, most: int = 6, change: float = 1e-2) -> DataFrame:
    """Adds ``distance`` to a written table: squared Mahalanobis distances under the group's estimate, scaled so that ``share`` of its distinct rows lie below the chi-squared quantile.

    ``names`` are columns of doubles without nulls; null group values are values like others. Each start takes ``starts`` steps, the best one at most ``most`` more, until no logarithm of a determinant changes by more than ``change``. A
    group of one distinct row has a distance of 0. Ties: rows in one cell of the distance are taken together, and equal determinants go to the earlier start. An empty table gives
    an empty one.
    """
    columns = points.columns
    own = F.to_json(F.struct(*[F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"k{i}") for i, g in enumerate(group)]))
    rows = points.withColumn("_group", own)
    groups = _Groups(materialize(rows.select("_group", *names).distinct()), names, share, prior)
    for _ in range(starts):
        groups.concentrate()
    groups.keep_least()
    groups.settle(most, change)
    groups.concentrate(last=True)
    out = groups.distances(rows).join(groups._small(groups.scales()), "_group")
    return out.select(*columns, (F.col("_d") / F.col("_scale")).alias("distance"))


def quality_rules(docs: DataFrame, tail: float = 1e-12, **options) -> DataFrame:
    """One row per document: its ``doc_id, lang, source``, base statistics, ``base_failed``, the transformed statistics, ``distance`` and ``kept``.

    ``tail`` is the share of normal rows beyond the bound; statistics of texts have longer tails, so it is far out. Null and empty texts have no words and fail. Rows are
    independent: null or repeated ids are kept; a null language or source is a group of its own; other columns are ignored. Rows that fail the base rules take no part in the
    estimates and have no distance.
    """
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    points = materialize(stats.withColumn("base_failed", failed).withColumns(transformed()).drop("text"))
    names = list(transformed())
    passed = mcd_distances(points.filter("not base_failed"), names, ["lang", "source"], **options)
    out = passed.unionByName(points.filter("base_failed").withColumn("distance", F.lit(None).cast("double")))
    far = F.coalesce(F.col("distance") > chi_squared(len(names), 1 - tail), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)
