"""Operator 1's vectors, distances and verdicts over a whole table against a computation in numpy, and planted outliers."""

import math
import re

import numpy as np
import pytest
import xxhash

from volspan.llm import robust
from volspan.llm.common import read_table
from volspan.llm.queries import op1_robust_outliers

from .test_operators import base

SF = "/root/testdata/sf0.01"


def vector(text, words):
    n, chars, symbols, dup, rep, _ = words
    bits = xxhash.xxh64_intdigest(text.encode(), 42)
    u = [(bits >> 20 * k & (1 << 20) - 1) / (1 << 20) for k in range(3)]
    distinct = len({w for w in re.findall(r"[^\x20\x09-\x0D]+", text)})
    return (math.log1p(n), math.log(chars / n), math.sqrt((symbols + u[0]) / (chars + 1)), math.sqrt((dup + u[1]) / (n + 1)), math.log((rep + 8 * u[2] + 1) / (n + 1)), math.log1p(distinct) / math.log1p(n))


def direct(groups, share=0.75, prior=50.0, starts=2, most=6, change=1e-2):
    """Distances of each group's rows by plain loops over groups; ``groups``: name to array of rows."""
    p = next(iter(groups.values())).shape[1]
    rows = {g: np.unique(x, axis=0) for g, x in groups.items()}
    cell = lambda d: np.floor(np.log2(d + 1e-12) * 16)
    start, shapes, total, seen = {}, {}, np.zeros((p, p)), 0
    for g, x in rows.items():
        c = np.sort(np.floor(x * 256), axis=0)
        q = lambda s, c=c: c[math.ceil(s * len(c)) - 1] / 256
        m, d = q(0.5) + 1 / 512, np.maximum((q(0.75) - q(0.25)) / 1.349, 1 / 256)
        z = (x - m) / d
        norm = np.sqrt((z * z).sum(axis=1) + 1e-12)
        central = z[norm * norm <= p]
        start[g], shapes[g] = (m, d), [np.tanh(z), z / norm[:, None], central]
        total += central.T @ central * np.outer(d, d)
        seen += len(central)
    within = robust.consistency(p, p) * total / seen

    def drawn(n, c):
        return (1 - prior / (n + prior)) * c + prior / (n + prior) * within

    cov = lambda y: np.cov(y.T) if len(y) > 1 else np.zeros((p, p))
    now = {}
    for g, kinds in shapes.items():
        m, d = start[g]
        for k, y in enumerate(kinds):
            if len(y):
                c = cov(y)
                s = d / np.sqrt(np.maximum(np.diag(c), 1e-12))
                now[g, k] = (m, drawn(len(rows[g]), c * np.outer(s, s)))

    def far(x, e):
        return np.maximum(np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0]), 0)

    def near(d):
        return np.sort(cell(d))[math.ceil(share * len(d)) - 1]

    def step(e, x, last=False):
        d = far(x, e)
        top, bound = near(d), robust.chi_squared(p, 0.975 if last else share)
        if last:
            top = max(top, np.floor(np.log2(2 ** ((top + 1) / 16) / robust.chi_squared(p, share) * bound) * 16))
        y = x[cell(d) <= top]
        return y.mean(axis=0), drawn(len(x), robust.consistency(p, bound) * cov(y))

    det = lambda e: np.linalg.slogdet(e[1])[1]
    for _ in range(starts):
        now = {k: step(e, rows[k[0]]) for k, e in now.items()}
    now = {g: min((e for k, e in sorted(now.items(), key=lambda i: i[0][1]) if k[0] == g), key=det) for g in rows}
    for _ in range(most):
        before, now = now, {g: step(e, rows[g]) for g, e in now.items()}
        if all(abs(det(now[g]) - det(before[g])) <= change for g in rows):
            break
    now = {g: step(e, rows[g], True) for g, e in now.items()}
    scale = {g: max(1, 2 ** ((near(far(rows[g], e)) + 1) / 16) / robust.chi_squared(p, share)) for g, e in now.items()}
    return {g: far(groups[g], e) / scale[g] for g, e in now.items()}


def test_whole_table(spark):
    rows = read_table(spark, SF, "documents").collect()
    words = [base(r["text"]) for r in rows]
    groups = {}
    for k, (r, w) in enumerate(zip(rows, words, strict=True)):
        if not w[-1]:
            groups.setdefault((r["lang"], r["source"]), []).append((k, vector(r["text"], w)))
    found = direct({g: np.array([v for _, v in x]) for g, x in groups.items()})
    want = {rows[k]["doc_id"]: d for g, x in groups.items() for (k, _), d in zip(x, found[g].tolist(), strict=True)}
    bound = robust.chi_squared(6, 1 - 1e-12)
    got = op1_robust_outliers(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        d = want.get(r["doc_id"])
        assert r["base_failed"] == (d is None) and (d is None) == (r["distance"] is None)
        assert d is None or r["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert r["kept"] == (d is not None and d <= bound)
    assert any(d > bound for d in want.values())


def test_planted_outliers_and_copies(spark):
    rng = np.random.default_rng(2)
    cov = np.array([[1, 0.8], [0.8, 1]])
    points = [("a", *x) for x in rng.multivariate_normal([0, 5], cov, 700).tolist()] + [("a", 2.5, 2.5 + k / 100) for k in range(60)]
    points += [("b", 1.0, 2.0)] * 900 + [("b", *x) for x in rng.multivariate_normal([1, 2], cov, 200).tolist()] + [("c", 0.0, 0.0), ("d", 1.0, 2.0), ("d", 1.5, 2.4)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(points)], "id int, g string, x double, y double")
    got = {r["id"]: r["distance"] for r in robust.mcd_distances(df, ["x", "y"], ["g"]).collect()}
    bound = robust.chi_squared(2, 1 - 1e-4)
    assert all(got[k] > bound for k in range(700, 760)), "off the axis of the group, though within its range"
    assert sum(got[k] > bound for k in range(700)) <= 3
    assert sum(got[k] > bound for k in range(760, 1860)) <= 3, "900 copies don't make the group narrow"
    assert got[1860] == 0 and max(got[1861], got[1862]) < bound
    groups = {g: np.array([x[1:] for x in points if x[0] == g]) for g in "abcd"}
    want = direct(groups)
    assert [got[k] for k in range(len(points))] == pytest.approx(np.concatenate([want[g] for g in "abcd"]).tolist(), rel=1e-6, abs=1e-9)


def test_chi_squared():
    assert robust.chi_squared_below(6, 5.348) == pytest.approx(0.5, abs=1e-3) and robust.chi_squared_below(1, 3.841) == pytest.approx(0.95, abs=1e-4)
    assert robust.chi_squared(6, 0.975) == pytest.approx(14.449, rel=2e-3)
