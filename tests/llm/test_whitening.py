"""Whitening against numpy and exact arithmetic."""

import math
import random

import numpy as np
import pytest

from phasegrid.llm import exact_roots as roots
from phasegrid.llm import whitening as wh


def expected(vectors, scale=256):
    x = [[math.floor(scale * v) for v in row] for row in vectors]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    values, axes = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    return x, n, s, values[::-1], axes[:, ::-1]


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 7)) * np.array([3, 2, 1.5, 1, .5, .3, .1]) + 5
    vectors = base.tolist() + base[:120].tolist() + [base[0].tolist()] * 200
    rows = [(i, v, "a") for i, v in enumerate(vectors)]
    rows += [(9000, None, "b"), (9001, [1.0, None] + [0.0] * 5, "b"), (9002, [float("nan")] + [0.0] * 6, "b"),
             (9003, [float("inf")] + [0.0] * 6, "b"), (9004, [], "b"), (9005, [1.0], "b"), (None, vectors[3], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    got = wh.whiten(df).collect()
    x, n, s, values, axes = expected(vectors)
    assert len(got) == 4 * (len(vectors) + 1)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        column = (np.array(x) - np.array(s) / n) @ axes[:, k] / math.sqrt(values[k])
        mine = np.array([by[i, k + 1]["whitened"] for i in range(len(x))])
        sign = np.sign(mine @ column)
        assert np.abs(mine - sign * column).max() < 1e-9
        assert by[0, k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert by[None, k + 1]["whitened"] == by[3, k + 1]["whitened"]
    for i in (0, 77, 400):
        assert by[i, 1]["deviation"] == sum((n * a - b)**2 for a, b in zip(x[i], s))
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-9


def test_equal_variances_low_rank_and_nothing(spark):
    corners = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    got = wh.whiten(spark.createDataFrame(corners, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 8 and {r["explained"] for r in got} == {0.5} and got[0]["identity_error"] < 1e-12
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert wh.whiten(same).collect() == []
    assert wh.whiten(same.where("vec_id > 5")).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 + i * i, -1e13 * i, 3.0]) for i in range(6)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1).collect()
    x = [[int(c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((6 * a - b)**2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in want.items()}
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-4


def test_polynomial_and_roots():
    rng = random.Random(3)
    for size in (1, 2, 5, 9):
        a = np.array([[rng.randint(-30, 30) for _ in range(size)] for _ in range(size)], object)
        m = a.T @ a
        primes = roots.enough_primes(roots.coefficient_bound(sum(m[i, i] for i in range(size)), size))
        coefs = roots.recombine(primes, np.array([roots.polynomial_mod(m, p) for p in primes]))
        assert np.allclose(np.array(coefs, float), np.poly(m.astype(float)), rtol=1e-6)
        values = np.linalg.eigvalsh(m.astype(float))[::-1]
        for (v, power), w in zip(roots.largest_roots(coefs, size), values):
            assert v / (1 << power) == pytest.approx(w, rel=1e-6)
        assert roots.roots_above(coefs, 0) == int((values > 1e-6).sum())
    twice = [1, -10, 33, -36, 0]      # x (x - 3)^2 (x - 4)
    assert [v / (1 << p) for v, p in roots.largest_roots(twice, 4)] == [4.0, 3.0, 3.0]
    assert [p for p, _ in zip(roots.primes_below(30), range(4))] == [29, 23, 19, 17]
