"""Embedding whitening against numpy, and the solver on matrices that are hard for it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from keyedflow.llm import whitening
from keyedflow.llm.bidiagonal import bidiagonal, right_singular, squared_values


def hard_matrices():
    rnd = np.random.default_rng(0)
    r = lambda x: np.linalg.qr(x, mode="r")
    repeated = rnd.standard_normal((400, 16))
    repeated[:, 8:] = repeated[:, :8]
    yield "random", rnd.standard_normal((64, 64))
    yield "close values", r(rnd.standard_normal((50_000, 48)))
    yield "identity", np.eye(20)
    yield "zero", np.zeros((5, 5))
    yield "one", np.array([[3.0]])
    yield "equal pairs", np.diag([1.0, 1, 2, 2, 0, 0])
    yield "few rows", np.vstack([r(rnd.standard_normal((10, 30))), np.zeros((20, 30))])
    yield "repeated columns", r(repeated)
    yield "graded", np.diag(10.0 ** -np.arange(16)) + np.diag(np.ones(15) * 1e-3, 1)
    yield "graded up", np.diag(10.0 ** np.arange(16)) + np.diag(np.ones(15) * 1e-3, 1)
    yield "wilkinson", np.diag(np.arange(21) - 10.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield "equal blocks", np.kron(np.eye(6), rnd.standard_normal((5, 5)))


@pytest.mark.parametrize("name, matrix", list(hard_matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_solver(name, matrix):
    values, vectors = right_singular(matrix, len(matrix))
    square, top = matrix.T @ matrix, max(values.max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(square)[::-1], atol=1e-13 * top, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-11
    assert np.abs(square @ vectors - vectors * values).max() < 1e-13 * top


def test_small_values_keep_their_digits():
    # Known for 2 x 2: the product of the singular values is the determinant.
    a, b = np.array([1.0, 1e-9]), np.array([0.5])
    values = squared_values(a, b)
    assert math.isclose(values[0] * values[1], 1e-18, rel_tol=1e-12)
    matrix = np.random.default_rng(1).standard_normal((9, 9))
    a, b, right = bidiagonal(matrix)
    both = np.diag(a) + np.diag(b, 1)
    assert np.allclose(right @ both.T @ both @ right.T, matrix.T @ matrix)


def checked(rows: list, keep: list[int], got: list, components: int = 32) -> None:
    """Result rows against numpy on the vectors ``keep``, which have the same length."""
    raw = np.array([rows[i][1] for i in keep], dtype=np.float32).astype(float)
    x = np.floor(raw * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = x - sums / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, x.shape[1])
    assert len(got) == n * k
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    white = np.array([r.whitened for r in got]).reshape(n, k)
    for at, i in enumerate(keep):
        own = got[at * k : at * k + k]
        assert {r.vec_id for r in own} == {rows[i][0]} and [r.component for r in own] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, deviation[at])}
    real = values[:k] > 1e-12 * max(values[0], 1e-300)
    assert np.allclose([r.explained for r in got[:k]], np.where(real, values[:k] / max(values.sum(), 1e-300), 0), rtol=1e-8, atol=0)
    assert np.abs(white.T @ white / n - np.diag(real.astype(float))).max() < 1e-6
    # Projections of eigenvectors: V p = e p for p = X' w / (n sqrt(e)).
    axes = centred.T @ white[:, real] / n
    assert np.allclose(cov @ axes, axes * values[:k][real], atol=1e-6 * values[0])
    assert max(r.identity_error for r in got) < 1e-6


def test_whiten(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rnd.standard_normal(40) * np.linspace(1, 0.05, 40)], 0) for i in range(700)]
    rows += [(700 + i, rows[7][1], 0) for i in range(300)]  # one very common vector
    odd = [(2000, None, 0), (2001, [1.0] * 39 + [None], 0), (2002, [float("nan")] * 40, 0), (2003, [float("inf")] * 40, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(37)
    got = whitening.whiten(df)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    checked(rows, range(len(rows)), got.collect())


def test_triangles_are_merged_in_rounds(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.standard_normal(5).tolist()) for i in range(200)]
    df = whitening.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(23))
    m = whitening.moments(df)
    x = np.floor(np.array([r[1] for r in rows]) * 64)
    x = x - x.mean(axis=0)
    for fan in (2, 16):
        r = whitening.triangle(df, m, fan)
        assert r.shape == (5, 5) and np.allclose(r.T @ r, x.T @ x)


@pytest.mark.parametrize("vectors", [[[0.5, 1.0]], [[1.0, 2.0]] * 4, [[1.0, 5.0, 2.0], [3.0, 5.0, 2.0]], [[i / 7, 2 * i / 7, 1.0, i * i / 9] for i in range(6)]])
def test_directions_without_variance(spark, vectors):
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    checked(rows, range(len(rows)), got)
    assert all(r.whitened == 0 for r in got if r.explained == 0)


def test_awkward_vectors(spark):
    rows = [(None, [1.0, 2.0]), (1, [3.0]), (1, [3.0]), (2, []), (3, [1e300, -1e300]), (4, [4.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 and all(math.isfinite(r.whitened) for r in got)
    assert {r.vec_id: r.deviation for r in got}[3] is None
    none = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>")
    assert whitening.whiten(none).collect() == [] == whitening.whiten(none.where("vec_id > 5")).collect()
