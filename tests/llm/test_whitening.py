"""Whitening against numpy on the whole matrix."""

import numpy as np
import pytest

from hrefsieve.llm.whitening import Settings, fit, on_grid, whiten


def rows_of(spark, matrix, extra=()):
    rows = [(i, [float(x) for x in v], 7, "n") for i, v in enumerate(matrix)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string").repartition(3)


def plain(matrix):
    x = np.floor(1024 * np.asarray(matrix, np.float32).astype(float)) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n,width,spread", [(400, 40, 0.3), (500, 64, 0.0), (60, 12, 0.5), (9, 40, 0.2), (300, 5, 0.1)])
def test_components_equal_a_full_decomposition(spark, n, width, spread):
    rng = np.random.default_rng(n + width)
    matrix = rng.standard_normal((n, width)) * np.exp(-spread * np.arange(width))
    got = whiten(rows_of(spark, matrix)).collect()
    x, n, s, c, values, vectors = plain(matrix)
    k = min(8, width, n - 1)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1))
    white = np.zeros((n, k))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - s).astype(object) ** 2).sum())
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 and r["residual"] < 1e-10
    want = c @ vectors[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-6


def test_the_iteration_filters_and_is_certified(spark):
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((2000, 96)) / 10
    found = fit(on_grid(rows_of(spark, matrix)), 96, Settings(guard=8))
    values = plain(matrix)[4]
    assert found.passes > 10 and np.abs(found.values / values[:8] - 1).max() < 1e-12 and (found.residuals < 1e-11 * values[0]).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    matrix = np.vstack([rng.standard_normal((30, 10)), np.zeros((3, 10))])
    odd = [(None, [float(i) for i in range(10)], 1, "x"), (90, None, 1, "x"), (91, [], 1, "x"), (92, [1.0] * 9 + [None], 1, "x"), (93, [float("nan")] * 10, 1, "x"),
           (94, [float("inf")] + [0.0] * 9, 1, "x"), (95, [1.0] * 4, 1, "x"), (96, [3.0e38] * 10, 1, "x"), (97, [1.0e9] + [0.5] * 9, 1, "x")]
    got = whiten(rows_of(spark, matrix, odd)).collect()
    assert {r["vec_id"] for r in got} == {*range(33), None, 97}
    assert {r["n"] for r in got} == {35}
    big = next(r for r in got if r["vec_id"] == 97)
    x = np.vstack([matrix, [list(range(10))], [[1.0e9] + [0.5] * 9]]).astype(np.float32).astype(float)
    x = [[int(v) for v in row] for row in np.floor(1024 * x) + 100_000]
    s = [sum(col) for col in zip(*x)]
    exact = sum((35 * a - b) ** 2 for a, b in zip(x[-1], s))
    assert big["deviation"] == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("matrix", [np.zeros((0, 3)), np.ones((5, 3)), np.ones((1, 4))])
def test_without_variance_there_are_no_components(spark, matrix):
    assert whiten(rows_of(spark, matrix)).count() == 0


def test_equal_vectors_get_equal_rows(spark):
    matrix = np.repeat(np.random.default_rng(8).standard_normal((5, 6)), 4, axis=0)
    got = {}
    for r in whiten(rows_of(spark, matrix)).collect():
        got.setdefault((r["vec_id"] // 4, r["component"]), set()).add(round(r["whitened"], 12))
    assert len(got) == 5 * 4 and all(len(v) == 1 for v in got.values())
