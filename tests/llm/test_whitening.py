"""Whitening against numpy and plain integers; refinement on clustered spectra."""

import numpy as np
import pytest

from loanlens.llm import whitening


def plain(vectors):
    """n, exact sums, integers of the whole vectors of the most common length."""
    whole = [v for v in vectors if v and None not in v and np.isfinite(v).all()]
    sizes = [len(v) for v in whole]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in whole if len(v) == dim]
    return x, [sum(c) for c in zip(*x)]


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 40)) * np.linspace(0.5, 8, 40) + 3.7
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(300, None, "x"), (301, [], "x"), (302, [float("nan")] * 40, "x"), (303, [1.0] * 39 + [None], "x"), (304, [float("inf")] + [1.0] * 39, "x"), (305, [1.0, 2.0], "x")]
    rows += [rows[5], rows[5], (None, rows[7][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(4)
    got = whitening.whiten(frame).collect()
    x, s = plain([r[1] for r in rows])
    n = len(x)
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    far = sorted(sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x)
    assert sorted(r.deviation for r in got if r.component == 1) == far
    z = np.array([[float(v * n - t) / n for v, t in zip(row, s)] for row in x])
    cov = z.T @ z / n
    value, vec = np.linalg.eigh(cov)
    value, vec = value[::-1], vec[:, ::-1]
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[k + 1] for k in range(32)], value[:32] / np.trace(cov), rtol=1e-10)
    key = {i: row for i, row in zip(range(300), z)}
    for r in got:
        if r.vec_id is not None and r.vec_id != 5:
            assert abs(abs(r.whitened) - abs(key[r.vec_id] @ vec[:, r.component - 1]) / value[r.component - 1] ** 0.5) < 1e-8
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-9, 1e-4])
def test_clustered_eigenvalues(gap):
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last digit
        q = q @ (1.5 * np.eye(30) - 0.5 * q.T @ q)
    true = np.array([9.0] * 1 + [5 + gap * k for k in range(6)] + [5e-3 + gap * k for k in range(4)] + [1 / (k + 1) for k in range(19)])
    a = (q * true) @ q.T
    value, x = whitening.refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    assert np.allclose(value, np.sort(true)[::-1], rtol=0, atol=1e-15 * 9)
    x = x.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-15
    assert np.abs(a @ x - x * value).max() < 4e-15
    # inside a cluster too, x diagonalises a as far as doubles can tell
    inner = x.T @ a @ x
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 4e-15


def test_better_than_single_precision():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(500, 64))
    a = m.T @ m / 500
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    value, x = whitening.components(a)
    off = lambda y: np.abs((d := y.T @ a @ y) - np.diag(np.diag(d))).max()
    assert off(rough) > 1e-8 and off(x) < 1e-14


def test_exact_deviations():
    rng = np.random.default_rng(2)
    for size, n in ((100, 50), (1 << 20, 10**6), (1 << 20, 10**10), (1 << 59, 7)):
        x = rng.integers(-size, size, (20, 5)) + 1_000_000
        s = [int(v) * n // 20 + k for k, v in enumerate(x.astype(object).sum(axis=0))]
        assert whitening.deviations(x, n, s) == [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]


def test_no_variance_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    got = whitening.whiten(same).collect()
    assert len(got) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in got)
    flat = spark.createDataFrame([(i, [float(i), 2.0, 3.0 * i]) for i in range(5)], schema)
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and {r.component for r in got} == {1, 2, 3}
    assert np.allclose(sorted(r.whitened for r in got if r.component == 1), np.array([-2, -1, 0, 1, 2]) / 2 ** 0.5)
    for empty in (same.limit(0), spark.createDataFrame([(1, None), (2, [])], schema)):
        assert whitening.whiten(empty).collect() == []
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])], schema)
    got = whitening.whiten(huge).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 3) and {r.component for r in got if r.whitened is not None} == {1}
