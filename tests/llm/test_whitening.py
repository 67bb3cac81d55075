"""The whitening solver against numpy, and the operator against a brute-force version."""

import numpy as np
import pytest

from faretrail.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x long, n int"


def matrices():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 48):
        yield rng.standard_normal((d, d))
        yield np.triu(rng.standard_normal((d, d))) * np.exp(-20 * rng.random(d))  # far apart
        yield np.eye(d) * rng.integers(1, 3, d)  # equal values
        yield rng.standard_normal((d, 1)) @ rng.standard_normal((1, d))  # one direction
        yield np.zeros((d, d))


@pytest.mark.parametrize("m", list(matrices()))
def test_solver_matches_numpy(m):
    d = len(m)
    a, b, w = whitening.bidiagonalise(m)
    want = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(w.T @ w, np.eye(d), atol=1e-12)
    got = np.sqrt(whitening.squared_singular_values(a, b))
    assert np.allclose(got, want, rtol=1e-10, atol=1e-13 * max(want[0], 1e-300) * d)
    e, v, total = whitening.directions(m, 1, min(16, d))
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-9)
    assert np.abs(m.T @ m @ v - v * e).max() <= 1e-10 * max(want[0], 1e-300) ** 2 * d
    assert total == pytest.approx((want**2).sum(), rel=1e-10)


def test_small_singular_values_keep_their_relative_accuracy():
    a, b = np.array([1.0, 1e-6, 1e-12]), np.array([1.0, 1e-6])
    got = np.sqrt(whitening.squared_singular_values(a, b))
    assert np.prod(got) == pytest.approx(np.prod(a), rel=1e-12)


def brute(rows, count=16):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) + 1_000_000 for i, v in enumerate(dict(enumerate(u[1] for u in usable)).values())}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1], vec[:, ::-1]
    return usable, x, n, s, e, vec


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 20)) * np.linspace(0.2, 2, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(400)]  # a hot vector counts once in the fit
    docs = spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], SCHEMA).repartition(37)
    got = whitening.whiten(docs).collect()
    usable, x, n, s, e, vec = brute(rows)
    assert len(got) == len(rows) * 16
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for k, (i, _) in enumerate(usable):
        for c in range(1, 17):
            r = by_id[i][c]
            want = (x[k] - s / n) @ vec[:, c - 1] / np.sqrt(e[c - 1])
            sign = signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign * want, abs=1e-8)
            assert (r["n"], r["deviation"]) == (n, int(sum(int(t) ** 2 for t in n * x[k] - s)))
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (None, [3.0, 2.0]), (7, [1.0, 2.0, 3.0]), (8, [1e30, 1.0]), (9, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    assert {r["n"] for r in got} == {3}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "", 1, 1)], SCHEMA)).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(0.0, 0.0, 0, 0.0)] * 2
