"""Whitening: rank-one updates against direct decompositions, the operator against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from budgetlens.llm import whitening


@settings(max_examples=150, deadline=None)
@given(hnp.arrays(float, st.tuples(st.integers(1, 25), st.integers(1, 7)), elements=st.integers(-3, 3).map(float)))
def test_updates_equal_direct_decomposition(x):
    d = x.shape[1]
    a, b, c = (whitening.Spectrum.of_none(d) for _ in range(3))
    for k, v in enumerate(x):
        (a if k % 2 else b).add(v)
    a.join(b)
    c.add_block(x[: len(x) // 2 + 1])
    c.add_block(x[len(x) // 2 + 1:])
    apart = x - x.mean(axis=0)
    scatter = apart.T @ apart
    for s in (a, c):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), atol=1e-12)
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-11
        assert np.abs(s.basis * s.roots @ s.basis.T - scatter).max() < 1e-11 * (1 + np.abs(scatter).max())
        assert (np.diff(s.roots) >= -1e-11).all()


def test_roots_solve_the_secular_equation():
    rng = np.random.default_rng(3)
    d, z = np.sort(rng.normal(size=30)), rng.normal(size=30)
    roots, gap = whitening.secular_roots(d, z * z, 0.7)
    assert (roots[:-1] > d[:-1]).all() and (roots[:-1] < d[1:]).all() and roots[-1] > d[-1]
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))), roots, atol=1e-12)
    assert np.allclose(gap, d[None, :] - roots[:, None], atol=1e-12)


def plain(rows, k):
    """(rows kept, n, deviation, eigenvalues, whitened up to sign, explained) by numpy."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return kept, n, deviation, y @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_whiten_equals_numpy(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    x = (rng.normal(size=(900, 40)) * np.linspace(3, 0.4, 40)) @ turn
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (1001, None), (1002, [None] * 40), (1003, [float("nan")] * 40),
             (1004, [float("inf")] + [0.0] * 39), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 5.0) for r in rows], "vec_id long, embedding array<float>, whitened double")
    kept, n, deviation, want, explained = plain(rows[:-1], 32)
    got = whitening.whiten(df.repartition(13)).collect()
    assert len(got) == len(kept) * 32 and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and 0 <= got[0]["identity_error"] < 1e-9
    by: dict = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for k in range(1, 33):
        rows_k = by[k]
        assert rows_k[0][0]["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
        sign = np.sign(rows_k[0][0]["whitened"] * want[0, k - 1])
        for (i, _), d, w in zip(kept, deviation, want[:, k - 1], strict=True):
            r = rows_k[i][0]
            assert r["deviation"] == d and r["whitened"] == pytest.approx(sign * w, rel=1e-7, abs=1e-9)
        assert len(rows_k[7]) == 2


def test_whiten_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, whitening.whiten(df.repartition(k)).drop("identity_error").collect())) for k in (1, 20))
    assert len(one) == 1800
    for a, b in zip(one, many, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-10)


def test_whiten_few_or_flat(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [tuple(r) for r in one] == [(1, k, 1, 0, 0.0, 0.0, 0.0) for k in (1, 2)]
    # The second entry never changes: one component with variance, one without.
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 3.0]) for k in range(4)], schema)).collect()
    assert sorted({r["component"] for r in flat}) == [1, 2]
    assert all(r["whitened"] == 0.0 and r["explained"] == 0.0 for r in flat if r["component"] == 2)
    assert flat[0]["identity_error"] < 1e-12
    big = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [5e8])], schema)).collect()
    assert [r["deviation"] for r in big] == [None, None]
