import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from minpairs.llm import whiten


@pytest.fixture(scope="module")
def table_of(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows],
                                     f"vec_id long, embedding array<{kind}>").repartition(3)
    return make


def quantised(rows, kind=np.float32):
    out = []
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(kind(c)) for c in v):
            out.append((i, tuple(math.floor(256 * float(kind(c))) for c in v)))
    return out


def check(got, rows, components=4, vectors=True, kind=np.float32):
    """Against exact sums, and numpy's eigenvectors of the exact covariance."""
    whole = quantised(rows, kind)
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n ** 3)) for j in range(d)] for i in range(d)])
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1], u[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, min(components, d) + 1))
    for c, found in by.items():
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in found) == sorted((str(i), sum((n * v - t) ** 2 for v, t in zip(x, s))) for i, x in whole)
        assert {r["n"] for r in found} == {n}
        explained = values[c - 1] / np.trace(cov)
        assert all(abs(r["explained"] - explained) <= 1e-10 * max(explained, 1e-3) for r in found)
        assert all(r["identity_error"] <= 1e-9 for r in found)
        if vectors:
            plain = {}
            for i, x in whole:
                plain.setdefault(str(i), []).append(float((np.array(x) - np.array(s) / n) @ u[:, c - 1] / math.sqrt(values[c - 1])))
            best = min(max(abs(sign * w - p) for r in found for w, p in [(r["whitened"], min(plain[str(r["vec_id"])], key=lambda p: abs(sign * r["whitened"] - p)))])
                       for sign in (1, -1))
            assert best < 1e-9


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    return [(i, (r.normal(size=d) @ mix).tolist()) for i in range(n)]


def test_against_plain_numbers(table_of):
    rows = vectors(300, 12) + [(500 + i, v) for i, (_, v) in enumerate(vectors(40, 12))] + [(900, vectors(1, 12)[0][1])] * 200
    odd = [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] + [0.0] * 11), (1004, []), (None, vectors(2, 12)[1][1])]
    df = table_of(rows + odd).withColumns({c: F.lit(1) for c in ("x", "v", "n", "part", "component")})
    check(whiten.whiten(df).collect(), rows + odd)


def test_large_and_far_from_zero(table_of):
    rows = [(i, [c * 1000 + 5e4 for c in v]) for i, v in vectors(120, 5, 1)]
    check(whiten.whiten(table_of(rows, "double")).collect(), rows, kind=float)
    huge = [(i, [c * 1e9 for c in v]) for i, v in vectors(30, 3, 2)]  # products beyond doubles
    got = whiten.whiten(table_of(huge, "double")).collect()
    assert len(got) == 90 and all(r["identity_error"] <= 1e-9 for r in got)
    whole = quantised(huge, float)
    s = [sum(x[j] for _, x in whole) for j in range(3)]
    exact = {i: sum((30 * v - t) ** 2 for v, t in zip(x, s)) for i, x in whole}
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 2**63 else None) for r in got)


def test_other_lengths_and_few_dimensions(table_of):
    rows = vectors(20, 2, 3)
    check(whiten.whiten(table_of(rows + [(99, [1.0, 2.0, 3.0]), (98, [1.0])])).collect(), rows)


def test_components_without_variance(table_of):
    rows = [(i, [float(i), 2.0 * i, 7.0, 0.0, 1.0]) for i in range(10)]
    got = whiten.whiten(table_of(rows)).collect()
    assert len(got) == 40
    for r in got:
        assert (r["whitened"] is None) == (r["component"] > 1) and (r["explained"] == 0) == (r["component"] > 1) and r["identity_error"] < 1e-9
    one = whiten.whiten(table_of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["whitened"] is None and r["deviation"] == 0 for r in one)


def test_empty_tables(table_of):
    assert whiten.whiten(table_of([])).collect() == []
    assert whiten.whiten(table_of([(1, None), (2, [None])])).collect() == []


def matrix(values, seed=0):
    d = len(values)
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ ((np.eye(d) - q.T @ q) / 2)
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values, far", [
    (np.linspace(1, 64, 64)[::-1], 1e-16),
    (np.concatenate([[10, 10 - 1e-6, 9, 9 - 1e-5], np.linspace(5, 0.1, 40)]), 1e-11),  # close pairs, near the single-precision solve's error
    (np.concatenate([[10, 10 - 1e-9], np.linspace(5, 0.1, 40)]), 1e-8),
    (np.repeat([5.0, 4.0, 3.0], 8) - 1e-7 * np.arange(24), 1e-10),  # clusters
    (np.sort(1 + 1e-5 * np.random.default_rng(3).normal(size=40))[::-1], 1e-10),  # all in one cluster
    (2.0 ** -np.arange(30), 1e-9),
])
def test_eigenvectors_to_double_precision(values, far):
    a, q = matrix(values)
    got, x = whiten.eigen(a)
    assert np.abs(got - values).max() < 1e-16 * values.max() * len(values)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17 and np.abs(a @ x - x * got).max() < 1e-15 * values.max()
    assert np.abs(x - q * np.sign((q * x).sum(axis=0)))[:, :4].max() < far


def test_equal_eigenvalues():
    for a in (np.eye(7), np.zeros((3, 3)), matrix([3.0] * 5 + [1.0] * 5)[0]):
        values, x = whiten.eigen(a)
        assert np.abs(a @ x - x * values).max() < 1e-16 and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-16
    assert whiten.eigen(np.empty((0, 0)))[0].shape == (0,)
