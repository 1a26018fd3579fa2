"""Whitening against numpy's own decomposition and Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vouch.llm import whitening as W
from vouch.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, n int"


def plain(rows, top=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - t) / n for c, t in zip(x, s, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:top]
    out = {}
    for i, x in kept:
        y = np.array([(n * c - t) / n for c, t in zip(x, s, strict=True)])
        out.setdefault(i, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), y @ vectors[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / values.sum()


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_components_of_random_matrices(d):
    rng = np.random.default_rng(d)
    for kind in range(4):
        a = rng.standard_normal((d, d))
        m = a @ a.T
        if kind == 1:  # equal eigenvalues
            q, _ = np.linalg.qr(a)
            m = q @ np.diag(np.repeat([5.0, 2.0, 1.0, 0.5], -(-d // 4))[:d]) @ q.T
        elif kind == 2:
            m = np.diag(np.arange(d, 0, -1.0))
        elif kind == 3:  # nearly equal ones
            q, _ = np.linalg.qr(a)
            m = q @ np.diag(1 + 1e-9 * np.arange(d)) @ q.T
        values, vectors = W.leading_components(m, 16)
        own = np.linalg.eigvalsh(m)[::-1][:16]
        assert np.allclose(values, own, rtol=1e-12, atol=1e-13 * abs(own).max())
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * abs(own).max() * max(d, 4)


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    own = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.standard_normal(50) * 3
    assert W.sturm_counts(diagonal, off, at).tolist() == [(own < x).sum() for x in at]


def test_deviations_beyond_a_long():
    x = np.array([[10**15 + 7, 3], [1, 2]])
    n, sums = 10**4, np.array([5, 6])
    expected = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert W.deviations(x, n, sums) == [None if v >= 1 << 63 else v for v in expected]
    assert expected[0] >= 1 << 63


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    vectors = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    check(W.whitened(vectors).collect(), rows)


def check(found, rows):
    n, expected, explained = plain(rows)
    by_row = {}
    for r in found:
        assert r.n == n and abs(r.explained - explained[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for i, copies in expected.items():
        for deviation, y in copies:
            own = np.array([by_row[i, deviation][k + 1][0] for k in range(len(y))])
            if signs is None and np.abs(y).min() > 1e-6:
                signs = np.sign(y * own)
            assert np.allclose(np.abs(own), np.abs(y), atol=1e-8)
            assert signs is None or np.allclose(own * signs, y, atol=1e-8)
    assert len(found) == sum(len(c) for c in expected.values()) * len(explained)


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(5)]) for i in range(40)]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])] * 30
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0]), (206, [1e30] * 5)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).repartition(5)
    found = W.whitened(vectors).collect()
    assert {r.vec_id for r in found}.isdisjoint(range(200, 210)) and {r.component for r in found} == {1, 2, 3, 4, 5}
    check(found, rows)


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    assert W.whitened(none).collect() == [] and W.whitened(one).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 3.0], 1) for i in range(5)], SCHEMA)
    assert {r.component for r in W.whitened(flat).collect()} == {1}
