"""Whitening against NumPy's eigenvectors and exact integers."""

import math
import random

import numpy as np
import pytest

from quantloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, part string, n int"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1) for i, v in rows], SCHEMA).repartition(parts)


def vectors(count, dims, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(count, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 5
    return [[float(np.float32(c)) for c in v] for v in mixed]


def brute(rows, most=16):
    whole = [(i, tuple(math.floor(c * 64) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(d) for d in zip(*fit, strict=True)]
    apart = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = apart.T @ apart / n
    values, components = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:most]
    out = []
    for i, x in whole:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k, j in enumerate(order, 1):
            out.append((i, k, n, sum(o * o for o in off), float(np.array(off) / n @ components[:, j] / math.sqrt(values[j])), values[j] / values.sum()))
    return out


@pytest.mark.parametrize("dims", [3, 24])
def test_equals_numpy(spark, dims):
    rows = list(enumerate(vectors(300, dims)))
    rows += [(1000, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])]
    found = whitening.whiten(table(spark, rows)).collect()
    want = {}
    for i, k, n, deviation, white, explained in brute(rows):
        want.setdefault((i, k), []).append((n, deviation, white, explained))
    assert len(found) == len(rows) * min(dims, 16)
    turned = {}
    for r in found:
        n, deviation, white, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9)
        if abs(white) > 1e-6:
            turned.setdefault(r.component, set()).add(round(r.whitened / white, 6))
        assert abs(r.whitened) == pytest.approx(abs(white), rel=1e-6, abs=1e-6)
        assert r.identity_error < 1e-9
    assert all(len(x) == 1 for x in turned.values())  # one sign for all rows of a component


def test_bad_vectors_and_odd_tables(spark):
    good = vectors(40, 4)
    rows = list(enumerate(good)) + [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [float("nan"), 1.0, 1.0, 1.0]), (54, [1.0, float("-inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e30, 0.0, 0.0, 0.0])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in found} == set(range(40)) and {r.n for r in found} == {40}
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # nothing varies
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_merge_equals_streaming_and_does_not_depend_on_the_split():
    rng = random.Random(1)
    rows = np.array([[rng.randrange(-50, 50) + 10**6 for _ in range(5)] for _ in range(200)], np.int64)
    whole = whitening.Moments(5)
    whole.add(rows)
    for cuts in ([0, 1, 200], [0, 50, 50, 120, 200], [0, 199, 200]):
        total = whitening.Moments(5)
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = whitening.Moments(5)
            part.add(rows[a:b])
            total.merge(part)
        assert (total.n, total.sums) == (whole.n, whole.sums) == (200, rows.sum(0).tolist())
        assert np.allclose(total.covariance(), np.cov(rows.T, bias=True), rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a + a.T, a @ a.T, np.eye(n), np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n))):
        values, q = whitening.symmetric_qr(m)
        scale = max(1.0, np.abs(m).max()) * n
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-13 * scale)
        assert np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n and np.abs(m @ q - q * values).max() < 1e-13 * scale


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**19 * i), float(-(2**20) * (i % 3))]) for i in range(5)]
    for r in whitening.whiten(table(spark, rows)).where("component = 1").collect():
        assert (r.n, r.deviation) == (5, {i: d for i, k, _, d, *_ in brute(rows) if k == 1}[r.vec_id])
