import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from galley.llm import whitening


def brute(rows, k=16):
    """Distinct integer vectors, exact sums and deviations, eigenvectors of the dense covariance."""
    sound = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = np.array([[float(Fraction(n * int(c) - s, n)) for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    e, vectors = np.linalg.eigh(covariance)
    order = [j for j in np.argsort(-e) if e[j] > 1e-12 * e.max()][:k]
    told = {}
    for i, x in sound:
        row = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        white = [float(row @ vectors[:, j]) / math.sqrt(e[j]) for j in order]
        told[i] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), white)
    return told, [float(e[j] / np.trace(covariance)) for j in order]


def compare(df, rows, k=16):
    told, explained = brute(rows, k)
    got = whitening.whiten(df, k).collect()
    assert len(got) == len(explained) * sum(1 for i, _ in rows if i in told)
    signs = {}
    for r in got:
        n, deviation, white = told[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        want = white[r.component - 1]
        if abs(want) > 1e-3:
            signs.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert r.whitened == pytest.approx(signs.get(r.component, 1) * want, abs=1e-6)


def test_against_dense(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 20)) @ np.diag(np.linspace(1, 3, 20))
    points[100:400] = points[100]
    rows = [(i, list(map(float, p))) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    compare(df, rows)
    compare(df, rows, 3)


def test_low_rank_and_wide(spark):
    rng = np.random.default_rng(4)
    points = (rng.integers(-50, 50, size=(300, 4)) @ rng.integers(-3, 3, size=(4, 24))).astype(float)
    points[:, 23] = 7.0
    rows = [(i, list(map(float, p))) for i, p in enumerate(points)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
    far = [(i, [float(200_000 * (i % 3)), float(i), float(i * i)]) for i in range(40)]
    compare(spark.createDataFrame(far, "vec_id long, embedding array<double>"), far)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (None, [3.0, 1.0]), (6, []),
            (7, [3.0]), (8, [1e300, -1e300, 1.0]), (9, [0.0, 5.0, 1.0]), (10, [4.0, 4.0, 4.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x string, dims int, n int")
    got = whitening.whiten(df).collect()
    # Lengths 1 and 4 have a single vector and no variance; 2 has three vectors in a plane, 3 has two on a line.
    assert Counter(r.vec_id for r in got) == Counter({0: 4, 1: 2, None: 2, 8: 1, 9: 1})
    assert all(r.deviation is None for r in got if r.vec_id in (8, 9))
    assert all(abs(abs(r.whitened) - 1) < 1e-9 for r in got if r.vec_id in (8, 9))
    assert whitening.whiten(df.limit(0)).collect() == []


def test_equal_values(spark):
    points = [[float(s * 3 * (i == j)) for j in range(20)] for i in range(20) for s in (1, -1)]
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert Counter(r.component for r in got) == Counter({c: 40 for c in range(1, 17)})
    assert all(r.explained == pytest.approx(1 / 20) and r.identity_error < 1e-9 for r in got)
