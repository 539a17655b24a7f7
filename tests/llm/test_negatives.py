import math
from collections import Counter

import numpy as np

from galley.llm import negatives


def brute(rows, every=100, np_=5, nn=10, scale=256):
    sound = [(i, label, [math.floor(scale * float(x)) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in sound]
    out = Counter()
    for a, (i, label, v) in enumerate(sound):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(sound) if b != a and len(w) == len(v)]
        near = sorted((s, j) for s, j, other in scored if other == label)[:np_]
        for s, j in near:
            far = sorted((t, n) for t, n, other in scored if other != label and -30 * s <= -100 * t <= -90 * s)[:nn]
            for rank, (t, n) in enumerate(far, 1):
                out[(i, j, rank, n, -s, -t)] += 1
    return out


def got(df, **how):
    return Counter(map(tuple, negatives.mine(df, label=negatives.tampered(), **how).collect()))


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 8))
    labels = rng.integers(0, 4, size=900)
    points = (centres[labels] + 0.4 * rng.normal(size=(900, 8))) * rng.uniform(0.5, 2, size=(900, 1))
    points[200:400] = points[200]
    labels[:300] = 1
    rows = [(i, list(map(float, p)), int(k)) for i, (p, k) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    assert got(df, every=30, bucket=400) == brute(rows, 30)


def test_rounds(spark, monkeypatch):
    from galley.llm import vectors

    rng = np.random.default_rng(8)
    rows = [(i, list(map(float, rng.normal(size=5))), i % 3) for i in range(300)]
    monkeypatch.setattr(vectors.in_rounds, "__defaults__", (40,))
    assert got(spark.createDataFrame(rows, SCHEMA), every=10, bucket=300) == brute(rows, 10)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 1.0], 1), (3, [200000.0, 1.0], 1), (4, [0.7, 0.7], 2), (4, [0.7, 0.7], 2), (5, [0.5, 1.0], 2),
            (6, None, 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (12, [1.0], 1), (200, [2.0], 2),
            (300, [], 1), (13, [], 1), (15, [0.0, 0.0], 3), (400, [-1.0, -1.0], 5), (16, [1.0, 1.5], 5), (17, [3e9, 3e9], 1), (18, [1e9, 1e9], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", v string, bucket int, no int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == Counter()


def test_ranges_leave_out_most():
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(4000, 4))
    points = (unit / np.linalg.norm(unit, axis=1)[:, None] * 2560).astype(np.int64)
    bucket = negatives.Bucket(points)
    query = points[0]
    scores = points @ query
    least = int(np.sort(scores)[-20])
    at = bucket.candidates(query, float(np.sqrt((query**2).sum())), least)
    assert set(np.flatnonzero(scores >= least).tolist()) <= set(at.tolist()) and len(at) < 2000
