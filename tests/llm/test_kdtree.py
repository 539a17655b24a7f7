import math
from collections import Counter

import numpy as np

from galley.llm import kdtree


def brute(rows, k=5, every=50, scale=256):
    sound = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [math.floor(scale * x) for x in v]))
    out = Counter()
    for a, (i, q) in enumerate(sound):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(sound) if len(v) == len(q) and b != a)
            for rank, (s, j) in enumerate(scores[:k], 1):
                out[(i, rank, j, -s)] += 1
    return out


def got(df, **how):
    return Counter(map(tuple, kdtree.top_k(df, **how).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(700, 6)).round(1)
    points[100:200] = points[100]
    rows = [(i, list(map(float, p))) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df, shard=600, leaf=8) == brute(rows)
    assert got(df, every=7, k=3, shard=2400, leaf=16) == brute(rows, 3, 7)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [1.0]), (None, [1.0, 1.0]),
            (100, [3.0]), (6, []), (150, []), (7, [2.0, 2.0]), (7, [-2.0, 2.0]), (8, [-0.001, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v string, shard int, dims int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == Counter()


def test_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (1, [200000.0, 1.0]), (2, [2.0, 1.0]), (2, [5.0, 1.0]), (3, [-3e6, 3e6]), (50, [3e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(df)
    assert found == brute(rows)
    assert {(r, i) for q, r, i, _ in found if q == 0} == {(1, 50), (2, 1), (3, 2), (4, 2), (5, 3)}
    # Beyond a long, scores are cut to its ends, and no row is lost.
    wide = [(0, [3e9, 3e9]), (1, [3e9, 3e9]), (2, [-3e9, -3e9]), (3, [0.0, 1.0]), (50, [1.0, 1.0])]
    assert {(q, r, i) for q, r, i, _ in got(spark.createDataFrame(wide, df.schema))} >= {(0, 1, 1), (0, 2, 50), (0, 3, 3), (0, 4, 2)}


def test_shards_are_not_copied(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kdtree.top_k(df, shard=50)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The packed shards are read straight into the search; nothing explodes or joins them.
    search = plan[plan.index("MapInArrow"):]
    assert "Generate" not in plan and "Join" not in search.split("Relation")[0] and plan.count("MapInArrow") == 1


def test_visits_less_than_all(monkeypatch):
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(4000, 3)) * 256).astype(np.int64)
    tree = kdtree.Tree(np.arange(4000), points, 16)
    scores = points @ points[0]
    best = tree.search(points[0], 0, 5, None)
    assert sorted(s for s, *_ in best) == sorted(np.delete(scores, 0))[-5:]
    floor = min(s for s, *_ in best)
    assert sorted(tree.search(points[0], 0, 5, floor)) == sorted(best)
