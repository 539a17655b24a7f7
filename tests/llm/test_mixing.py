from collections import defaultdict

import pytest

from galley.llm import mixing


def water(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * rate > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * rate for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def by_source(docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    return sizes


@pytest.mark.parametrize("group", [mixing.GROUP, 4])
def test_targets_are_met(spark, group):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want, sizes = water(by_source(rows)), by_source(rows)
    source = {r.doc_id: r.source for r in rows}
    words = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    got = mixing.mix(docs, group=group).collect()
    assert sorted(r.doc_id for r in got) == sorted(source)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), group=group).collect()))


def test_unbiased(spark):
    """Over many seeds of ids, every document of a source is taken about as often as its target says."""
    rows = [(k * 1000 + i, "w " * (1 + i), "s") for k in range(40) for i in range(12)]
    other = [(10**6 + i, "w " * 3, "t") for i in range(100)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs, group=16).collect() if r.doc_id < 10**6]
    rate = got[0].target / got[0].source_size
    for i in range(12):
        copies = [r.taken / r.size for r in got if r.doc_id % 1000 == i]
        assert abs(sum(copies) / len(copies) - rate) < 0.25


def test_awkward(spark, awkward):
    rows = awkward.collect()
    want = water(by_source(rows))
    got = mixing.mix(awkward).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    assert sorted(round(r.target, 6) for r in got) == sorted(round(want[r.source], 6) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(awkward.limit(0)).count() == 0
    kept = mixing.mixed(awkward)
    assert kept.columns == awkward.columns
    total = sum(r.taken for r in got)
    back = sum(len((r.text or "").encode().split()) for r in kept.collect())
    longest = max(r.size for r in got)
    assert abs(total - back) <= 3 * longest


def test_python_stays_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
