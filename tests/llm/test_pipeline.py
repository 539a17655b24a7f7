"""Every stage of the pipeline against a brute-force version of what it decides."""

from collections import Counter, defaultdict

import pytest
from test_decontamination import brute as leaks
from test_mixing import by_source, water

import corpus_pipeline
from galley.llm import simhash

SF = "/root/testdata/sf0.001"


def similar_groups(rows, similarity=0.8):
    sets = {i: frozenset(map(tuple, (lambda w: [w[k : k + 5] for k in range(max(1, len(w) - 4))])((t or "").encode().lower().split()))) if (t or "").split() else frozenset() for i, t in rows}
    least = {}
    for i in sorted(sets):
        least[i] = i

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (not a and not b) or (both and both >= similarity * (len(a) + len(b) - both)):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return {root(i) for i in ids}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "t").df
        out.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_stages(spark, stages):
    given, spoken, distinct, clean, mixed, encoded = stages
    assert len(given) == len(spoken)
    assert {r.doc_id for r in distinct} == similar_groups([(r.doc_id, r.text) for r in spoken])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    suspects = [(r.doc_id, r.text) for r in distinct if any(t.lower()[40:60] in r.text.lower() for _, t in items)]
    found = {k[0] for k in leaks(suspects, items)}
    assert {r.doc_id for r in distinct} - {r.doc_id for r in clean} == found
    want, taken, longest = water(by_source(clean)), by_source(mixed), defaultdict(int)
    for r in clean:
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in want)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mixed)


def test_near_duplicates_awkward(spark, awkward):
    got = simhash.distinct_documents(awkward, tile=2, set_tile=2)
    assert got.columns == awkward.columns
    ids = Counter(r.doc_id for r in got.collect())
    # Texts without words are one group, and so are the copies and near copies; nulls come last.
    assert ids == Counter({1: 1, 3: 1, 5: 1, 7: 1, 8: 1, 10: 1})
    assert simhash.distinct_documents(awkward.limit(0)).count() == 0


def test_stages_take_awkward_tables(spark, awkward):
    for table in (awkward, awkward.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, SF), "t").df
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
