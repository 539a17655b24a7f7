import re
from collections import Counter

import numpy as np
import xxhash

from pyspark.sql import functions as F

from galley.llm import simhash
from galley.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                parent[root(p)] = root(q)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return Counter((i, f"{p:016x}", least.get(root(p))) for (i, _), p in zip(rows, prints))


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(map(tuple, simhash.near_duplicates(docs, tile=8).collect()))
    assert got == brute(rows)
    assert any(k[0] != k[2] for k in got)


def test_awkward(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(awkward).collect())) == brute(rows)
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_links_span_every_near_pair(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64)
    values = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 62, (6, 2))})
    classes = spark.createDataFrame([(v,) for v in values], "f0 long")
    for parts in (1, 2, 4):
        cell, steps = simhash._counts(["f0"], parts), simhash._steps(parts, 2)
        found = simhash.links(classes, ["f0"], 2, cell, steps, tile=16).toDF("u", "v")
        got = {r.u: r.v for r in components(found).df.collect()}
        parent = {v: v for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, p in enumerate(values):
            for q in values[:i]:
                if (p ^ q).bit_count() <= 2:
                    a, b = sorted((root(p), root(q)))
                    parent[b] = a
        assert all(got.get(v, v) == root(v) for v in values)


def test_long_majority():
    hashes = np.full(simhash._AT_ONCE + 300, 1, np.uint64)
    hashes[: len(hashes) // 2 + 1] = 2
    assert simhash.majority_bits(hashes) == 2


def test_distinct_documents_keep_one_of_every_pair_at_the_threshold(spark):
    """Planted pairs at a Jaccard similarity of exactly 0.8; a radius in SimHash bits alone loses some of the short ones."""
    rows, kept = [], set()
    for size, pairs in ((5, 400), (15, 120), (50, 40)):
        # The longer text has a word (or words) more at its end, so its set holds that of the shorter one: 4 of 5, ...
        for n in range(pairs):
            words = [f"w{size}x{n}x{k}" for k in range(size + 4)]
            shorter = words[: len(words) - size // 5]
            kept.add(len(rows))
            rows += [(len(rows), " ".join(shorter)), (len(rows) + 1, " ".join(words))]
    # Just under the threshold: 3 of 4.
    for n in range(20):
        words = [f"v{n}x{k}" for k in range(8)]
        kept |= {len(rows), len(rows) + 1}
        rows += [(len(rows), " ".join(words[:7])), (len(rows) + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.distinct_documents(docs).collect()} == kept


def test_texts_around_one_passage_do_not_meet_in_pairs(spark):
    """300 texts share 50 of 65 words, so their prefixes share shingles, but no two are near; 30 have a near one."""
    passage = [f"p{k}" for k in range(50)]
    rows = [[*passage, *[f"t{n}x{k}" for k in range(15)]] for n in range(300)]
    rows += [[*row, f"more{n}"] for n, row in enumerate(rows[:30])]
    docs = spark.createDataFrame([(n, " ".join(row)) for n, row in enumerate(rows)], "doc_id long, text string")
    sets = simhash._set_prints(docs, 5, 4, 0.7, simhash._common_shingles(docs, 5))
    members = sets.withColumnsRenamed({"doc_id": "num"}).withColumn("root", F.col("num"))
    found = {(r.u, r.v) for r in simhash._meetings(simhash._shared_shingles(members), 0.7).collect()}
    assert {(n, 300 + n) for n in range(30)} <= found and len(found) < 300
    assert {(n, 300 + n) for n in range(30)} <= {(r.u, r.v) for r in simhash._prefix_pairs(members, 0.7).collect()}


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(11)
    for size in (1, 40, 700, 5000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[size // 3 :], rng.integers(0, 2**63, 30).astype(np.uint64)])
        bits = int(np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
