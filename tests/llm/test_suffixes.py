import hashlib
import random
from collections import Counter

import numpy as np

from galley.llm import suffixes


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    return out


def test_small_alphabet(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aab\x00é") for _ in range(n))
    base = word(300)
    rows = [(i, word(rng.randint(0, 120)) + base[rng.randint(0, 150) :][: rng.randint(20, 150)] + word(40)) for i in range(25)]
    rows += [(100, "a" * 200), (101, "ab" * 90), (102, base), (103, base), (104, None), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, suffixes.dedup(docs, length=60, gram=12).collect()))
    assert got == brute(rows, 60)


def test_documents(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, suffixes.dedup(docs).collect())) == brute(rows, 400)
    assert suffixes.dedup(awkward.limit(0)).count() == 0


def test_awkward(spark, awkward):
    table = awkward.withColumn("text", awkward.text.substr(1, 3000))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert Counter(map(tuple, suffixes.dedup(table).collect())) == brute(rows, 400)


def test_one_passage_in_many_texts(spark, monkeypatch):
    """A passage that all texts share, over many buckets of one order, and a long text that repeats itself."""
    monkeypatch.setattr(suffixes, "BUCKET", 64)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, half = word(90), word(4000)
    rows = [(i, word(rng.randint(0, 30)) + passage + word(rng.randint(0, 30))) for i in range(300)] + [(900, half + half), (901, word(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, suffixes.dedup(docs, length=60, gram=12).collect()))
    assert got == brute(rows, 60)


def test_offsets_over_two_levels(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 4)
    rows = [(b, b * b % 7, b % 3) for b in range(50)]
    got = {r["__bucket"]: (r.x_off, r.y_off) for r in suffixes._offsets(spark.createDataFrame(rows, "__bucket long, x_all long, y_all long"), ["x", "y"]).collect()}
    assert got == {b: (sum(r[1] for r in rows[:b]), sum(r[2] for r in rows[:b])) for b in range(50)}


def test_ranks_are_the_suffix_order(spark):
    rng = random.Random(9)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    rows = [(c, k, ord(x)) for c, s in enumerate(strings) for k, x in enumerate(s)]
    got = {(r.chain, r.k): r.r for r in suffixes.ranks(spark.createDataFrame(rows, "chain long, k long, c long"), 60, 1).collect()}
    assert len(got) == len(rows)
    every = sorted((strings[c][k:], (c, k)) for c, k, _ in rows)
    assert [got[p] for _, p in every] == [sum(1 for t, _ in every if t < s) for s, _ in every]


def test_anchors_of_equal_strings():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 100, 90).astype(np.uint8)
    for _ in range(20):
        a = np.concatenate([rng.integers(97, 100, rng.integers(0, 50)).astype(np.uint8), passage])
        b = np.concatenate([passage, rng.integers(97, 100, rng.integers(0, 50)).astype(np.uint8)])
        (_, x), (_, y) = suffixes.anchors(a, 80, 20), suffixes.anchors(b, 80, 20)
        assert set(x.tolist()) & set(y.tolist())


def test_anchors_of_few_and_of_many_places(spark, monkeypatch):
    """Groups of anchors cut at every size, with some in a task's orders and others in the order of all suffixes."""
    monkeypatch.setattr(suffixes, "GROUP", 6)
    monkeypatch.setattr(suffixes, "AT_ONCE", 3)
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("aab\x00é") for _ in range(n))
    base, often = word(400), word(130)
    rows = [(i, word(rng.randint(0, 60)) + base[rng.randint(0, 150) :][: rng.randint(20, 250)] + word(30)) for i in range(12)]
    rows += [(50 + i, word(rng.randint(0, 60)) + often + word(30)) for i in range(12)] + [(100, "a" * 200), (101, often), (102, often)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffixes.dedup(docs, length=60, gram=12).collect())) == brute(rows, 60)


def test_runs_of_starts():
    """All starts in texts around equal anchors, against strings as they are."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        m, length, reach = int(rng.integers(1, 30)), 12, 8
        back = rng.integers(0, reach + 1, m)
        n = np.array([rng.integers(1, b + 2) for b in back])
        parts = [rng.integers(97, 99, k + length - 1).astype(np.uint8) for k in n]
        common = rng.integers(97, 99, 40).astype(np.uint8)
        for p, b in zip(parts, back):
            p[:] = np.where(rng.random(len(p)) < 0.97, common[reach - b :][: len(p)], p)
        strings = [[(b - s, p[s : s + length].tobytes()) for s in range(k)] for p, b, k in zip(parts, back, n)]
        seen = Counter(x for row in strings for x in row)
        want = {(i, s) for i, row in enumerate(strings) for s, x in enumerate(row) if seen[x] > 1}
        row, first, last = suffixes.repeats([p.tobytes() for p in parts], back, n, length, reach)
        got = [(i, s) for i, a, b in zip(row.tolist(), first.tolist(), last.tolist()) for s in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == want


def test_owned_strings():
    """Every start belongs to one anchor, the first least place of its string."""
    rng = np.random.default_rng(2)
    for size, letters in [(500, 26), (500, 2), (300, 1), (80, 3), (79, 3), (0, 3)]:
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        h = suffixes.rolling(data, 20)
        at, of, first, last = suffixes.owned(data, 80, 20)
        assert (of == h[at]).all()
        got = {p: a for a, i, j in zip(at.tolist(), first.tolist(), last.tolist()) for p in range(i, j + 1)}
        assert got == {p: p + int(np.argmin(h[p : p + 61])) for p in range(max(0, size - 79))}


def test_disk_is_bounded_by_the_text(spark, tmp_path, monkeypatch):
    """Intermediate tables hold no row per byte: on texts that all repeat in part, they stay under the size of the texts."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    halves = [word(3000) for _ in range(20)]
    rows = [(i, word(200) + halves[i % 20] + word(200)) for i in range(60)]
    monkeypatch.setattr("galley.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute(rows, 400)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < sum(len(t) for _, t in rows)


def test_runs_with_a_period(spark):
    """The inside of a run with a period is one row of its text, however long it is."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, word(rng.randint(0, 90)) + "Is onhe. " * rng.randint(30, 700) + word(90)) for i in range(12)]
    rows += [(50, "a" * 900), (51, "b" * 401 + word(30)), (52, "c" * 400), (53, word(399)), (54, word(7) * 200), (55, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffixes.dedup(docs).collect())) == brute(rows, 400)
    texts = docs.selectExpr("cast(cast(doc_id AS string) AS binary) AS key", "cast(text AS binary) AS data")
    assert suffixes.repeated_anchors(texts).count() < 80
