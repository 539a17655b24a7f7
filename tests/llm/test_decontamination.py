import random
from collections import Counter

from galley.llm import decontamination as D


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return min(row)


def brute(docs, items, rate=D.RATE):
    out = Counter()
    for doc_id, text in docs:
        for item_id, item in {(i, D.normal(t)) for i, t in items if t is not None}:
            if D.budget(len(item), rate) and text:
                d = distance(item, D.normal(text))
                if d <= D.budget(len(item), rate):
                    out[(doc_id, item_id, d)] += 1
    return out


def edited(text, n, rng):
    text = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(text)), rng.randrange(3)
        text[k : k + (kind != 1)] = [] if kind == 0 else [rng.choice("abcxyz ")]
    return "".join(text)


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [(i, words(12)) for i in range(12)]
    docs = []
    for i in range(60):
        item = rng.choice(items)[1]
        passage = edited(item, rng.randint(0, D.budget(len(item)) + 3), rng)
        docs.append((i, f"{words(6)} {passage if i % 3 else ''} \n {words(5)}".upper() if i % 2 else f"{passage} {words(4)}"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert want and Counter(map(tuple, D.leaks(table, bench).collect())) == want
    kept = {r.doc_id for r in D.without_leaks(table, bench).collect()}
    assert kept == {i for i, _ in docs} - {k[0] for k in want}


def test_myers_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(2, 70)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        d, k = distance(item, text), rng.randrange(min(20, len(item)))
        assert D.Pattern(item).nearest(text, k) == (d if d <= k else None)


def test_awkward(spark, awkward):
    items = [(1, "alpha beta gamma delta epsilon zeta eta"), (1, "alpha beta gamma delta epsilon zeta eta"), (2, None), (3, ""), (4, "short"), (None, "word1 word2 word3 word4 word5 word6")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, m string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = Counter()
    for doc_id, text in rows:
        for item_id, item in ((1, items[0][1]), (None, items[5][1])):
            if item in D.normal(text or ""):
                want[(doc_id, item_id, 0)] += 1
    assert Counter(map(tuple, D.leaks(awkward, bench).collect())) == want
    assert D.leaks(awkward.limit(0), bench).count() == 0 == D.leaks(awkward, bench.limit(0)).count()
    assert D.without_leaks(awkward, bench.limit(0)).count() == len(rows)
    assert D.without_leaks(awkward, bench).columns == awkward.columns


def test_slices_find_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = D.load_items(bench)
    parts = D.load_items(bench, slice_chars=2000)
    assert len(whole) == 1 < len(parts) and sum(len(p.rows) for p in parts) == len(whole[0].rows)
    assert D.leaks(docs, bench).count() > 0


def test_items_without_edits_are_found_between_word_borders(spark):
    docs = spark.createDataFrame(
        [(1, "What is  2 + 2? I ask"), (2, "somewhat is 2 + 2?"), (3, "a category"), (4, "The CAT!"), (5, "cats; cat"), (6, "what is 2 + 3?")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, "what is 2 + 2?"), (2, "Cat"), (3, " "), (2, "cat")], "item_id long, text string")
    assert Counter(map(tuple, D.leaks(docs, bench).collect())) == Counter({(1, 1, 0): 1, (2, 1, 0): 1, (6, 1, 1): 1, (4, 2, 0): 1, (5, 2, 0): 1})
    assert {r.doc_id for r in D.without_leaks(docs, bench).collect()} == {3}


def test_copies_of_an_item_are_one_before_slices_are_cut(spark):
    text = "the same item of the benchmark over and over"
    bench = spark.createDataFrame([(1, text.upper() if i % 2 else text) for i in range(200)], "item_id long, text string")
    slices = list(D.item_slices(bench, slice_chars=100))
    assert len(slices) == 1 and slices[0][0].rows == [(1, text)] and not slices[0][1]


def test_short_items_have_their_edit(spark):
    docs = spark.createDataFrame([(1, "see the quick brwn fox ju here"), (2, "the quick brown fox ju"), (3, "the quik brwn fox ju")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the quick brown fox ju"), (8, "brown fox")], "item_id long, text string")
    assert Counter(map(tuple, D.leaks(docs, bench).collect())) == Counter({(1, 7, 1): 1, (2, 7, 0): 1, (2, 8, 0): 1})


def test_clashing_names(spark):
    names = ["leaks", "row", "__leaks", "__told", "__key", "__n", "__k", "__copies"]
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", *names), (2, "other words", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert [tuple(r) for r in D.without_leaks(docs, bench).collect()] == [(2, "other words", *names)]
