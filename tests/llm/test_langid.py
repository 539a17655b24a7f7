import zlib
from collections import Counter

from galley.llm import langid


def grams(text):
    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = f"\x01{word}\x01"
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        word = ""
    return out


def packed(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def top(counts, size=langid.PROFILE):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))[:size]]


def brute(rows):
    total = {}
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            total.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in total.items() if c}
    out = []
    for i, text, _ in rows:
        own = top(grams(text or ""))
        held = None if i is None else zlib.crc32(str(i).encode()) % 5 == 0
        if not own or not profiles:
            out.append((i, held, "und", 0.0))
            continue
        far = {
            lang: sum(min(langid.PROFILE, abs(p[g] - k)) if g in p else langid.PROFILE for k, g in enumerate(own))
            for lang, p in profiles.items()
        }
        best = min(sorted(far), key=far.get)
        out.append((i, held, best, round(1 - far[best] / (len(own) * langid.PROFILE), 9)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    found = got(docs)
    assert found == brute(rows)
    held = [(r[2], dict((i, lang) for i, _, lang in rows)[r[0]]) for r in found if r[1]]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_awkward(spark, awkward):
    assert got(awkward) == brute([(r.doc_id, r.text, r.lang) for r in awkward.collect()])
    assert got(awkward.limit(0)) == Counter()


def test_pieces_change_nothing(monkeypatch):
    text = "abc défg hij " * 400
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 50)
    parts = langid.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None, None, None, 1), (9002, "12 34 !", "en", "a", 1), (9003, "привет мир как дела", None, "a", 1)], docs.schema)
    kept = {r.doc_id for r in langid.spoken(docs.union(odd)).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
