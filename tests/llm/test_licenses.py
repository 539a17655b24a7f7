import math
import re
from collections import Counter

from galley.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    longest = max(len(t.split()) for _, t in templates)
    out = Counter()
    for doc_id, text in rows:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        base = sorted({label for _, label in found})
        more, best = set(), 0.0
        for start in range(0, max(1, len(words) - longest), longest):
            block = set(words[start : start + 2 * longest])
            for label, template in templates:
                t = set(template.split())
                if len(t & block) >= math.ceil(threshold * len(t) - 1e-9):
                    more.add(label)
                    best = max(best, len(t & block) / len(t))
        places = [i for i, _ in found]
        score = 1.0 if found else best
        out[(doc_id, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *more})), round(score, 9))] += 1
    return out


def got(df, **how):
    return Counter((*r[:7], round(r[7], 9)) for r in licenses.scan(df, **how).collect())


def test_against_brute_force(spark):
    filler = "lorem ipsum under the of license version "
    texts = [
        "Released under the MIT License, under the MIT license.", "Apache License, Version 2.0; CC BY-NC 4.0", filler * 40,
        filler * 9 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and docs" + filler * 9,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following", "ＭＩＴ under the Kit license İ",
        "This program is Licensed under the GNU General Public License, version 3.", "K", "under the mit", "licensed\x00under\x7fthe GNU general public license version 3",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(list(enumerate(texts)))
    assert got(docs) == want
    assert {k[6] for k in want} >= {"mit", "gpl", "bsd", "apache-2,cc-by-nc"}
    for threshold in (0.5, 1.0):
        assert got(docs, threshold=threshold) == brute(list(enumerate(texts)), threshold=threshold)


def test_awkward(spark, awkward):
    assert got(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert got(awkward.limit(0)) == Counter()


def test_python_stays_out(spark, awkward):
    plan = licenses.scan(awkward)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
