"""License scan: fixed phrases by place, and an exact set-similarity join of text blocks with license templates.

A block is a window of words; windows overlap by half and are twice as long as the longest template, so every passage of
a template's length lies within one. A block meets a template when it contains at least ``threshold`` of the template's
distinct words. The join is the prefix-filtering one: words are ordered by how many documents hold them, rarest first; a
template of ``k`` words that must share ``a`` of them with a block shares one of its first ``k - a + 1``, and so does the
block of its own first; the pair also has to have the length, and places of the shared word that leave room for ``a``.
Words of no template are in no overlap and are left out before anything is ordered or moved.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

OUTSIDE = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
WORD = f"[^{OUTSIDE}]+"

# Phrases and labels of the contract (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings of public license notices, labelled by family: variants of a family differ by a word, below the threshold.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 20_000


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does more, but only two letters outside ASCII become ASCII; they are put aside."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _places(words: Column, text: Column, phrase: str) -> Column:
    """Starts (from 0) where the phrase's words stand consecutively; texts without its words are not looked through."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    held = reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in parts]) & (last >= 0)
    here = F.filter(
        F.sequence(F.lit(0), F.when(last >= 0, last).otherwise(0)),
        lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)]),
    )
    return F.when(held, here).otherwise(F.array().cast("array<int>"))


def _base(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, key`` and what the phrases give."""
    worded = docs.select("doc_id", F.md5("text").alias("key"), lowered(F.col("text")).alias("low"), word_list(F.col("text")).alias("words"))
    found = [_places(F.col("words"), F.col("low"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    placed = worded.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), *found)
    cols = [f"p{k}" for k in range(len(PHRASES))]
    every = F.concat(*cols)
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(x)) for c, x in zip(cols, PHRASES.values())]))
    return placed.select(
        "doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"),
    )


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blocks_meeting(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``text`` -> ``key`` (md5 of the text), ``start`` (block's first word), ``label``, ``containment``: all that meet."""
    sets = [(label, list(dict.fromkeys(re.findall(WORD, text.lower())))) for label, text in templates]
    sets = [(label, ws) for label, ws in sets if ws]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} different words")
    texts = docs.select(F.md5("text").alias("key"), word_list(F.col("text")).alias("words"))
    # One number per word of the templates, counted over all documents, whatever their number.
    held = texts.select(F.explode(F.array_intersect("words", _literals(vocabulary))).alias("w"))
    often = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows, need = [], []
    for t, (label, ws) in enumerate(sets):
        ws = sorted(ws, key=rank.__getitem__)
        a = math.ceil(threshold * len(ws) - 1e-9)
        need.append(a)
        rows += [(t, label, w, i, len(ws), a, ws) for i, w in enumerate(ws[: len(ws) - a + 1])]
    kind = "t int, label string, w string, i int, k int, a int, ws array<string>"
    prefixes = docs.sparkSession.createDataFrame(rows, kind)
    longest = max(len(re.findall(WORD, text.lower())) for _, text in templates)
    window, least = 2 * longest, min(need)
    starters = sorted({r[2] for r in rows})
    blocks = texts.where(F.arrays_overlap("words", _literals(starters))).select(
        "key", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - longest - 1), F.lit(longest))).alias("start")
    )
    # The intersection keeps the order of its first argument: rarest word first.
    blocks = blocks.select("key", "start", F.array_intersect(_literals(order), F.slice("words", F.col("start") + 1, F.lit(window))).alias("b"))
    blocks = blocks.where(F.size("b") >= least).distinct()
    first = blocks.select("key", "start", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "w"))
    met = first.join(prefixes, "w")
    room = F.least("i", "j") + 1 + F.least(F.col("k") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    met = met.where((F.size("b") >= F.col("a")) & (room >= F.col("a")))
    shared = F.size(F.array_intersect("b", "ws"))
    met = met.select("key", "start", "label", "t", "a", (shared / F.col("k")).alias("containment"), shared.alias("shared"))
    return met.where("shared >= a").groupBy("key", "start", "label", "t").agg(F.max("containment").alias("containment")).drop("t")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: words, places of the phrases, ``base_labels``, ``labels`` and ``score``.

    ``score`` is 1 with a phrase, else the best containment of a template, else 0. Null and empty texts have no words
    and no labels (empty strings). Rows that repeat give their rows again, null ids too. Other columns are ignored.
    """
    texts = plain(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = blocks_meeting(texts, templates, threshold).groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment")
    )
    out = _base(texts).join(met, "key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """The same in SQL: every block against every template, with no filters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    longest = max(len(t.split()) for _, t in TEMPLATES)

    def array(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    places = {
        k: "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {n + 1}] = '{p}'" for n, p in enumerate(phrase.split())) + ")"
        for k, phrase in enumerate(PHRASES)
    }
    every = " || ".join(f"p{k}" for k in places)
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(PHRASES.values()))
    kinds = ", ".join(f"({t}, '{label}', {array(list(dict.fromkeys(text.split())))})" for t, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^{OUTSIDE}]+') AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n_words, {", ".join(f"{e} AS p{k}" for k, e in places.items())} FROM d),
q AS (SELECT r, doc_id, n_words, {every} AS every, list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL))) AS base FROM p),
b AS (SELECT r, w[s + 1 : s + {2 * longest}] AS b
  FROM (SELECT r, w, unnest(range(0, greatest(0, len(w) - {longest} - 1) + 1, {longest})) AS s FROM d)),
t(t, label, ws) AS (VALUES {kinds}),
m AS (SELECT r, list(DISTINCT label) AS more, max(c) AS c
  FROM (SELECT r, label, len(list_intersect(ws, b)) / len(ws) AS c, ceil({THRESHOLD} * len(ws) - 1e-9) AS a, len(list_intersect(ws, b)) AS n FROM b, t)
  WHERE n >= a GROUP BY r)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM q LEFT JOIN m USING (r)"""
