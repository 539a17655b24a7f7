"""Language identification by rank-order profiles: a document's most frequent n-grams against those of each language.

Texts are lower-cased, runs of non-letters become one boundary, and runs of one to three characters are counted inside
words with their boundaries. A profile is the list of a language's most frequent n-grams. The out-of-place distance adds,
over the document's own most frequent n-grams, how far each stands from its place in the profile; one that the profile
lacks costs the profile's length, which is also the most any n-gram costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, plain, saved

PROFILE = 400
# Languages in one lookup; more take more lookups over the same text.
LANGS = 256
UNKNOWN = "und"
# Distinct n-grams a task holds per language before it passes their counts on.
HELD = 1 << 20
# Characters counted at once.
PIECE = 1 << 22
_EDGE, _BITS = 1, 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> np.ndarray:
    """Packed n-grams of one piece of text; empty when it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, _EDGE).astype(np.int64)
    codes = np.concatenate([[_EDGE], codes, [_EDGE]])
    inside = np.concatenate([[True], (codes[1:] != _EDGE) | (codes[:-1] != _EDGE)])
    codes = codes[inside]
    two = (codes[:-1] << _BITS) | codes[1:]
    three = (two[:-1] << _BITS) | codes[2:]
    return np.concatenate([codes[codes != _EDGE], two, three[codes[1:-1] != _EDGE]])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order with their counts, over the whole text in pieces that end at a non-letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(text) <= PIECE:
        return np.unique(_grams(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        parts.append(np.unique(_grams(text[at:end]), return_counts=True))
        at = end
    return _merge(parts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` n-grams by falling count, then by code."""
    if len(counts) and counts.max() < 1 << 16:
        counts = counts.astype(np.uint16)
        return codes[np.argsort(np.uint16(65535) - counts, kind="stable")[:size]]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """``text, lang`` -> ``lang, place, gram``: the profile of every language, places from 0.

    Rows with a null text or lang teach nothing. Counts cover all rows; tasks add theirs up before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def give(lang: str) -> pa.RecordBatch:
            codes, counts = _merge(held.pop(lang))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"]
            )

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for lang, text in zip(langs, texts):
                held.setdefault(lang, []).append(gram_counts(text.as_py()))
                if sum(len(c) for c, _ in held[lang][1:]) > HELD:
                    held[lang] = [_merge(held[lang])]
                    if len(held[lang][0][0]) > HELD:
                        yield give(lang)
        for lang in list(held):
            yield give(lang)
        give_back()

    counted = docs.where("text is not null and lang is not null").select("lang", "text")
    grams = counted.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    placed = grams.withColumn("place", F.row_number().over(by) - 1).where(F.col("place") < size)
    return placed.select("lang", "place", "gram")


class Profiles:
    """Profiles of languages as one lookup of at most ``LANGS`` rows, and a further one for the languages after them."""

    def __init__(self, table: DataFrame, size: int = PROFILE):
        kept = saved(table, "profiles")
        rows = kept.df.collect()
        kept.drop()
        self.size = size
        langs = sorted({r.lang for r in rows})
        self.parts = [self._lookup(rows, langs[a : a + LANGS]) for a in range(0, len(langs), LANGS)]

    @staticmethod
    def _lookup(rows: list, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their n-grams in order, and by language the place of each, -1 where it has none."""
        at = {lang: k for k, lang in enumerate(langs)}
        mine = [r for r in rows if r.lang in at]
        grams = np.array(sorted({r.gram for r in mine}), np.int64)
        places = np.full((len(langs), len(grams) + 1), -1, np.int32)
        for r in mine:
            places[at[r.lang], np.searchsorted(grams, r.gram)] = r.place
        return langs, grams, places

    def classify(self, text: str | None) -> tuple[str, float]:
        """Nearest language (the first by name among equals) and one minus the distance's share of the largest."""
        codes, counts = gram_counts(text)
        if not len(codes) or not self.parts:
            return UNKNOWN, 0.0
        own = most_frequent(codes, counts, self.size)
        near = []
        for langs, grams, table in self.parts:
            at = np.searchsorted(grams, own)
            found = at < len(grams)
            found[found] = grams[at[found]] == own[found]
            places = table[:, np.where(found, at, len(grams))]
            gaps = np.minimum(np.abs(places - np.arange(len(own))), self.size)
            far = np.where(places < 0, self.size, gaps).sum(axis=1)
            near.append((int(far.min()), langs[int(far.argmin())]))
        far_, lang = min(near)
        return lang, float(1.0 - far_ / (len(own) * self.size))


def predicted(profiles: Profiles, text: Column) -> Column:
    """Struct ``lang_pred, score`` of a text column. Not to be evaluated twice, hence marked as not deterministic."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        got = [profiles.classify(t.as_py()) for t in texts]
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], fields=list(kind)
        )

    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """True where the id's checksum leaves no remainder by five; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learnt from the rows that are not held out.

    Null texts, empty ones and those without a letter are ``und`` with score 0, as is everything when nothing can be
    learnt. A null id is neither held out nor learnt from. Repeated rows count as often as they occur. Other columns,
    whatever their names, are ignored.
    """
    known = plain(docs, doc_id=id_col, text=text_col, lang=lang_col)
    profiles = Profiles(learn(known.where(~held_out(F.col("doc_id")))))
    out = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(profiles, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def spoken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.2) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the languages that the table itself teaches.

    Rejected are texts without a letter, and texts whose nearest profile has a score under ``least``: nearly all their
    frequent n-grams are ones that no language here uses. Prose in a known language scores several times that.
    """
    known = plain(docs, doc_id=id_col, text=text_col, lang=lang_col)
    profiles = Profiles(learn(known.where(~held_out(F.col("doc_id")))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    told = docs.select(row, predicted(profiles, F.col(f"`{text_col}`")).alias("told"))
    kept = told.where((F.col("told.lang_pred") != UNKNOWN) & (F.col("told.score") >= least))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
