"""Benchmark decontamination: test items found in documents within an edit budget.

By the pigeonhole principle, a passage within ``k`` edits of an item holds at least one of any ``k + 1`` pieces of the
item unchanged. All pieces of all items are searched at once (one automaton pass over the text); every hit names the one
region where its item would lie, and Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, plain, saved

RATE = 0.08
# Characters of items that one pass over the documents looks for; larger benchmarks take more passes.
SLICE_CHARS = 2_000_000


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def budget(size: int, rate: float = RATE) -> int:
    """Edits that a passage of an item of ``size`` characters may have."""
    return int(size * rate)


def at_borders(text: str, a: int, b: int) -> bool:
    """Whether ``text[a:b]`` does not start or end inside a word."""

    def inside(i: int) -> bool:
        return 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()

    return not inside(a) and not inside(b)


def pieces(item: str, k: int) -> Iterator[tuple[int, str]]:
    """``k + 1`` consecutive pieces, as equal as can be, with their offsets."""
    for i in range(k + 1):
        a, b = len(item) * i // (k + 1), len(item) * (i + 1) // (k + 1)
        yield a, item[a:b]


class Pattern:
    """Myers' automaton of one item; Python's integers make it as wide as the item."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str, k: int) -> int | None:
        """Least edit distance between the item and any substring of ``text``; None over ``k``."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, best = full, 0, self.size, k + 1
        masks = self.masks
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
                    if not best:
                        break
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | (full & ~(xv | ph))
            down = ph & xv
        return best if best <= k else None


class Items:
    """Test items and the automaton of their pieces, built once per worker."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float):
        self.rows, self.rate = rows, rate
        self.automaton = None

    def __getstate__(self):
        return {"rows": self.rows, "rate": self.rate, "automaton": None}

    def _build(self) -> None:
        self.texts = [t for _, t in self.rows]
        self.budgets = [budget(len(t), self.rate) for t in self.texts]
        self.patterns: list[Pattern | None] = [None] * len(self.rows)
        places: dict[str, list[tuple[int, int]]] = {}
        for n, text in enumerate(self.texts):
            for offset, piece in pieces(text, self.budgets[n]):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int]]:
        """``(item_id, distance)`` of every item that a passage of the text is near to."""
        if self.automaton is None:
            self._build()
        text = normal(text)
        regions: dict[int, list[tuple[int, int]]] = {}
        out = []
        exact = set()
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                if not self.budgets[n]:
                    if n not in exact and at_borders(text, end - size + 1, end + 1):
                        exact.add(n)
                        out.append((self.rows[n][0], 0))
                    continue
                a = end - size + 1 - offset - self.budgets[n]
                b = a + len(self.texts[n]) + 2 * self.budgets[n]
                held = regions.setdefault(n, [])
                # Hits of an item at nearby places share a region.
                if held and a <= held[-1][1] and b >= held[-1][0]:
                    held[-1] = (min(a, held[-1][0]), max(b, held[-1][1]))
                else:
                    held.append((a, b))
        for n, held in sorted(regions.items()):
            if self.patterns[n] is None:
                self.patterns[n] = Pattern(self.texts[n])
            found = [self.patterns[n].nearest(text[max(0, a) : b], self.budgets[n]) for a, b in held]
            found = [d for d in found if d is not None]
            if found:
                out.append((self.rows[n][0], min(found)))
        return out


def item_slices(
    benchmark: DataFrame, rate: float = RATE, slice_chars: int = SLICE_CHARS
) -> Iterator[tuple[Items, bool]]:
    """``item_id, text`` -> the items, and whether there are more slices than one, in slices of at most about ``slice_chars`` characters, each small enough to send.

    Items that are equal when normalised are one before they are sliced, and the driver holds one slice at a time. Null
    texts and those without a word are no evidence and are left out.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([normal(t.as_py()) for t in texts], pa.string())

    items = benchmark.where("text is not null").select("item_id", F.arrow_udf(run, "string")(F.col("text")).alias("text"))
    table = saved(items.distinct().where("text != ''"), "items")
    total = table.df.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // slice_chars))
    for k in range(n):
        part = table.df.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows = sorted({(r.item_id, r.text) for r in part}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if rows:
            yield Items(rows, rate), n > 1
    table.drop()


def load_items(benchmark: DataFrame, rate: float = RATE, slice_chars: int = SLICE_CHARS) -> list[Items]:
    """All slices of :func:`item_slices` at once."""
    return [items for items, _ in item_slices(benchmark, rate, slice_chars)]


def matched(items: Items, text: Column) -> Column:
    """Array of ``item_id, distance`` for a text column; marked so that it is not evaluated twice."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    held = items

    def run(texts: pa.Array) -> pa.Array:
        rows = [held.matches(t.as_py() or "") for t in texts]
        give_back()
        return pa.array([[{"item_id": i, "distance": d} for i, d in r] for r in rows], kind)

    return F.arrow_udf(run, "array<struct<item_id:bigint,distance:int>>").asNondeterministic()(text)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance``: every document and item of which it holds a passage within ``rate`` edits a character.

    Case and the width of white space do not count. An item too short for an edit (under 13 characters at 8 %) is found
    as it is, between word borders. Documents without a match give no row; null and empty texts never match, very
    long ones are searched whole. Rows of the document table that repeat give their rows again; rows of the benchmark that
    repeat count once, and two items of one id give a row each. Other columns are ignored.
    """
    texts = plain(docs, doc_id=id_col, text=text_col)
    found = []
    for items, several in item_slices(benchmark, rate):
        part = texts.select("doc_id", F.explode(matched(items, F.col("text"))).alias("m"))
        # Written, a slice is no longer part of the plan that the driver holds.
        found.append(saved(part, "leaks").df if several else part)
    if not found:
        return texts.limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "cast(null as int) distance")
    return reduce(DataFrame.union, found).select("doc_id", "m.item_id", "m.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no passage of the benchmark is found.

    Null and empty texts stay, repeated rows stay or go together, and very long texts are searched whole. Without items
    all rows stay. Columns may have any names.
    """
    for items, several in item_slices(benchmark, rate):
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        found = docs.select(row.alias("row"), matched(items, F.col(f"`{text_col}`")).alias("leaks")).where(F.size("leaks") == 0)
        docs = found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
        if several:
            docs = saved(docs, "unleaked").df
    return docs
