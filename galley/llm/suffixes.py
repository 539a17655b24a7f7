"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Two exact reductions come first. Equal texts are one text with a number of copies. And only text around repeated anchors
takes part: an anchor is where a rolling hash is least among all that fit a string of the wanted length, so a string that
repeats has an anchor that repeats. Every place of a text belongs to one anchor, the first least one of the string that starts
there.

Anchors that follow each other in a text with the same strings, as in a run with a period, repeat for sure; one of them stands for
all. Texts around equal anchors meet in one task. There the suffixes that start at anchors are sorted, and the prefixes that end there,
read backward; what neighbours share in these two orders tells for every place of every anchor whether its string starts elsewhere,
byte for byte. Only an anchor's text travels, not a row per place.

Anchors that more than ``GROUP`` places share do not go to one task. The order of all suffixes near them comes from the
difference-cover algorithm with period three, as DataFrame steps. A string is a chain of symbols; the triples at places 1 and 2 modulo 3 are sorted and named, the chains of names are ordered by recursion, and the
places 0 modulo 3 are merged in by two sorts: with places 1 by (symbol, order of the next suffix), with places 2 by
(symbol, symbol, order of the second next). Ranks are counts of smaller suffixes, so equal suffixes share one. Bytes are
taken seven to a symbol, one chain for each of the seven offsets. The recursion stops when names cover the wanted
length. Then strings that agree so far are neighbours, and neighbours' prefixes are compared by fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, plain, saved

LENGTH = 400
# Bytes under an anchor's hash.
GRAM = 160
PACK = 7
BUCKET = 1 << 14
# Places of one anchor that are sorted in a task, and about how many of several anchors are sorted at once.
GROUP = 1 << 16
AT_ONCE = 1 << 14
END = -1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(data: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """Mixed 64-bit polynomial hash of every run of ``size`` bytes."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every run of ``width`` values, from running values forward and backward in blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - width + 1], ahead[width - 1 : n])


def _least(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``gram`` bytes, the least one of every string of ``length`` bytes, and the places that are least in one."""
    h, width = rolling(data, gram), length - gram + 1
    least = _sliding(h, width, np.minimum, 2**64 - 1)
    edge = np.zeros(width - 1, np.uint64)
    return h, least, _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the least of some string of ``length`` bytes, and those hashes; equal strings agree on them."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, _, is_least = _least(data, length, gram)
    at = np.flatnonzero(is_least)
    return at, h[at]


def owned(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that are the first least place of some string, their hashes, and the first and last start of those strings."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    h, least, is_least = _least(data, length, gram)
    at = np.flatnonzero(is_least)
    of = h[at]
    # The first anchor at or behind each start; then on to the one that has the least hash.
    pick = np.cumsum(is_least)[: len(least)] - is_least[: len(least)]
    wrong = np.flatnonzero(of[pick] != least)
    while len(wrong):
        pick[wrong] += 1
        wrong = wrong[of[pick[wrong]] != least[wrong]]
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    last = np.concatenate([first[1:], [len(pick)]]) - 1
    return at[pick[first]], of[pick[first]], first, last


def same_as_before(data: memoryview, h: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Marks anchors whose strings are those of the anchor before, all of them: the inside of a run with a period."""
    n = last - first + 1
    out = np.zeros(len(h), bool)
    for i in (np.flatnonzero((h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (first[1:] == last[:-1] + 1)) + 1).tolist():
        a, b, size = first[i - 1], first[i], n[i] + length - 1
        out[i] = data[a : a + size] == data[b : b + size]
    return out


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """An anchor stands for those behind it with the same strings; ``sure`` starts from its first on are then repeated, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("data")):
                data = text.as_buffer()
                at, h, first, last = owned(np.frombuffer(data, np.uint8), length, gram)
                if len(at):
                    own = np.flatnonzero(~same_as_before(memoryview(data), h, first, last, length))
                    behind = np.diff(np.append(own, len(at)))
                    n = (last - first + 1)[own]
                    cells = [pa.array([key.as_py()] * len(own), pa.binary()), pa.array(at[own]), pa.array(h[own].view(np.int64))]
                    cells += [pa.array((at - first)[own].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.where(behind > 1, behind * n, 0))]
                    yield pa.RecordBatch.from_arrays(cells, ["key", "at", "h", "back", "n", "sure"])

    return texts.select("key", "data").mapInArrow(run, "key binary, at long, h long, back int, n int, sure long")


def _contexts(near: DataFrame, length: int) -> DataFrame:
    """``key, data, copies, places`` (array of anchors) -> each anchor with the text of all strings that belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(batch.column("key"), batch.column("data"), batch.column("places")):
                data, key = text.as_buffer(), key.as_py()
                rows = places.values
                at, h, back, n = [rows.field(c).to_numpy(zero_copy_only=False) for c in ("at", "h", "back", "n")]
                for i in range(0, len(at), 1 << 12):
                    j = slice(i, i + (1 << 12))
                    parts = [data[a : a + m].to_pybytes() for a, m in zip((at[j] - back[j]).tolist(), (n[j] + length - 1).tolist())]
                    cells = [pa.array([key] * len(parts), pa.binary()), *[pa.array(c[j]) for c in (at, h, back, n)], pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["key", "at", "h", "back", "n", "part"])

    return near.select("key", "data", "copies", "places").mapInArrow(run, "key binary, at long, h long, back int, n int, part binary")


def _shared(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a matrix's rows, and how many leading bytes each row of that order shares with the one before."""
    m, width = text.shape
    order = np.argsort(text.view(f"S{width}").reshape(m), kind="stable")
    same = np.zeros(m, np.int64)
    for i in range(1, m, 1 << 12):
        j = min(m, i + (1 << 12))
        other = text[order[i:j]] != text[order[i - 1 : j - 1]]
        same[i:j] = np.where(other.any(axis=1), other.argmax(axis=1), width)
    return order, same


def repeats(parts: list[bytes], back: np.ndarray, n: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of text around anchors -> ``row, first, last``: runs of starts in a row whose strings start in another row as well.

    A row's anchor lies ``back`` bytes behind its first start, ``reach`` at most; ``n`` strings start in it. Strings of two
    rows are only compared where they lie alike around their anchors.
    """
    m = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join([bytes(reach), *parts, bytes(length)]), np.uint8)
    anchor = reach + np.cumsum(sizes) - sizes + back
    # Bytes beyond a row's own text take part in the orders, but no string that belongs to the row extends to them.
    ahead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[anchor])
    right, right_same = _shared(ahead)
    left, left_same = right, np.zeros(m, np.int64)
    if reach:
        before = np.lib.stride_tricks.sliding_window_view(flat, reach)[anchor - reach]
        left, left_same = _shared(np.ascontiguousarray(before[:, ::-1]))
    found = np.zeros((m, reach + 3), bool)
    a, b = np.empty(m, np.int64), np.empty(m, np.int64)
    least = back - n + 1
    for d in range(reach + 1):
        rows = np.flatnonzero((least <= d) & (d <= back))
        if len(rows) < 2:
            continue
        # Rows of one number agree in the bytes from the anchor on, and in those before it.
        a[right], b[left] = np.cumsum(right_same < length - d), np.cumsum(left_same < d)
        both = a[rows] * (m + 1) + b[rows]
        order = np.argsort(both)
        ranked = both[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(rows), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        found[rows[order[twice]], reach + 1 - d] = True
    # Column ``reach + 1 - d`` is the start ``d`` bytes before the anchor; a column of none is on either side.
    edges = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(edges)
    first = back[row[::2]] - reach + column[::2]
    last = back[row[1::2]] - reach + column[1::2] - 1
    return row[::2], first, last


def _runs(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts -> ``key, first, last``: runs of places whose strings also start elsewhere. Equal anchors meet in one task."""
    reach = length - gram

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        at, back, n = [table.column(c).to_numpy() for c in ("at", "back", "n")]
        row, first, last = repeats(table.column("part").to_pylist(), back.astype(np.int64), n.astype(np.int64), length, reach)
        start = (at - back)[row]
        cells = [table.column("key").combine_chunks().take(pa.array(row)), pa.array(start + first), pa.array(start + last)]
        return pa.RecordBatch.from_arrays(cells, ["key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            h = batch.column("h").to_numpy()
            # Where the last anchor of what is held ends: in front of this batch, or at the last change in it.
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and len(h) and held[-1].column("h")[-1].as_py() != h[0]:
                cuts = np.concatenate([[0], cuts])
            begin = 0
            for cut in cuts.tolist():
                if size + cut - begin >= AT_ONCE:
                    whole = [*held, batch.slice(begin, cut - begin)]
                    yield told(whole)
                    held, size, begin = [], 0, cut
            if len(h) > begin:
                held.append(batch.slice(begin))
                size += len(h) - begin
        if held:
            yield told(held)

    met = contexts.repartition("h").sortWithinPartitions("h")
    return met.mapInArrow(run, "key binary, first long, last long")


def _segments(near: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, data, at`` (array of repeated anchors) -> ``key, start, part``: the text in which a repeat can lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, at in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("at").to_pylist()):
                rows: list[list[int]] = []
                for p in sorted(at):
                    a, b = max(0, p - length + gram), min(len(data), p + length)
                    if rows and a <= rows[-1][1]:
                        rows[-1][1] = max(b, rows[-1][1])
                    else:
                        rows.append([a, b])
                rows = [r for r in rows if r[1] - r[0] >= length]
                if rows:
                    cells = [pa.array([key] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([data[a:b] for a, b in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["key", "start", "part"])

    return near.select("key", "data", "at").mapInArrow(run, "key binary, start long, part binary")


def _symbols(segments: DataFrame, length: int) -> DataFrame:
    """``no, key, start, part`` -> a row per byte: ``chain, k, c`` (seven bytes), ``key, at`` and the fingerprint ``f0, f1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chain", "k", "c", "key", "at", "f0", "f1"]
        for batch in batches:
            for no, key, start, part in zip(*[batch.column(c).to_pylist() for c in ("no", "key", "start", "part")]):
                data = np.frombuffer(part, np.uint8)
                n, c = len(data), np.zeros(len(data), np.int64)
                wide = np.concatenate([data, np.zeros(PACK, np.uint8)]).astype(np.int64)
                for j in range(PACK):
                    c = c << 8 | wide[j : j + n]
                # Bytes past the end count as smaller than any, so a short last symbol is told from zeros in the text.
                left = np.minimum(PACK, n - np.arange(n))
                c = c << 3 | left
                prints = [rolling(data, length, b).view(np.int64) for b in _BASES]
                for at in range(0, n, 1 << 16):
                    end = min(n, at + (1 << 16))
                    p = np.arange(at, end)
                    f = [pa.array(x[at:end].tolist() + [None] * (end - at - len(x[at:end])), pa.int64()) for x in prints]
                    cells = [pa.array(no * PACK + p % PACK), pa.array(p // PACK), pa.array(c[at:end]), pa.array([key] * len(p)), pa.array(start + p), *f]
                    yield pa.RecordBatch.from_arrays(cells, names)

    return segments.mapInArrow(run, "chain long, k long, c long, key binary, at long, f0 long, f1 long")


def _ahead(rows: DataFrame, wanted: dict[str, tuple[Column, int]], by: str = "chain", place: str = "k") -> DataFrame:
    """Adds values of the rows 1 or 2 places ahead (``END`` past the end). A window covers ``BUCKET`` places at most."""
    halo = F.when((F.col(place) % BUCKET < 2) & (F.col(place) >= BUCKET), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("__back", F.explode(halo)).withColumn("__bucket", F.floor(F.col(place) / F.lit(BUCKET)) - F.col("__back"))
    window = Window.partitionBy(by, "__bucket").orderBy(place)
    out = spread.withColumns({n: F.coalesce(F.lead(e, j).over(window), F.lit(END)) for n, (e, j) in wanted.items()})
    return out.where("__back = 0").drop("__back", "__bucket")


def _smaller(rows: DataFrame, keys: list[str], counts: dict[str, Column], name: str) -> DataFrame:
    """Distinct ``keys`` with, for every count, how many rows have smaller keys (range partitions, then offsets)."""
    groups = rows.groupBy(*keys).agg(*[F.sum(e.cast("bigint")).alias(n) for n, e in counts.items()])
    table = numbered(groups, [F.col(k) for k in keys], "__no").df.withColumn("__bucket", F.floor(F.col("__no") / F.lit(BUCKET)))
    sums = table.groupBy("__bucket").agg(*[F.sum(n).alias(f"{n}_all") for n in counts])
    inside = Window.partitionBy("__bucket").orderBy("__no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _offsets(sums, list(counts))
    local = table.select(*keys, "__bucket", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in counts])
    out = local.join(offsets, "__bucket").select(*keys, *[(F.col(n) + F.col(f"{n}_off")).alias(n) for n in counts])
    return saved(out, f"smaller-{name}").df


def _offsets(sums: DataFrame, names: list[str]) -> DataFrame:
    """``__bucket`` and ``<name>_all`` -> ``<name>_off``, the sum of all buckets before; one task only sees a row per ``BUCKET`` buckets."""
    sums = sums.withColumn("__upper", F.floor(F.col("__bucket") / F.lit(BUCKET)))
    uppers = sums.groupBy("__upper").agg(*[F.sum(f"{n}_all").alias(f"{n}_sum") for n in names])
    above = Window.orderBy("__upper").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("__upper").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    uppers = uppers.select("__upper", *[F.coalesce(F.sum(f"{n}_sum").over(above), F.lit(0)).alias(f"{n}_up") for n in names])
    local = sums.select("__upper", "__bucket", *[F.coalesce(F.sum(f"{n}_all").over(beside), F.lit(0)).alias(n) for n in names])
    return local.join(uppers, "__upper").select("__bucket", *[(F.col(n) + F.col(f"{n}_up")).alias(f"{n}_off") for n in names])


def ranks(symbols: DataFrame, length: int, span: int = PACK) -> DataFrame:
    """``chain, k, c`` -> ``chain, k, r``: how many suffixes are smaller, by their first ``length`` bytes at least."""
    if span >= length:
        return symbols.select("chain", "k", F.col("c").alias("r"))
    own = F.col("c")
    triples = _ahead(symbols, {"c1": (own, 1), "c2": (own, 2)})
    sampled = saved(triples.where("k % 3 != 0"), "triples").df
    distinct = numbered(sampled.select("c", "c1", "c2").distinct(), [F.col(x) for x in ("c", "c1", "c2")], "name").df
    named = sampled.join(distinct, ["c", "c1", "c2"])
    lower = named.select((F.col("chain") * 2 + F.col("k") % 3 - 1).alias("chain"), F.floor(F.col("k") / F.lit(3)).alias("k"), F.col("name").alias("c"))
    below = ranks(saved(lower, "names").df, length, span * 3)
    up = below.select(F.floor(F.col("chain") / F.lit(2)).alias("chain"), (F.col("k") * 3 + F.pmod("chain", F.lit(2)) + 1).alias("k"), "r")
    known = symbols.join(up, ["chain", "k"], "left")
    r = F.col("r")
    known = saved(_ahead(known, {"c1": (own, 1), "r1": (r, 1), "r2": (r, 2)}), "known").df
    is_ = [F.col("k") % 3 == m for m in range(3)]
    one = _smaller(known.where("k % 3 != 2"), ["c", "r1"], {"a0": is_[0], "a1": is_[1]}, "one")
    two = _smaller(known.where("k % 3 != 1"), ["c", "c1", "r2"], {"b0": is_[0], "b2": is_[2]}, "two")
    mid = _smaller(known.where("k % 3 != 0"), ["r"], {"m1": is_[1], "m2": is_[2]}, "mid")
    first, second = known.where(is_[0]).join(one, ["c", "r1"]).join(two, ["c", "c1", "r2"]), known.where(is_[1]).join(one, ["c", "r1"]).join(mid, "r")
    third = known.where(is_[2]).join(two, ["c", "c1", "r2"]).join(mid, "r")
    whole = first.select("chain", "k", (F.col("a0") + F.col("a1") + F.col("b2")).alias("r"))
    whole = whole.union(second.select("chain", "k", F.col("a0") + F.col("a1") + F.col("m2")))
    return saved(whole.union(third.select("chain", "k", F.col("b0") + F.col("b2") + F.col("m1"))), "ranks").df


def repeated_anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Texts ``key, data``, repeated ones too -> ``key, at, h, back, n, sure`` of anchors that repeat, and ``often``, by how many rows."""
    # One exchange serves the copies of a text, which have the same anchors, and the count.
    once = _anchor_rows(texts, length, gram).repartition("h").dropDuplicates(["h", "key", "at"])
    counted = once.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("h")))
    return saved(counted.where("often > 1 OR sure > 0"), "anchors").df


def repeated_runs(texts: DataFrame, shared: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Distinct texts ``key, data, copies`` and their repeated anchors -> ``key, first, last``: runs of places where a string starts
    that also starts elsewhere in them."""
    sure = shared.where("sure > 0").select("key", (F.col("at") - F.col("back")).alias("first"), (F.col("at") - F.col("back") + F.col("sure") - 1).alias("last"))
    few = shared.where((F.col("often") > 1) & (F.col("often") <= GROUP))
    places = few.groupBy("key").agg(F.collect_list(F.struct("at", "h", "back", "n")).alias("places"))
    runs = _runs(_contexts(texts.join(places, "key"), length), length, gram).union(sure)
    many = shared.where(F.col("often") > GROUP)
    if many.isEmpty():
        return runs
    return runs.union(_starts_in_order(texts, many, length, gram).select("key", F.col("at").alias("first"), F.col("at").alias("last")))


def _starts_in_order(texts: DataFrame, many: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, at`` of repeated strings near the given anchors, from the order of all suffixes there, which no task sees whole."""
    places = many.groupBy("key").agg(F.collect_list("at").alias("at"))
    segments = numbered(_segments(texts.join(places, "key"), length, gram), [F.col("key"), F.col("start")], "no").df
    symbols = saved(_symbols(segments.select("no", "key", "start", "part"), length), "symbols").df
    order = ranks(symbols.select("chain", "k", "c"), length)
    starts = symbols.where("f0 is not null").join(order, ["chain", "k"]).select("key", "at", "f0", "f1", "r")
    # Strings that agree in their first ``length`` bytes are consecutive; equal ranks are put in the fingerprints' order. The
    # place comes last, so that range partitions can split a passage that very many texts share.
    line = numbered(starts, [F.col(x) for x in ("r", "f0", "f1", "key", "at")], "place").df.withColumn("one", F.lit(0))
    pair = F.struct("f0", "f1")
    window = _pairs(line, pair)
    return window.where("same").select("key", "at")


def _pairs(line: DataFrame, pair: Column) -> DataFrame:
    """Marks rows of a numbered line that equal the row before or behind them."""
    near = F.array_compact(F.array(
        F.lit(0), F.when(F.col("place") % BUCKET == 0, F.lit(1)), F.when(F.col("place") % BUCKET == BUCKET - 1, F.lit(-1))
    ))
    spread = line.withColumn("back", F.explode(near)).withColumn("bucket", F.floor(F.col("place") / F.lit(BUCKET)) - F.col("back"))
    window = Window.partitionBy("bucket").orderBy("place")
    same = F.coalesce(F.lag(pair).over(window) == pair, F.lit(False)) | F.coalesce(F.lead(pair).over(window) == pair, F.lit(False))
    return spread.withColumn("same", same).where("back = 0")


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """``key, data, copies, runs`` -> what is left of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            for key, text, n, runs in zip(*[batch.column(c) for c in ("key", "data", "copies", "runs")]):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                edges = np.zeros(len(data) + 1, np.int64)
                if n.as_py() > 1:
                    if len(data) >= length:
                        edges[0], edges[len(data)] = 1, -1
                elif runs.is_valid:
                    first, last = [runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last")]
                    np.add.at(edges, first, 1)
                    np.add.at(edges, last + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                left = data[~gone]
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                rows.append((key.as_py(), len(data), int(gone.sum()), spans, hashlib.sha256(left.tobytes()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    kinds = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.select("key", "data", "copies", "runs").mapInArrow(run, kinds)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A null text is empty; texts under ``length`` bytes lose nothing. Strings are judged on the input, in bytes, within one
    document each. Rows of equal text, and rows repeated whole, are copies of each other: from ``length`` bytes on all of
    them goes. An empty table gives no rows. Other columns are ignored.
    """
    rows = plain(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), F.col("text").cast("binary").alias("data"))
    shared = repeated_anchors(rows.select("key", "data"), length, gram)
    # Every step below asks for all columns of this table by its key, with the filter that joins put there, so texts are shuffled once.
    texts = rows.where("key is not null").groupBy("key").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    runs = repeated_runs(texts, shared, length, gram).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    told = _kept(texts.join(runs, "key", "left"), length)
    return rows.select("doc_id", "key").join(told, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
