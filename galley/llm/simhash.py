"""SimHash near-duplicates: fingerprints, then exact tiled comparison with exclusive-or and bit counts.

Equal fingerprints collapse first. The rest is cut into tiles of equal population counts (of every quarter, half or
whole of a fingerprint); fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of these counts, so
all other tile pairs are skipped unseen. A tile pair gives the links of a spanning forest of its graph, never all pairs;
the components are those of the full graph.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, plain, row_key, saved, taken_rows
from .components import components

SEED = 42
TILE = 1024
# Shingles whose bits are counted at once: a multiple of 255, so that byte counters cannot overflow.
_AT_ONCE = 255 * 256
# Texts that choose the order of shingles in prefixes, and how many shingles are put last. Results do not depend on them.
ORDER_TEXTS, ORDER_COMMON = 5_000, 1 << 17
# 64-bit words of a set's parities.
PARITY_WORDS = 8


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; ``bytes.split`` and ``lower`` know ASCII only."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        bits = np.unpackbits(hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _rehash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash of a shingle, from its first (a multiply and shift mix)."""
    if k == 0:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, f0 .. f{words-1}`` (64 bits each, as bigint), ``shingles`` (how many).

    ``distinct`` counts a shingle once.
    """
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = np.zeros((words, batch.num_rows), np.uint64), []
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text.as_py() or b"", width)
                if distinct:
                    hashes = np.unique(hashes)
                sizes.append(len(hashes))
                for k in range(words):
                    out[k, i] = majority_bits(_rehash(hashes, k))
            cells = [pa.array(row.view(np.int64)) for row in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells, pa.array(sizes, pa.int64())], ["doc_id", *names, "shingles"])
        give_back()

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in [*names, "shingles"]]])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _counts(names: list[str], parts: int) -> list[Column]:
    """Population counts of ``parts`` equal slices of every 64-bit word."""
    size = 64 // parts
    mask = (1 << size) - 1
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    return [
        F.bit_count(F.shiftrightunsigned(n, size * k).bitwiseAND(F.lit(mask)))
        for n in names for k in range(parts)
    ]


def _steps(slices: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors whose absolute sum is at most ``radius``."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(slices):
        out = [(*s, d) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return out


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int, near_sets=None) -> np.ndarray:
    """Links (rows of two positions in ``a`` followed by ``b``) that span the graph of one tile pair.

    ``near_sets(x, y)`` may refuse a pair of positions; pairs that others connect already are not asked about. Pairs are
    taken nearest first, which connects most of them soon.
    """
    other = a if b is None else b
    near, far, gap = [], [], []
    block = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(a), block):
        bits = np.bitwise_count(a[at : at + block, None, 0] ^ other[None, :, 0]).astype(np.uint16)
        for k in range(1, a.shape[1]):
            bits += np.bitwise_count(a[at : at + block, None, k] ^ other[None, :, k])
        i, j = np.nonzero(bits <= radius)
        gap.append(bits[i, j])
        near.append(i + at)
        far.append(j)
    i, j, d = np.concatenate(near), np.concatenate(far), np.concatenate(gap)
    if b is None:
        keep = i < j
        i, j, d = i[keep], j[keep], d[keep]
    else:
        j = j + len(a)
    parent = list(range(len(a) + (0 if b is None else len(b))))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    order = np.argsort(d, kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        p, q = root(x), root(y)
        if p != q and (near_sets is None or near_sets(x, y)):
            parent[max(p, q)] = min(p, q)
            links.append((x, y))
    return np.array(links, np.int64).reshape(-1, 2)


def links(classes: DataFrame, names: list[str], radius: int, cell: list[Column], steps: list[tuple[int, ...]], tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (64-bit columns ``names``) -> ``u0 .., v0 ..``: links that span the graph of all near pairs.

    ``cell`` are whole numbers of a fingerprint; two fingerprints can only be within ``radius`` if their numbers differ
    by one of ``steps`` or its opposite. Tiles of other cells are skipped.
    """
    words = len(names)
    celled = classes.select(*names, F.concat_ws(",", *cell).alias("cell"))
    # The numbers bound how many cells there are; tiles bound what a cell holds.
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = celled.join(sizes, "cell").withColumn(
        "sub", F.pmod(F.xxhash64(*names), F.ceil(F.col("n") / tile)).cast("int")
    )
    pack = [F.collect_list(F.struct(*names)).alias("prints")]
    tiles = dealt.groupBy("cell", "sub").agg(*pack)
    tiles = tiles.select("cell", "sub", *[F.col(f"prints.{n}").alias(n) for n in names])
    tiles = saved(tiles, "tiles").df
    steps = [s for s in steps if s >= (0,) * len(s)]
    mine = F.split("cell", ",")
    near = [F.concat_ws(",", *[mine[k].cast("int") + F.lit(d) for k, d in enumerate(s)]) for s in steps]
    left = tiles.select(F.col("cell").alias("own"), F.col("sub").alias("i"), *[F.col(n).alias(f"a_{n}") for n in names],
                        F.explode(F.array(*near)).alias("cell"))
    right = tiles.select("cell", F.col("sub").alias("j"), *[F.col(n).alias(f"b_{n}") for n in names])
    pairs = left.join(right, "cell").where((F.col("own") != F.col("cell")) | (F.col("i") <= F.col("j")))
    same = ((F.col("own") == F.col("cell")) & (F.col("i") == F.col("j"))).alias("same")
    pairs = pairs.select(same, *[f"a_{n}" for n in names], *[f"b_{n}" for n in names])
    ends = [f"{e}{k}" for e in "uv" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch: pa.RecordBatch, prefix: str, row: int) -> np.ndarray:
            cells = [batch.column(f"{prefix}_{n}")[row].values.to_numpy(zero_copy_only=False) for n in names]
            return np.stack(cells, axis=1).view(np.uint64)

        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                a = side(batch, "a", row)
                b = None if batch.column("same")[row].as_py() else side(batch, "b", row)
                got = _forest(a, b, radius)
                if len(got):
                    both = a if b is None else np.concatenate([a, b])
                    found.append(np.concatenate([both[got[:, 0]], both[got[:, 1]]], axis=1))
            if found:
                cells = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells.T.copy()], ends)
        give_back()

    return pairs.mapInArrow(run, ", ".join(f"{e} bigint" for e in ends))


def hex_of(names: list[str]) -> Column:
    """Sixteen lowercase hex digits per 64-bit word."""
    return F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in names])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 2,
    parts: int = 4,
    tile: int = TILE,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: components of fingerprints within ``radius`` of 64 bits.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Fewer than ``width``
    words are one shingle. Rows may repeat; each keeps its row. ``component_id`` is the least non-null id that can be
    reached (null if there is none). An empty table gives an empty result. Other columns are ignored.
    """
    rows = saved(fingerprints(plain(docs, doc_id=id_col, text=text_col), width).drop("shingles"), "prints").df
    classes = rows.groupBy("f0").agg(F.min("doc_id").alias("least_id"))
    found = links(classes, ["f0"], radius, _counts(["f0"], parts), _steps(parts, radius), tile)
    roots = components(found.toDF("u", "v")).df
    members = classes.join(roots.select(F.col("u").alias("f0"), F.col("v").alias("root")), "f0", "left")
    members = members.withColumn("root", F.coalesce("root", "f0"))
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = members.join(least, "root").select("f0", "component_id")
    return rows.join(named, "f0").select("doc_id", hex_of(["f0"]).alias("fingerprint"), "component_id")


def bits_apart(similarity: float, bits: int, sigmas: float = 3.0) -> int:
    """Differing bits of two shingle sets of the given Jaccard similarity: the mean and ``sigmas`` deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    return int(bits * share + sigmas * (bits * share * (1 - share)) ** 0.5)


def _near_sets(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted distinct hashes) have at least the given Jaccard similarity."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common)


def _all_near(p: pa.Array, q: pa.Array, similarity: float) -> pa.Array:
    both = zip(p, q)
    return pa.array([_near_sets(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), similarity) for pair in both], pa.bool_())


def _similar_links(sets: DataFrame, names: list[str], radius: int, similarity: float, tile: int) -> DataFrame:
    """``comp, num, f0 .., shingles`` (binary) -> ``u, v`` (numbers): links within ``radius`` whose sets are similar enough.

    The same tiled comparison as :func:`links`, inside provisional components, where a pair also has to pass the exact
    comparison of its sorted shingle hashes.
    """
    sizes = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    dealt = sets.join(sizes, "comp").withColumn("sub", F.pmod(F.xxhash64(*names), F.ceil(F.col("n") / tile)).cast("int"))
    tiles = dealt.groupBy("comp", "sub").agg(F.collect_list(F.struct("num", *names, "shingles")).alias("own"))
    tiles = saved(tiles, "set-tiles").df
    right = tiles.select("comp", F.col("sub").alias("j"), F.col("own").alias("other"))
    other = F.when(F.col("sub") < F.col("j"), F.col("other")).alias("other")
    pairs = tiles.join(right, "comp").where("sub <= j").select("own", other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            rows = cell.values
            nums = rows.field("num").to_numpy(zero_copy_only=False)
            prints = np.stack([rows.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1).view(np.uint64)
            return nums, prints, [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("shingles")]

        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                nums, a, held = side(batch.column("own")[row])
                b, cell = None, batch.column("other")[row]
                if cell.is_valid:
                    others, b, more = side(cell)
                    nums, held = np.concatenate([nums, others]), held + more

                def near(x: int, y: int) -> bool:
                    return _near_sets(held[x], held[y], similarity)

                got = _forest(a, b, radius, near)
                if len(got):
                    found.append(nums[got])
            if found:
                cells = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells.T.copy()], ["u", "v"])
        give_back()

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Replaces ``text`` by ``shingles``: the sorted distinct 64-bit hashes of its shingles."""

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([np.unique(shingle_hashes(t.as_py() or b"", width)).tobytes() for t in texts], pa.binary())
        give_back()
        return out

    sets = F.arrow_udf(run, "binary")(F.col("text").cast("binary"))
    return texts.select(*[c for c in texts.columns if c != "text"], sets.alias("shingles"))


def _common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, from about ``ORDER_TEXTS`` texts. They only choose an order."""
    every = max(1, texts.count() // ORDER_TEXTS)
    some = _shingle_sets(texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *cells]))], ["s"])

    counts = some.mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    top = counts.orderBy(F.desc("n"), "s").limit(ORDER_COMMON).select("s").toArrow().column("s").to_numpy()
    return np.sort(top.view(np.uint64))


def parities(hashes: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Whether a set has an odd number of elements in each of ``64 * words`` classes.

    Every element that only one of two sets holds changes one bit, so sets differ in at least as many elements as bits.
    """
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_prints(docs: DataFrame, width: int, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, f0 .., p0 .., shingles, set, prefix``: fingerprint, parities and size of the shingle
    set, a 128-bit name of it, and its first shingles.

    All sets are in one order: shingles in ``common`` last, then by hash. Of ``n`` shingles the prefix has all but
    ``ceil(similarity * n) - 1``, so two sets of that similarity share at least one shingle of their prefixes.
    """
    names, odds = [f"f{k}" for k in range(words)], [f"p{k}" for k in range(PARITY_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small batches: a prefix has about half the bytes of its text.
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out, sizes, sets, first = np.zeros((words, batch.num_rows), np.uint64), [], [], []
            odd = np.zeros((PARITY_WORDS, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column("text")):
                hashes = np.unique(shingle_hashes(text.as_py() or b"", width))
                n = len(hashes)
                for k in range(words):
                    out[k, i] = majority_bits(_rehash(hashes, k))
                odd[:, i] = parities(hashes)
                sizes.append(n)
                sets.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                last = np.zeros(n, bool)
                if n and len(common):
                    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                ordered = np.concatenate([hashes[~last], hashes[last]])
                first.append(ordered[: n - math.ceil(similarity * n - 1e-6) + 1].view(np.int64))
            cells = [pa.array(row.view(np.int64)) for row in out] + [pa.array(row) for row in odd]
            cells += [pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], ["doc_id", *names, *odds, "shingles", "set", "prefix"])
        give_back()

    fields = [T.StructField(n, T.LongType()) for n in [*names, *odds, "shingles"]]
    fields += [T.StructField("set", T.StringType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema["doc_id"], *fields])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _shared_shingles(members: DataFrame) -> DataFrame:
    """``num, root, p0 .., shingles, prefix`` -> ``shingle, num, root, size, rest, p0 ..``: shingles in prefixes of several
    roots. The others meet nothing and go first, so only the rest travels with its parities.
    """
    each = members.select("num", "root", F.explode("prefix").alias("shingle"))
    spans = each.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    met = each.select("num", "shingle").join(spans.select("shingle"), "shingle", "left_semi")
    size, rest = F.col("shingles").cast("int").alias("size"), (F.col("shingles") - F.size("prefix")).cast("int").alias("rest")
    return met.join(members.select("num", "root", size, rest, *[f"p{k}" for k in range(PARITY_WORDS)]), "num")


def _meetings(shared: DataFrame, similarity: float) -> DataFrame:
    """Two sets of different roots at every shingle that their prefixes share, ``u, v, needed``: unless sizes or parities
    tell that they are not similar.

    Parities of similar sets differ in no more bits than the sets may in elements. Without this all pairs of texts around one
    passage would be made, once for every shingle of it. Rows of one shingle meet in an equi join on Spark's own exchange,
    which adaptive execution splits when a shingle is hot.
    """
    a, b = (shared.select("shingle", *[F.col(c).alias(f"{c}_{e}") for c in shared.columns if c != "shingle"]) for e in "ab")
    sizes = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity) - 1e-6
    both = F.col("size_a") + F.col("size_b")
    bits = [F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(PARITY_WORDS)]
    near = sum(bits, F.lit(0)) <= both * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    met = a.join(b, "shingle").where((F.col("num_a") < F.col("num_b")) & (F.col("root_a") != F.col("root_b")) & sizes & near)
    needed = both * F.lit(similarity / (1 + similarity)) - 1e-6 - F.greatest("rest_a", "rest_b")
    return met.select(F.col("num_a").alias("u"), F.col("num_b").alias("v"), needed.alias("needed"))


def _prefix_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """``num, root, p0 .., shingles, prefix`` -> ``u, v``: every pair of different roots whose sets can be similar enough.

    A similar pair shares shingles of its prefixes. What two sets have in common is either in both prefixes, and counted
    here, or behind the prefix that ends first; pairs that this bound rules out go.
    """
    shared = saved(_shared_shingles(members), "shared-shingles")
    met = _meetings(shared.df, similarity).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    pairs = saved(met.where("n >= needed").select("u", "v"), "pairs").df
    shared.drop()
    return pairs


def distinct_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    words: int = 4,
    tile: int = TILE,
    set_tile: int = 256,
) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates: the least id (null last).

    Two documents are near when their sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more. A group is all that near pairs connect. Most of it is found by ``64 * words`` bits of SimHash over the sets:
    pairs within the expected number of differing bits and three standard deviations, in cells of a step of the size's
    logarithm and a band of population counts. Pairs that this misses share a shingle of their prefixes in one common
    order, so a join of prefixes finds them all; only sets that are not connected yet are compared. The sets decide in
    both steps. Texts without a word are duplicates of each other. Rows equal in all columns are one row. An empty
    table stays empty.
    """
    names, radius = [f"f{k}" for k in range(words)], bits_apart(similarity, 64 * words)
    key, text = row_key(docs, id_col), F.col(f"`{text_col}`")
    keyed = docs.select(key.alias("doc_id"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    texts = keyed.select("doc_id", "text")
    prints = saved(_set_prints(texts, width, words, similarity, _common_shingles(texts, width)), "prints")
    # Equal sets are one; the number is fixed by writing it.
    sets = prints.df.withColumnRenamed("doc_id", "key").dropDuplicates(["set"])
    distinct = saved(sets.withColumn("num", F.monotonically_increasing_id()), "sets")
    sets, rows = distinct.df, saved(prints.df.select("doc_id", "set").distinct(), "rows").df
    prints.drop()
    # Equal fingerprints meet the tiles once, in the cell of the smallest set.
    node = hex_of(names)
    classes = sets.groupBy(*names).agg(F.min("shingles").alias("shingles"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes, "classes").df
    step = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1)).cast("double")) / float(-np.log(similarity)) + 1e-9)
    band = F.floor(sum((F.bit_count(n) for n in names), F.lit(0)) / (radius + 1))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]

    found = links(classes, names, radius, [step, band], around, tile)
    loose = components(found.select(*[hex_of([f"{e}{k}" for k in range(words)]).alias(e) for e in "uv"])).df
    loose = loose.union(loose.select("v", "v").distinct()).toDF("u", "comp")
    open_ = classes.select(*names, "n", node.alias("u")).join(loose, "u", "left").where("n > 1 or comp is not null")
    stands = saved(open_.select(*names, F.coalesce("comp", "u").alias("comp")), "candidates").df
    # The texts of candidates only, one of each set.
    named = sets.select("key", "num", *names).join(stands, names).select("key", "num", "comp", *names)

    def with_sets(some: DataFrame) -> DataFrame:
        held = texts.withColumnRenamed("doc_id", "key").join(some, "key")
        return _shingle_sets(held, width).drop("key").dropDuplicates(["num"])

    close = saved(_similar_links(with_sets(named), names, radius, similarity, set_tile), "links").df
    near = components(close).df
    members = sets.join(near.select(F.col("u").alias("num"), F.col("v").alias("root")), "num", "left")
    odds = [f"p{k}" for k in range(PARITY_WORDS)]
    members = members.select("num", F.coalesce("root", "num").alias("root"), *odds, "shingles", "prefix").where("shingles > 0")
    pairs = _prefix_pairs(members, similarity)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("num")).distinct()
    held = saved(with_sets(sets.select("key", "num").join(ends, "num")), "pair-sets")
    left, right = (held.df.select(F.col("num").alias(e), F.col("shingles").alias(f"set_{e}")) for e in "uv")
    similar = F.arrow_udf(lambda p, q: _all_near(p, q, similarity), "boolean")(F.col("set_u"), F.col("set_v"))
    missed = pairs.join(left, "u").join(right, "v").where(similar).select("u", "v")
    roots = components(close.union(missed)).df

    rooted = sets.select("set", "num").join(roots.select(F.col("u").alias("num"), "v"), "num", "left")
    rooted = rooted.select("set", F.coalesce("v", "num").alias("root"))
    grouped = rows.select(F.col("doc_id").alias("key"), "set").join(rooted, "set").select("key", "root")
    ids = keyed.groupBy(F.col("doc_id").alias("key"), "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("first")
    chosen = grouped.join(ids, "key").groupBy("root").agg(first).select("first.key", "first.n", F.lit(1).alias("copies"))
    chosen = saved(chosen, "chosen").df
    for table in (distinct, held):
        table.drop()
    return taken_rows(docs, key, chosen)
