"""Hard negatives: LEMP-style buckets of like length with sorted coordinate lists, exact verification.

Vectors lie in buckets by label and falling length. A bucket keeps, for every coordinate of its unit vectors, a sorted list.
An anchor and a score that it must reach give an angle for each bucket; if no vector of the bucket is long enough, the bucket
is skipped. Otherwise the angle gives a feasible range in the lists of the anchor's focus coordinates, those where it is
largest. Vectors in all of these ranges are verified by their exact inner product.

Scores that must be reached rise: an anchor's positives start from those in its own bucket, its negatives from those found
in a few buckets, and a task goes on from what it has found in the buckets before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, saved
from .vectors import LONG, as_longs, by_score, in_rounds, inner, largest, packed, quantized, unpacked

# Numbers in a bucket: 8,192 vectors of 64 components.
BUCKET = 1 << 19
FOCUS = 3
# Buckets that negatives are looked for in first.
SEEDS = 8
# Angles are widened by this against rounding.
SLACK = 1e-7
OPEN = -LONG - 1


class Bucket:
    """Vectors of like length: whole numbers, unit vectors, and sorted lists of their coordinates, made when asked for."""

    def __init__(self, points: np.ndarray):
        self.points, self.most = points, largest(points)
        floats = points.astype(np.float64)
        lengths = np.sqrt((floats * floats).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        self.unit = floats / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f])
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, query: np.ndarray, length: float, least: int, focus: int = FOCUS) -> np.ndarray | None:
        """Places of vectors whose inner product with the query may reach ``least``; None for all of them."""
        if least <= 0 or not length or not self.longest:
            # A vector of any direction may reach it.
            return None if least <= 0 else np.empty(0, np.int64)
        cosine = least / (length * self.longest)
        if cosine > 1 + SLACK:
            return np.empty(0, np.int64)
        angle = np.arccos(min(1.0, cosine)) + SLACK
        unit = query.astype(np.float64) / length
        ranges = []
        for f in np.argsort(-np.abs(unit))[:focus].tolist():
            own = np.arccos(max(-1.0, min(1.0, unit[f])))
            low = np.cos(min(np.pi, own + angle)) - SLACK
            high = np.cos(max(0.0, own - angle)) + SLACK
            order, values = self.list_of(f)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((b - a, f, low, high, order[a:b]))
        n, first, _, _, at = min(ranges, key=lambda r: r[0])
        if n > 0.5 * len(self.points):
            return None
        for _, f, low, high, _ in ranges:
            if f != first:
                x = self.unit[at, f]
                at = at[(x >= low) & (x <= high)]
        return at


def _best(scores: np.ndarray, ids: np.ndarray, nos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k by falling score, id, row."""
    if len(scores) > 4 * k and scores.dtype != object:
        kth = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= kth
        scores, ids, nos = scores[keep], ids[keep], nos[keep]
    order = np.lexsort([nos, ids, -scores])[:k]
    return scores[order], ids[order], nos[order]


def _searched(pieces: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """Best ``k`` rows for every window of every row asked for: ``no, w, score, vec_id, found``, as each task sees them.

    ``asked``: ``no, label, dims, v, windows`` (of ``w, low, high``). ``same``: among rows of the same label, else of
    others; never the row itself.
    """

    def search(batches: Iterator[pa.RecordBatch], queries: pa.Table) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, list] = {}
        for no, label, dims, v, windows in zip(*[queries.column(c).to_pylist() for c in ("no", "label", "dims", "v", "windows")]):
            query = np.array(v, np.int64)
            length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
            by_dims.setdefault(dims, []).append((no, label, query, length, [(w["w"], w["low"], w["high"]) for w in windows]))
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column("dims")[row].as_py()
                rows, points = unpacked(batch.column("rows")[row], dims)
                ids, nos, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "no", "label"))
                bucket, first, last = Bucket(points), labels.min(), labels.max()
                for no, label, query, length, windows in by_dims.get(dims, []):
                    if not first <= label <= last if same else first == last == label:
                        continue
                    lows = []
                    for w, low, _ in windows:
                        have = held.get((no, w))
                        lows.append(max(low, int(have[0][-1])) if have and len(have[0]) == k else low)
                    at = bucket.candidates(query, length, min(lows))
                    at = np.arange(len(points)) if at is None else at
                    at = at[(labels[at] == label if same else labels[at] != label) & (nos[at] != no)]
                    if not len(at):
                        continue
                    scores = inner(points[at], query, bucket.most)
                    for (w, _, high), low in zip(windows, lows):
                        # The ends of a long bound nothing.
                        fits = (scores >= low) | (low == OPEN)
                        fits &= (scores <= high) | (high == LONG)
                        if fits.any():
                            got = (scores[fits], ids[at[fits]], nos[at[fits]])
                            have = held.get((no, w))
                            both = [np.concatenate(x) for x in zip(have, got)] if have else got
                            held[no, w] = _best(*both, k)
        names = ["no", "w", "score", "vec_id", "found"]
        # A few thousand windows to a batch.
        keys = list(held)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            sizes = [len(held[key][0]) for key in part]
            cells = [np.repeat(np.array([key[j] for key in part], np.int64), sizes) for j in (0, 1)]
            scores, ids, nos = (np.concatenate([held[key][j] for key in part]) for j in range(3))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells), as_longs(scores), pa.array(ids), pa.array(nos)], names)

    schema = "no bigint, w bigint, score bigint, vec_id bigint, found bigint"
    return in_rounds(pieces.select("dims", "rows"), asked.select("no", "label", "dims", "v", "windows"), search, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("no", "w").orderBy(*by_score("vec_id", "found"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _window(w: Column, low: Column, high: Column) -> Column:
    return F.struct(w.cast("bigint").alias("w"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def _own_bucket(pieces: DataFrame, every: int, k: int) -> DataFrame:
    """``no, floor``: the k-th best score of a positive in the anchor's own bucket, where it has so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows, points = unpacked(batch.column("rows")[row], batch.column("dims")[row].as_py())
                ids, nos, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "no", "label"))
                most, out = largest(points), []
                for i in np.flatnonzero(ids % every == 0).tolist():
                    at = np.flatnonzero(labels == labels[i])
                    at = at[at != i]
                    if len(at) >= k:
                        scores = inner(points[at], points[i], most)
                        out.append((int(nos[i]), sorted(scores.tolist())[-k]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), as_longs([s for _, s in out])], ["no", "floor"])

    return pieces.select("dims", "rows").mapInArrow(run, "no bigint, floor bigint")


def mine(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    every: int = 100,
    scale: int = 256,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    bucket: int = BUCKET,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ``every``; their positives are the best ``positives`` other rows of their label,
    and for each of them come the best ``negatives`` rows of another label with a score between ``low`` and ``high`` hundredths
    of the positive's. Best: higher score, then smaller id, then row. ``label`` computes the label (a column of
    ``vec_id`` and ``label``); the given one by default.

    Rows take no part with a null id, label or vector, or a null or non-finite component. Vectors only meet those of their
    own length. Every row counts, also where an id or a whole row repeats: an anchor id that occurs twice has two sets of
    rows. A negative positive score leaves no room between the bounds, so it has no negatives. Scores that do not fit
    a long are cut to its ends. An empty table gives no rows. Other columns are ignored.
    """
    rows = quantized(vectors, id_col, vector_col, scale, label=label_col)
    rows = rows.withColumn("label", (F.col("label") if label is None else label).cast("bigint")).where("label is not null")
    length = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    lined = numbered(saved(rows.withColumn("length", length), "vectors").df, [F.col("dims"), F.col("label"), F.desc("length"), F.col("no")], "place").df
    per = F.greatest(F.lit(1), F.floor(F.lit(bucket) / F.greatest("dims", F.lit(1))))
    lined = lined.withColumn("bucket", F.floor(F.col("place") / per))
    pieces = saved(packed(lined, ["dims", "bucket"], ["no", "vec_id", "label", "v"]), "buckets").df
    anchors = saved(lined.where(F.col("vec_id") % every == 0).select("no", "vec_id", "label", "dims", "v"), "anchors").df

    floors = saved(_own_bucket(pieces, every, positives), "floors").df.withColumnRenamed("no", "f")
    from_ = F.coalesce("floor", F.lit(OPEN))
    asked = anchors.join(floors, F.col("no") == F.col("f"), "left").withColumn("windows", F.array(_window(F.lit(0), from_, F.lit(LONG))))
    near = saved(_ranked(_searched(pieces, saved(asked, "asked").df, positives, True), positives), "positives").df
    near = near.select("no", F.col("vec_id").alias("positive_id"), F.col("found").alias("positive"), F.col("score").alias("positive_score"))

    # The bounds in whole numbers: rounded up below and down above. Positives of one score share a window.
    s = F.col("positive_score").cast("decimal(38,0)")
    least, most = F.ceil(s * low / F.lit(100)).cast("bigint"), F.floor(s * high / F.lit(100)).cast("bigint")
    wide = near.where("positive_score >= 0").select("no", _window(F.col("positive_score"), least, most).alias("window"))
    wide = wide.groupBy("no").agg(F.collect_set("window").alias("windows")).withColumnRenamed("no", "a")
    asked = saved(anchors.join(wide, F.col("no") == F.col("a")).drop("a"), "asked").df
    count = pieces.count()
    seed = F.pmod(F.xxhash64("dims", "bucket"), F.lit(max(1, count // SEEDS))) == 0
    first = saved(_ranked(_searched(pieces.where(seed), asked, negatives, False), negatives), "seeds").df
    kth = first.where(F.col("rank") == negatives).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    kth = kth.withColumnRenamed("no", "a")
    raised = F.transform("windows", lambda w: _window(w["w"], F.greatest(w["low"], F.coalesce(F.col("kth")[w["w"]], w["low"])), w["high"]))
    asked = saved(asked.join(kth, F.col("no") == F.col("a"), "left").withColumn("windows", raised).drop("a", "kth"), "asked").df
    found = first.drop("rank").union(_searched(pieces.where(~seed), asked, negatives, False))
    far = _ranked(found, negatives).select(F.col("no").alias("n"), "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select(F.col("no").alias("a"), F.col("vec_id").alias("anchor_id")), F.col("no") == F.col("a"))
    out = named.join(far, (F.col("no") == F.col("n")) & (F.col("positive_score") == F.col("w")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def tampered() -> Column:
    """The label of the registered query: the next one for ids divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score) WHERE rank <= 10"""
