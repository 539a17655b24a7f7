"""Helpers of the vector operators: whole-number vectors, exact inner products, packed pieces and rounds of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, saved

# Scaled components are cut to this, so that they fit a long.
LARGEST = 2.0**62
# Numbers in a round of queries: 8 MB.
ROUND = 1 << 20
LONG = 2**63 - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int, **more: str) -> DataFrame:
    """``no, vec_id, v, dims`` and the columns ``more``: floor(scale * x) per component, ``no`` names the row.

    Rows without an id, without a vector, or with a null or non-finite component go. Components beyond 2^62 after
    scaling count as 2^62. The numbers are fixed when the table is written.
    """
    top = F.lit(LARGEST)
    sound = F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    x = F.transform("e", lambda c: F.floor(F.greatest(-top, F.least(top, c.cast("double") * float(scale)))).cast("bigint"))
    rows = plain(vectors, vec_id=id_col, e=vector_col, **more).where("vec_id is not null and e is not null").where(sound)
    return rows.select(F.monotonically_increasing_id().alias("no"), "vec_id", x.alias("v"), F.size("e").alias("dims"), *more)


def largest(points: np.ndarray) -> int:
    """The largest absolute component."""
    return max(-int(points.min(initial=0)), int(points.max(initial=0)))


def inner(points: np.ndarray, query: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products: through doubles or longs where no sum can leave them, else with Python's integers.

    ``most``: the largest absolute component of the points.
    """
    bound = most * largest(query) * max(1, len(query))
    if bound < 2**53:
        return (points.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound <= LONG:
        return points @ query
    return points.astype(object) @ query.astype(object)


def packed(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per piece: ``by`` and the array ``rows`` of structs of ``columns``. Pieces must be bounded."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def unpacked(cell: pa.Scalar, dims: int) -> tuple[pa.StructArray, np.ndarray]:
    """A packed piece: its columns, and its vectors as a matrix."""
    rows = cell.values
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False) if dims else np.empty(0, np.int64)
    return rows, flat.reshape(len(rows), dims)


def in_rounds(
    pieces: DataFrame, asked: DataFrame, search: Callable[[Iterator[pa.RecordBatch], pa.Table], Iterator[pa.RecordBatch]], schema: str,
    numbers: int = ROUND,
) -> DataFrame:
    """Every packed piece meets every row of ``asked`` (``no``, ``dims`` ..): a task per piece, queries by broadcast in rounds.

    A round has about ``numbers`` numbers, whatever the tables' size, and the driver holds one round at a time. Pieces are
    not copied or moved.
    """
    spark = asked.sparkSession
    size = asked.agg(F.coalesce(F.sum(F.greatest("dims", F.lit(1))), F.lit(0))).first()[0]
    count = max(1, -(-size // numbers))
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("no"), F.lit(count)))
    if count > 1:
        dealt = saved(dealt.repartitionByRange(count, "round"), "rounds").df
    out = []
    for r in range(count):
        held = spark.sparkContext.broadcast(dealt.where(F.col("round") == r).drop("round").toArrow())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return search(batches, held.value)

        found = pieces.mapInArrow(run, schema)
        out.append(saved(found, "found").df if count > 1 else found)
    return reduce(DataFrame.union, out)


def by_score(*then: str) -> list[Column]:
    """Higher scores first."""
    return [F.desc("score"), *[F.col(c) for c in then]]


def as_longs(scores) -> pa.Array:
    """Scores as longs, cut to their ends."""
    return pa.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], pa.int64())
