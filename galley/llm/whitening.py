"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the centred distinct rows, the method alternates ``u = X v - beta u'`` and ``v = X^T u - alpha v'``. A pass over the rows
does one turn of both. The long vectors u are never stored: with ``V`` the short vectors so far and ``R`` the factors,
``X V = U R``, so a row's part of ``U`` is solved from the row, ``V`` and ``R``, which are small. Both sides are fully
reorthogonalised: ``U`` by products that the same pass sums up, ``V`` on the driver. The singular values of the small
bidiagonal factor are those of X. It ends when the wanted
ones stand still, from more than one start, or when all variance is found.

Rows are whole numbers, so sums, means and centred rows come from exact arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, saved

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
# Scaled entries are cut to this, so that they fit a long.
LARGEST = 2.0**62
# Rows of a batch that are worked on at once.
ROWS = 4096
EPS = np.finfo(np.float64).eps
# A component with less than this part of the variance is none.
NONE = 1e-12
LONG = 2**63 - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x, dims``: floor(scale * c) + shift for every entry; rows with a null or non-finite entry go."""
    sound = F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    cut = F.transform("e", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * float(scale))))
    rows = plain(vectors, vec_id=id_col, e=vector_col).where("e is not null").where(sound)
    x = F.transform(cut, lambda c: F.floor(c).cast("bigint") + F.lit(shift).cast("bigint"))
    return rows.select("vec_id", x.alias("x"), F.size("e").alias("dims"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Centre:
    """Exact mean ``S / n`` of the fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as int64 where its square sums fit, else as Python integers."""
        low, high = x.min(axis=0, initial=0).astype(object), x.max(axis=0, initial=0).astype(object)
        most = max((max(abs(int(a) - int(b)), abs(int(c) - int(b))) for a, c, b in zip(low, high, self.base)), default=0) + 1
        if x.shape[1] * (self.n * most) ** 2 < LONG:
            return self.n * (x - self.base) - self.rest
        return self.n * (x.astype(object) - self.base.astype(object)) - self.rest.astype(object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return self.scaled(x).astype(np.float64) / self.n


def _summed(table: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """Sum over all rows of ``size`` numbers that ``add`` gives for a matrix; tasks add up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _matrices(batches, dims):
            total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "s"])

    parts = table.select("x").mapInArrow(run, "i long, s double")
    out = np.zeros(size)
    for i, s in parts.groupBy("i").agg(F.sum("s")).collect():
        out[i] = s
    return out


def centre(table: DataFrame, dims: int) -> Centre:
    """Count and exact sums: halves of 32 bits add up without overflow in a batch, and as decimals over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for _, x in _matrices(batches, dims):
            low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
            total = [t + a + (b << 32) for t, a, b in zip(total, low, high)]
            n += len(x)
        cells = [pa.array(range(dims + 1), pa.int64()), pa.array([str(v) for v in [*total, n]])]
        yield pa.RecordBatch.from_arrays(cells, ["i", "s"])

    parts = table.select("x").mapInArrow(run, "i long, s string")
    got = dict(parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    return Centre(int(got[dims]), [int(got[i]) for i in range(dims)])


def _orthogonal(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``w`` without its parts along ``basis``; taken off twice."""
    for _ in range(2):
        for b in basis:
            w = w - (b @ w) * b
    return w


def bidiagonal(table: DataFrame, middle: Centre, dims: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest ``k`` singular values of the centred rows over sqrt(n), squared, with right vectors as rows, and the trace.

    A turn is one pass: with ``v`` it forms ``w = X v - beta u'`` row by row and sums ``U^T w``, ``w^T w``, ``X^T w``. The first
    are the reorthogonalisation of ``u``, which then only needs small corrections of the sums.
    """
    n = middle.n
    trace = float(_summed(table, 1, lambda x: np.array([(middle.rows(x) ** 2).sum()]), dims)[0]) / n
    size = (trace * n) ** 0.5
    if not size:
        return np.empty(0), np.empty((0, dims)), 0.0
    rng, tiny = np.random.default_rng(1), 64 * EPS * size
    vs: list[np.ndarray] = []
    xtu: list[np.ndarray] = []
    pivots: list[int] = []  # of every u, the v that it came with
    factor = np.zeros((dims, dims))  # R: X V = U R

    def fresh() -> np.ndarray:
        w = _orthogonal(rng.normal(size=dims), vs)
        return w / np.linalg.norm(w)

    v, beta, since, seen = fresh(), 0.0, 0, None
    values, right = np.empty(0), np.empty((0, dims))
    while True:
        j, m = len(vs), len(xtu)
        basis, known = np.array([vs[i] for i in pivots]).reshape(-1, dims), factor[:m, pivots].copy()

        def turn(x: np.ndarray, v=v, beta=beta, basis=basis, known=known) -> np.ndarray:
            rows = middle.rows(x)
            u = _solved(rows @ basis.T, known)
            w = rows @ v - (beta * u[:, -1] if beta else 0.0)
            return np.concatenate([u.T @ w, [w @ w], rows.T @ w])

        got = _summed(table, m + 1 + dims, turn, dims)
        along, alpha = got[:m], max(0.0, got[m] - got[:m] @ got[:m]) ** 0.5
        vs.append(v)
        factor[:m, j] = along
        if beta:
            factor[m - 1, j] += beta
        beta = 0.0
        if alpha > tiny:  # else X v lies in the space of the u so far
            factor[m, j] = alpha
            pivots.append(j)
            xtu.append((got[m + 1 :] - sum((a * x for a, x in zip(along, xtu)), np.zeros(dims))) / alpha)
            w = _orthogonal(xtu[-1], vs)
            beta = float(np.linalg.norm(w))
            m += 1
        left, s, p = np.linalg.svd(factor[:m, : j + 1], full_matrices=False)
        values, right, since = s**2 / n, p @ np.array(vs), since + 1
        if j + 1 == dims or trace - values.sum() <= NONE * trace:
            break
        if beta <= tiny:
            v, beta = fresh(), 0.0
        elif m >= k and since >= k and (beta * np.abs(left[-1, :k]) <= 4 * EPS * size).all():
            # One start finds one vector of every value. Another start finds what stands beside it, or nothing new.
            if seen is not None and np.allclose(values[:k], seen, rtol=NONE, atol=0.0):
                break
            v, beta, since, seen = fresh(), 0.0, 0, values[:k]
        else:
            v = w / beta
    keep = values[:k] > NONE * trace
    return values[:k][keep], right[:k][keep], trace


def _solved(y: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``U`` with ``U factor = y`` for an upper triangular factor."""
    u = np.empty_like(y)
    for j in range(y.shape[1]):
        u[:, j] = (y[:, j] - u[:, :j] @ factor[:j, j]) / factor[j, j]
    return u


def _whitened(rows: DataFrame, middle: Centre, dims: int, values: np.ndarray, right: np.ndarray, trace: float, error: float) -> DataFrame:
    k, n = len(values), middle.n
    project, explained = (right / np.sqrt(values)[:, None]).T, values / trace
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dims):
            scaled = middle.scaled(x)
            told = (scaled * scaled).sum(axis=1).tolist()
            m = len(x)
            ids = pa.array(np.repeat(np.arange(m), k))
            cells = [
                part.column("vec_id").take(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array([d if d <= LONG else None for d in told], pa.int64()).take(ids),
                pa.array((scaled.astype(np.float64) / n @ project).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cells, names)

    id_type = rows.schema["vec_id"].dataType.simpleString()
    kinds = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select("vec_id", "x").mapInArrow(run, kinds)


def fit(table: DataFrame, dims: int, k: int = COMPONENTS) -> tuple[Centre, np.ndarray, np.ndarray, float, float]:
    """``x`` (distinct) -> centre, eigenvalues, components as rows, trace, and the largest error of the whitened covariance."""
    middle = centre(table, dims)
    values, right, trace = bidiagonal(table, middle, dims, k)
    size = len(values)
    if not size:
        return middle, values, right, trace, 0.0
    project = (right / np.sqrt(values)[:, None]).T

    def products(x: np.ndarray) -> np.ndarray:
        w = middle.rows(x) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    got = _summed(table, size + size * size, products, dims)
    mean = got[:size] / middle.n
    covariance = got[size:].reshape(size, size) / middle.n - np.outer(mean, mean)
    return middle, values, right, trace, float(np.abs(covariance - np.eye(size)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: up to ``k`` rows for every row that takes part.

    Rows whose vector is null or holds a null or non-finite entry go. The fit takes each distinct vector once; every row
    that remains is whitened, repeated rows and null ids too. Vectors of another length are a table of their own, with
    their own fit. A component with less than 1e-12 of the variance is none, so constant dimensions, empty vectors
    and a single distinct vector give fewer rows or none. A scaled entry beyond 2^62 counts as 2^62; a deviation that
    does not fit a long is null. An empty table gives no rows. Other columns are ignored.
    """
    rows = saved(quantized(vectors, id_col, vector_col, scale), "vectors").df
    # Equal vectors become one before they move.
    distinct = saved(rows.select("dims", "x").distinct(), "distinct-vectors").df
    lengths = [r.dims for r in distinct.select("dims").distinct().orderBy("dims").collect()]
    parts = []
    for dims in lengths:
        if dims:
            middle, values, right, trace, error = fit(distinct.where(F.col("dims") == dims), dims, k)
            if len(values):
                parts.append(_whitened(rows.where(F.col("dims") == dims), middle, dims, values, right, trace, error))
    if parts:
        return reduce(DataFrame.union, parts)
    none = [F.lit(None).cast(t).alias(c) for c, t in (
        ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")
    )]
    return rows.where("false").select("vec_id", *none)
