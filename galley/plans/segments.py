"""Ordered work inside a key without sorting a very large key in one task.

A window partitioned by a document sends all lines of that document to one task. That is right while documents are
bounded, as they are when their lines came out of one text cell, and it needs a single exchange. It is wrong when one
key holds a large share of a table. So every helper takes ``bounded``:

* ``True``: the caller knows that every key's rows came from one cell: plain windows.
* ``False`` (default): keys are cut into blocks of consecutive ordinals; the ordered work runs per (key, block), blocks roll up
  to one summary row each, what crosses block borders is resolved on those few rows and joined back on (key, block).
  No window or join key covers more than ``BLOCK`` rows of the big table. The input is checkpointed first, so a chain
  of steps keeps a linear plan and survives lost executors.

Which one is the caller's knowledge of what the rows are, never a count of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK = 1 << 16
_B = "__block"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over all cores; a layout step for tables of one row group, not a rule of any job.

    Work on text cells is bound by the processor, and a scan of many files already has a task per split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# Tasks that a split of a table of text cells is dealt to: a cell is set out as many times its bytes in sorted rows.
DEALT = 16


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table of text cells dealt by their key, before its cells are set out as rows: steps by key, or by key and more,
    then find their rows in place, and no word or character is shuffled.

    The splits of the table, and with them the tasks, grow with it, so what one task sorts does not.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, DEALT * df.rdd.getNumPartitions()), key)


def cut(df: DataFrame) -> DataFrame:
    """The table as it is written to the checkpoint folder: made once, with a short lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _with_block(df: DataFrame, ordinal: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(ordinal) / F.lit(block)).cast("bigint"))


def _join_back(local: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Null-safe equi join that keeps the left column names."""
    renamed = summary.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in summary.columns])
    cond = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = part if cond is None else cond & part
    return local.join(renamed, cond, "left").drop(*[f"__r_{c}" for c in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    *,
    sums: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    order: Sequence[str] | None = None,
    band: Column | None = None,
    bounded: bool = False,
    block: int | None = None,
) -> DataFrame:
    """Add exact running sums, carried-forward values, previous and next values in ordinal order.

    ``sums``: inclusive running sum. ``carries``: last non-null value up to and including the row. ``lags`` and
    ``leads``: the value on the previous or next row of the key. The ordinal is an integer, unique within a key; gaps
    are fine. Tables without one give ``order`` (columns) and ``band`` (an integer that grows with the order) instead.
    """
    sums, carries, lags, leads = dict(sums or {}), dict(carries or {}), dict(lags or {}), dict(leads or {})
    keys = list(keys)
    extra = [*sums, *carries, *lags, *leads]
    if not extra:
        return df
    by = list(order or [ordinal])
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*by)
        to_here = w.rowsBetween(Window.unboundedPreceding, 0)
        added = {n: F.sum(e.cast("bigint")).over(to_here) for n, e in sums.items()}
        added |= {n: F.last(e, ignorenulls=True).over(to_here) for n, e in carries.items()}
        added |= {n: F.lag(e).over(w) for n, e in lags.items()}
        added |= {n: F.lead(e).over(w) for n, e in leads.items()}
        return df.withColumns(added)
    base = cut(df)
    base = base.withColumn(_B, band.cast("bigint")) if band is not None else _with_block(base, ordinal, block or BLOCK)
    place = F.struct(*by)
    for name, expr in sums.items():
        base = base.withColumn(f"__s_{name}", expr.cast("bigint"))
    for name, expr in {**carries, **lags, **leads}.items():
        base = base.withColumn(f"__v_{name}", expr)

    inner = Window.partitionBy(*keys, _B).orderBy(*by)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for name in sums:
        local = local.withColumn(name, F.sum(f"__s_{name}").over(upto))
    for name in carries:
        local = local.withColumn(name, F.last(f"__v_{name}", ignorenulls=True).over(upto))
    for name in lags:
        local = local.withColumn(name, F.lag(f"__v_{name}").over(inner))
        local = local.withColumn(f"__first_{name}", F.row_number().over(inner) == 1)
    for name in leads:
        local = local.withColumn(name, F.lead(f"__v_{name}").over(inner))
        local = local.withColumn(f"__next_{name}", F.lead(F.lit(1)).over(inner))

    aggs = []
    for name in sums:
        aggs.append(F.sum(f"__s_{name}").alias(f"__t_{name}"))
    for name in carries:
        value = F.col(f"__v_{name}")
        aggs.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(f"__t_{name}"))
    for name in lags:
        aggs.append(F.max_by(F.struct(f"__v_{name}"), place).alias(f"__t_{name}"))
    for name in leads:
        aggs.append(F.min_by(F.struct(f"__v_{name}"), place).alias(f"__t_{name}"))
    blocks = base.groupBy(*keys, _B).agg(*aggs)
    outer = Window.partitionBy(*keys).orderBy(_B)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    for name in sums:
        blocks = blocks.withColumn(f"__c_{name}", F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)))
    for name in carries:
        blocks = blocks.withColumn(f"__c_{name}", F.last(f"__t_{name}", ignorenulls=True).over(before))
    for name in lags:
        blocks = blocks.withColumn(f"__c_{name}", F.lag(f"__t_{name}").over(outer).getField(f"__v_{name}"))
    for name in leads:
        blocks = blocks.withColumn(f"__c_{name}", F.lead(f"__t_{name}").over(outer).getField(f"__v_{name}"))
    border = [f"__c_{n}" for n in [*sums, *carries, *lags, *leads]]
    out = _join_back(local, blocks.select(*keys, _B, *border), [*keys, _B])
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"__c_{name}"))
    for name in carries:
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"__c_{name}")))
    for name in lags:
        out = out.withColumn(name, F.when(F.col(f"__first_{name}"), F.col(f"__c_{name}")).otherwise(F.col(name)))
    for name in leads:
        out = out.withColumn(
            name, F.when(F.col(f"__next_{name}").isNull(), F.col(f"__c_{name}")).otherwise(F.col(name))
        )
    kept = [c for c in df.columns if c not in extra]
    return out.select(*kept, *extra)


def with_totals(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    totals: Mapping[str, tuple[str, Column]],
    *,
    bounded: bool = False,
    block: int | None = None,
) -> DataFrame:
    """Add per-key totals to every row. ``totals``: name -> (``count``/``sum``/``min``/``max``, column)."""
    keys = list(keys)
    if bounded:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: getattr(F, kind)(e).over(w) for n, (kind, e) in totals.items()})
    base = _with_block(cut(df), ordinal, block or BLOCK)
    part, whole = [], {}
    for name, (kind, expr) in totals.items():
        if kind == "count":
            part.append(F.count(expr).alias(name))
            whole[name] = F.sum
        else:
            part.append(getattr(F, kind)(expr).alias(name))
            whole[name] = getattr(F, kind)
    blocks = base.groupBy(*keys, _B).agg(*part)
    w = Window.partitionBy(*keys)
    for name, fn in whole.items():
        blocks = blocks.withColumn(name, fn(name).over(w))
    return _join_back(base, blocks, [*keys, _B]).drop(_B)


def row_numbers(
    df: DataFrame, keys: Sequence[str], ordinal: str, name: str = "rn", bounded: bool = False
) -> DataFrame:
    """Dense 1..n numbering in ordinal order, exact across blocks."""
    return running(df, keys, ordinal, sums={name: F.lit(1)}, bounded=bounded)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place from 1 inside its key by any order, or in the whole table without keys.

    Rows are range-partitioned by key and order, so a key of any size is split by place; a partition numbers its own rows,
    and what stands before it inside the key comes from one summary row per key and partition. Rows that tie in the
    order are numbered as they come. ``order`` should be plain columns: a sort asks for an expression at every comparison.
    """
    keys = list(keys)
    by = [*[F.col(k) for k in keys], *order]
    lined = df.repartitionByRange(*by).sortWithinPartitions(*by)
    lined = cut(lined.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    pieces = lined.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    met = _join_back(lined, starts, [*keys, "__part"])
    return met.select(*df.columns, (F.col("__at") + F.col("__add")).alias(name))


# Width of the numbers that a place in an order is packed from.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def packed(df: DataFrame, order: Sequence[Column]) -> Column:
    """Whole numbers of at most 64 bits together, null first, and a hash of the row behind them, as one decimal."""
    tie = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 4)
    out = F.lit(0).cast("decimal(38,0)")
    for o in order:
        bits = _BITS[df.select(o.alias("o")).schema[0].dataType.simpleString()]
        out = (out * F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(38,0)")
        out = (out + F.coalesce(o.cast("decimal(20,0)"), F.lit(str(-(1 << (bits - 1)))).cast("decimal(20,0)"))).cast("decimal(38,0)")
    return ((out * F.lit(str(1 << 60)).cast("decimal(19,0)")).cast("decimal(38,0)") + tie.cast("decimal(20,0)")).cast("decimal(38,0)")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key by ``order`` (numbers, null first); of rows that tie, one by a hash of the row.

    Two phases: a hash aggregate of the place alone, which fits its buffers and combines before it moves, then a
    semi-join on key and place takes the rows. Nothing is sorted by key, and no row travels inside an aggregate. Fractions
    take a round of their own each; whole numbers of together 64 bits and the tie take one.
    """
    keys, names = list(keys), df.columns
    kinds = [df.select(o.alias("o")).schema[0].dataType.simpleString() for o in order]
    taken = 0
    while taken < len(order) and kinds[taken] in _BITS and sum(_BITS[k] for k in kinds[: taken + 1]) <= 64:
        taken += 1
    last = taken == len(order)
    place = packed(df, order[:taken]) if last else (order[0].cast("bigint") if kinds[0] in _BITS else order[0].cast("double"))
    least = F.lit(str(-(1 << 63))).cast("bigint") if kinds and kinds[0] in _BITS else F.lit(float("-inf"))
    placed = df.withColumn("__p", place if last else F.coalesce(place, least))
    tops = placed.groupBy(*keys).agg(F.min("__p").alias("__least")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.col("__p") == F.col("__least")
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__k_{k}`"))
    rows = placed.join(tops, same, "left_semi").select(*[F.col(f"`{c}`") for c in names])
    # Rows that repeat each other whole are one; a distinct keeps no buffers.
    return rows.distinct() if last else first_per_key(rows, keys, *order[1:])


def island_text(ordinal: str, text: str, sep: str = " ") -> Column:
    """Ordered concatenation for use inside ``groupBy(keys).agg``."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)
