"""Sharding by fixed virtual slots, in DataFrame expressions throughout.

Records are hashed into ``SLOTS`` virtual slots, a number that never changes. Bytes are summed by slot, and a map says
which shard has which slot: the heaviest slots are dealt first, each to the lightest shard. Maps are stored by version. A
later version is an edit of the one before: :func:`rebalanced` moves slots of shards that hold more than their part,
:func:`grown` moves slots to one new shard only. All else stays, so only the records of moved slots travel.

A record's hash takes its id, its content and, where rows repeat each other whole, the number of the copy. So neither an
id with many rows nor a row with many copies can fill a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

SLOTS = 4096
# Copies of a row that one array numbers.
COPIES = 1 << 16
MAP = "slot int, shard int, bytes bigint, rows bigint"


def records(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS, told_by: list[str] | None = None) -> DataFrame:
    """``doc_id, mark, n, copy, size, text_crc32, virtual`` for every row: what places it, and its virtual slot.

    Rows with the same id and ``mark`` (a hash of the columns ``told_by``, the text by default) are ``n`` copies of each
    other, numbered by ``copy`` from 0. They are counted before they move and numbered from the count, so no group meets.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    mark = F.xxhash64(*[docs[f"`{c}`"] for c in told_by or [text_col]])
    rows = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), mark.alias("mark"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "mark", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    counted = saved(counted, "counted").df
    few = counted.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    # Very many copies are numbered in blocks, which are dealt over all tasks first.
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint")))
    blocks = counted.where(F.col("n") > COPIES).withColumn("first", block).repartition("doc_id", "mark", "first")
    last = F.least(F.col("first") + (COPIES - 1), F.col("n") - 1)
    many = blocks.withColumn("copy", F.explode(F.sequence("first", last))).drop("first")
    virtual = F.pmod(F.xxhash64("doc_id", "mark", "copy"), F.lit(slots)).cast("int")
    return few.union(many.select(*few.columns)).withColumn("virtual", virtual)


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, bytes, rows`` for each of the virtual slots, empty ones too."""
    sums = recs.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    met = every.join(sums, F.col("slot") == F.col("virtual"), "left")
    return met.select("slot", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("bytes", "rows")])


def _dealt(slots: DataFrame, shards: int) -> DataFrame:
    """``slot, bytes, rows, shard``: where shard is null, the slot goes to the shard that is lightest, heaviest slots first.

    The greedy rule needs the loads after every step, so it is a fold over one array of all slots: their number is fixed.
    """
    spark = slots.sparkSession
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot"))).alias("open")
    open_ = slots.where("shard is null").agg(order)
    held = slots.where("shard is not null").groupBy(F.col("shard").alias("s")).agg(F.sum("bytes").alias("b"))
    every = spark.range(shards).join(held, F.col("id") == F.col("s"), "left")
    start = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).cast("bigint").alias("b")))).alias("pairs"))
    start = start.select(F.transform("pairs", lambda x: x["b"]).alias("loads"))
    init = F.struct(F.col("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("owner"))

    def step(state: Column, x: Column) -> Column:
        at = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda load, i: F.when(i == at, load - x["less"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["owner"], F.array(F.struct(x["slot"].alias("slot"), at.alias("shard")))).alias("owner"))

    # Both tables have one row.
    folded = open_.join(start, F.lit(True)).select(F.explode(F.aggregate("open", init, step, lambda s: s["owner"])).alias("x"))
    moved = folded.select(F.col("x.slot").alias("m"), F.col("x.shard").alias("to"))
    met = slots.join(moved, F.col("slot") == F.col("m"), "left")
    return met.select("slot", F.coalesce("shard", "to").alias("shard"), "bytes", "rows")


def _over(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """``slot, bytes, rows, shard`` with today's loads, shard null where a slot leaves: what exceeds the shard's part.

    Heavy slots stay and light ones go, so that what is left over is small.
    """
    today = loads.join(current.select(F.col("slot").alias("at"), F.col("shard")), F.col("slot") == F.col("at")).drop("at")
    part = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    held = today.withColumn("part", part).withColumn("upto", F.sum("bytes").over(upto))
    stays = (F.col("upto") <= F.col("part")) & (F.col("shard") < shards)
    return held.select("slot", "bytes", "rows", F.when(stays, F.col("shard")).alias("shard"))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """The map of version 1."""
    return _dealt(loads.withColumn("shard", F.lit(None).cast("int")), shards)


def rebalanced(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """An edit of the map for today's loads, for more shards, or for fewer: only slots above their shard's part move."""
    return _dealt(_over(current, loads, shards), shards)


def grown(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """An edit of the map for one shard more than ``shards``: slots move to the new shard and nowhere else."""
    new = F.coalesce("shard", F.lit(shards)).cast("int").alias("shard")
    return _over(current, loads, shards + 1).select("slot", new, "bytes", "rows")


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Writes a version; one that is there already is never written over, so of two editors one fails."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """``slot, shard, bytes, rows`` of a version, the last one by default."""
    every = spark.read.schema(f"{MAP}, version int").parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).drop("version")


def placed(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``: the place inside the shard, gapless from 0, by virtual slot, id and content.

    Rows are numbered inside their virtual slot; where a slot starts inside its shard comes from the map.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(F.col("slot").alias("v"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual").orderBy("doc_id", "mark", "copy")
    at = recs.withColumn("at", F.row_number().over(inside) - 1)
    # One row per virtual slot: a fixed number.
    met = at.join(F.broadcast(starts), F.col("virtual") == F.col("v"))
    return met.withColumn("slot", (F.col("start") + F.col("at")).cast("bigint")).drop("v", "start", "at")


def assign(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual`` for every row: shards of near equal bytes.

    ``size`` is the UTF-8 bytes of the text and one; a null text has no bytes and the checksum of none. A null id is an
    id like any other. Rows that repeat each other whole are dealt apart. Shards differ by about one light slot, unless a
    single text is larger than a shard's part. An empty table gives no rows. Other columns are ignored. The map is stored
    as version 1 under ``folder`` where one is given. ``grown_shard`` is null: here loads decide what a new shard takes.
    """
    recs = saved(records(docs, id_col, text_col, slots), "records").df
    slot_map = saved(first_map(slot_loads(recs, slots), shards), "slot-map").df
    if folder:
        store_map(slot_map, folder, 1)
    out = placed(recs, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual")


def write_shards(docs: DataFrame, folder: str, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """Writes all columns of ``docs`` to ``folder/shard=N`` in order of slots; every virtual slot is whole in one file.

    A shard's rows come from many tasks. Rows that repeat each other in every column are written as often as they occur.
    """
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), docs[f"`{id_col}`"].alias("i"), F.xxhash64(*[docs[n] for n in names]).alias("m"))
    at = saved(placed(records(docs, id_col, text_col, slots, docs.columns), slot_map), "placed").df
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))
    kept = ["row", "shard", "virtual", "slot"]
    once = keyed.join(at.where("n = 1"), same).select(*kept)
    # One of the repeated rows stands for all of them.
    repeated = at.where("n > 1").select(F.col("doc_id").alias("d"), F.col("mark").alias("k")).distinct()
    several = keyed.join(repeated, F.col("i").eqNullSafe(F.col("d")) & (F.col("m") == F.col("k")), "left_semi")
    single = several.groupBy("i", "m").agg(F.first("row").alias("row"))
    rows = once.union(single.join(at.where("n > 1"), same).select(*kept))
    ordered = rows.repartition("virtual").sortWithinPartitions("shard", "slot")
    ordered.select("row", "shard", "slot").write.partitionBy("shard").parquet(folder)
