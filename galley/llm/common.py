"""Helpers of the training-data operators: intermediate tables in the shared folder, dense numbering, plain inputs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset it is only acceptable in a local session (tests), which gets a fresh temporary folder for its lifetime.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="galley-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def give_back() -> None:
    """At the end of a Python task: memory that it has freed goes back to the system, since workers live on idle."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@dataclass
class Saved:
    """A table written to the shared folder: its lineage is a file scan, so a lost executor costs one split."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Deletes the files; only for tables that no returned DataFrame still reads."""
        spark = self.df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> Saved:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galley-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Saved(spark.read.schema(df.schema).parquet(path), path)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; columns the input has besides cannot clash with ours."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def numbered(df: DataFrame, order: list[Column], name: str) -> Saved:
    """Dense numbers from 0 in the given order: range partitions, a number inside each, one offset per partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("bigint"), 33))
    table = saved(ranged, "numbered")
    # One row per partition, whatever the table's size.
    sizes = table.df.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = table.df.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at"))
    return Saved(out.drop("__part", "__at", "__start"), table.path)


def row_key(df: DataFrame, id_col: str, *cols: str) -> Column:
    """Names a row: its id in clear (``~`` for null) and a hash of the given columns, all by default."""
    told = F.xxhash64(*[F.col(f"`{c}`") for c in cols or df.columns]).cast("string")
    return F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), told)


def taken_rows(df: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``chosen`` (``key, n, copies``), ``copies`` times; other rows go.

    ``n`` rows of one key repeat each other in all columns and stand as one. Rows move once, to meet their decision.
    """
    # The row travels as one column, so that no name of it meets one of ours.
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    small = chosen.select(F.col("key").alias("k"), "n", F.col("copies").cast("int").alias("copies"))
    met = row.join(small, F.col("key") == F.col("k"))
    once = met.where("n = 1").select("row", "copies")
    if not chosen.where("n > 1").isEmpty():
        # One of the repeated rows stands for all, found by an aggregate that combines before it moves.
        once = once.union(met.where("n > 1").groupBy("row", "copies").agg(F.lit(1)).select("row", "copies"))
    again = once.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
