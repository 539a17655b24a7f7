"""Streaming jobs over the events table: the final state must equal the batch answer."""

from __future__ import annotations

import uuid

from ..session import checkpoint_dir
from ..sources.files import enrichment_rows, snapshot_rows
from ..streaming.ingest import read_progress, write_progress
from .registry import View, query, table

_COUNT = "count(*) FILTER (value > 10)"


@query("progress_stream", f"SELECT event_type AS issue, {_COUNT} AS processed, count(*) AS total, CASE WHEN {_COUNT} = count(*) THEN 'done' ELSE 'markup' END AS status FROM events GROUP BY event_type")
def progress_stream(spark, sf):
    """The whole table as a stream, driven to its end."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.selectExpr("event_type AS issue", "value > 10 AS processed")
    base = f"{checkpoint_dir(spark)}/progress-{uuid.uuid4().hex}"
    write_progress(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return read_progress(spark, f"{base}/table")


FOUND = View("orders", ["'10.1/' || o_orderkey AS doi", "'t' || o_custkey AS title", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'u' || o_orderkey END AS url", "'ru' AS title_ru", "CASE WHEN o_orderkey % 5 = 1 THEN 'boom' ELSE '' END AS error", "'1-2' AS pages"])


@query("enrichment_rows", f"""SELECT doi AS "DOI (запрос)", title AS "Название (запрос)", url AS "URL публикации", CASE WHEN error <> '' THEN '' WHEN url = '' THEN 'не найдено' ELSE title_ru END AS "Название (RU)", '' AS "Название (EN)", '' AS "Аннотация (RU)", '' AS "Аннотация (EN)",
  CASE WHEN error <> '' OR url = '' THEN '' ELSE pages END AS "Страницы", '' AS "Список литературы (RU)", error AS "Список литературы (EN)" FROM {FOUND.sql} v""")
def enrichment(spark, sf):
    return enrichment_rows(FOUND.df(spark, sf))


SNAPS = View("orders", ["CASE WHEN o_orderkey % 2 = 0 THEN 'crossref' ELSE 'site' END AS source", "'10.1/x ' || o_orderkey AS key", "'{}' AS raw", "cast(o_custkey AS bigint) AS taken"])


@query("snapshot_rows", f"SELECT source, key, source || '_10.1_x_' || split_part(key, ' ', 2) || '_' || taken || '.json' AS name FROM {SNAPS.sql} v")
def snapshots(spark, sf):
    from pyspark.sql import functions as F

    return snapshot_rows(SNAPS.df(spark, sf), F.col("taken")).select("source", "key", "name")
