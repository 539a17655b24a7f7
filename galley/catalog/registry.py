"""Registry of runnable queries: a Spark callable and, where SQL can say it, the equivalent oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.segments import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# Tables whose queries work on text cells; see ``spread``.
TEXT_TABLES = {"documents", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = read(spark, sf_dir, name)
    return spread(df) if name in TEXT_TABLES else df


class View:
    """A derived input built by the same scalar expressions in both engines."""

    def __init__(self, source: str, columns: Sequence[str], where: str | None = None, wide: bool = False):
        self.source, self.columns, self.where, self.wide = source, list(columns), where, wide

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir, self.source)
        if self.where:
            base = base.where(self.where)
        return (spread(base) if self.wide else base).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        where = f" WHERE {self.where}" if self.where else ""
        return f"(SELECT {', '.join(self.columns)} FROM {self.source}{where})"


def scalar(name: str, view: View, key: str, make, sql_expr: str):
    """Registers one Column function over a view: ``key`` and ``out``."""

    @query(name, f"SELECT {key}, {sql_expr} AS out FROM {view.sql} v")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view.df(spark, sf_dir).select(key, make().alias("out"))

    return run


class LineView:
    """Documents to lines in both engines: ``doc_id, line_no, text`` (+ ``page`` when asked)."""

    def __init__(self, expr: str = "text", line_expr: str = "text", per_page: int = 0):
        self.expr, self.line_expr, self.per_page = expr, line_expr, per_page

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"split({self.expr}, '\\n') AS ls")
        lines = docs.selectExpr("doc_id", "posexplode(ls) AS (line_no, text)")
        page = [f"cast(floor(line_no / {self.per_page}) AS int) + 1 AS page"] if self.per_page else []
        return lines.selectExpr("doc_id", *page, "line_no", f"{self.line_expr} AS text")

    @property
    def sql(self) -> str:
        page = f"cast(floor(line_no / {self.per_page}) AS int) + 1 AS page, " if self.per_page else ""
        return (
            f"(SELECT doc_id, {page}line_no, {self.line_expr} AS text FROM (SELECT doc_id, "
            f"unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS text FROM (SELECT doc_id, "
            f"string_split({self.expr}, chr(10)) AS ls FROM documents) d0) d1)"
        )
