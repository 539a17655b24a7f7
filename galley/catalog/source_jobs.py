"""Ordered jobs over keys that hold a large share of all rows: the lines of a source in order of document.

The views and the SQL are those of the same jobs over documents; only the key is wider, so the blocked path runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import references as R
from . import line_jobs, reference_jobs
from .registry import ORACLES, LineView, query, table


class BySource:
    """A line view with the document's source as key and one ordinal over all of its documents."""

    def __init__(self, view: LineView):
        self.view = view
        self.sql = f"(SELECT d.source AS doc_id, (v.doc_id * 1000000 + v.line_no)::BIGINT AS line_no, v.text FROM {view.sql} v JOIN documents d USING (doc_id))"

    def df(self, spark, sf):
        lines = self.view.df(spark, sf).withColumn("n", (F.col("doc_id") * 1000000 + F.col("line_no")).cast("bigint"))
        docs = table(spark, sf, "documents").select("doc_id", "source")
        return lines.join(docs, "doc_id").select(F.col("source").alias("doc_id"), F.col("n").alias("line_no"), "text")

    def oracle(self, name: str) -> str:
        return ORACLES[name].replace(self.view.sql, self.sql).replace("(doc_id + line_no)", "line_no")


def _plain(expr: str) -> str:
    return expr.replace("(doc_id + line_no)", "line_no")


LINES, REFS = BySource(line_jobs.LINES), BySource(reference_jobs.REFS)
PAIRS, SECT = BySource(reference_jobs.PAIRS), BySource(reference_jobs.SECT)


@query("repeated_lines_by_source", LINES.oracle("repeated_lines_table"))
def repeated_lines(spark, sf):
    return L.remove_repeated_lines(LINES.df(spark, sf))


@query("renumber_by_source", LINES.oracle("renumber"))
def renumber(spark, sf):
    return L.renumber(LINES.df(spark, sf).selectExpr("doc_id", f"{line_jobs.SPARSE} AS line_no"))


@query("merge_doi_lines_by_source", REFS.oracle("merge_doi_lines"))
def merge_doi_lines(spark, sf):
    return R.merge_doi_lines(REFS.df(spark, sf))


@query("assemble_references_by_source", REFS.oracle("assemble_references"))
def assemble_references(spark, sf):
    blocks = REFS.df(spark, sf).selectExpr("doc_id", "line_no AS pos", f"{_plain(reference_jobs.BLOCK_TYPE)} AS block_type", "text")
    return R.assemble_references(blocks)


@query("normalize_references_by_source", REFS.oracle("normalize_references"))
def normalize_references(spark, sf):
    return R.normalize_references(REFS.df(spark, sf))


@query("glue_pairs_by_source", PAIRS.oracle("glue_pairs"))
def glue_pairs(spark, sf):
    return R.glue_pairs(PAIRS.df(spark, sf))


@query("carry_sections_by_source", SECT.oracle("carry_sections"))
def carry_sections(spark, sf):
    paras = SECT.df(spark, sf).selectExpr("doc_id", "line_no", f"{_plain(reference_jobs.STYLE)} AS style", "text")
    out = R.carry_sections(paras)
    return out.select("doc_id", "line_no", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("content", F.lit("")).alias("content"))
