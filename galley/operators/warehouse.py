"""Issue tables: archiving, restoring, expiry, deletion, counts and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import parse_pages, start_page_loose
from ..functions.text import col
from ..plans.segments import first_per_key, positions
from .lines import safe_names


def archive_issues(current: DataFrame, issues: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """``(archived, remaining)``: rows of the named issues under a run id, and the rest. Unsafe names are ignored."""
    named = safe_names(issues.select(F.col("issue").alias("name"))).select(F.col("name").alias("issue")).distinct()
    moved = current.join(named, "issue", "left_semi").withColumn("run_id", F.lit(run_id))
    return moved, current.join(named, "issue", "left_anti")


def restore_issue(archive: DataFrame, current: DataFrame, run_id: str, issue: str, overwrite: bool = False):
    """``(table, status)``: one issue brought back. An existing issue is refused unless ``overwrite``.

    ``status`` has one row: ``restored``, ``dest_exists`` or ``not_found``.
    """
    back = archive.where((F.col("run_id") == run_id) & (F.col("issue") == issue)).drop("run_id")
    there = current.where(F.col("issue") == issue).select("issue").distinct()
    sides = back.select(F.lit(1).alias("b"), F.lit(0).alias("t")).unionByName(there.select(F.lit(0).alias("b"), F.lit(1).alias("t")))
    found, present = F.coalesce(F.max("b"), F.lit(0)) == 1, F.coalesce(F.max("t"), F.lit(0)) == 1
    status = sides.agg(
        F.when(~found, F.lit("not_found"))
        .when(present & F.lit(not overwrite), F.lit("dest_exists"))
        .otherwise(F.lit("restored"))
        .alias("status")
    )
    if overwrite:
        rest = current.join(back.select("issue").distinct(), "issue", "left_anti")
    else:
        rest, back = current, back.join(there, "issue", "left_anti")
    return rest.select(*current.columns).unionByName(back.select(*current.columns)), status


def expire_runs(runs: DataFrame, now: Column, days: int = 2, modified: str = "modified") -> DataFrame:
    """Keeps the runs modified within ``days`` before ``now``; zero or less keeps all."""
    if days <= 0:
        return runs
    return runs.where(F.col(modified) >= now - F.make_dt_interval(F.lit(days)))


def delete_article(tables: dict[str, DataFrame], victims: DataFrame) -> dict[str, DataFrame]:
    """Cascade: every table loses the rows of the given ``(issue, stem)`` pairs."""
    gone = victims.select("issue", "stem").distinct()
    return {name: df.join(gone, ["issue", "stem"], "left_anti") for name, df in tables.items()}


def drop_issue(df: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(remaining, report)``: the report counts removed rows per requested issue, zero for unknown ones."""
    asked = issues.select("issue").distinct()
    removed = df.join(asked, "issue", "left_semi").groupBy("issue").agg(F.count(F.lit(1)).alias("removed"))
    report = asked.join(removed, "issue", "left").select("issue", F.coalesce("removed", F.lit(0)).alias("removed"))
    return df.join(asked, "issue", "left_anti"), report


def issue_page_range(articles: DataFrame) -> DataFrame:
    """First to last page of every issue: one number when equal, null when nothing parses."""
    p = parse_pages("pages")
    ranged = articles.select("issue", p["min_page"].alias("lo"), p["max_page"].alias("hi"))
    lo, hi = F.min("lo"), F.max("hi")
    return ranged.groupBy("issue").agg(
        F.when(lo == hi, lo.cast("string")).when(lo.isNotNull(), F.concat_ws("-", lo, hi)).alias("pages")
    )


def issue_progress(articles: DataFrame) -> DataFrame:
    """Processed and total per issue with a status."""
    done = F.count_if(F.coalesce(F.col("processed"), F.lit(False)))
    total = F.count(F.lit(1))
    return articles.groupBy("issue").agg(
        done.alias("processed"), total.alias("total"), F.when(done == total, "done").otherwise("markup").alias("status")
    )


def issue_file_counts(files: DataFrame) -> DataFrame:
    """PDFs and other files per issue."""
    pdf = F.lower("ext") == ".pdf"
    return files.groupBy("issue").agg(F.count_if(pdf).alias("pdf_files"), F.count_if(~pdf).alias("other_files"))


def list_runs(archive: DataFrame) -> DataFrame:
    """``(run_no, run_id, issue_no, issue)``: runs numbered newest first, and in each its issues by name, one row per pair."""
    pairs = archive.select("run_id", "issue").distinct()
    runs = positions(pairs.select("run_id").distinct(), [], [F.desc("run_id")], "run_no")
    placed = positions(pairs, ["run_id"], [F.col("issue")], "issue_no").withColumnRenamed("run_id", "__run")
    return placed.join(runs, F.col("__run").eqNullSafe(F.col("run_id"))).select("run_no", "run_id", "issue_no", "issue")


def list_current(current: DataFrame) -> DataFrame:
    return current.select("issue").distinct().orderBy("issue")


def run_issue_lists(archive: DataFrame) -> DataFrame:
    """One row per run with its sorted distinct issues; the pairs are made distinct before they meet."""
    pairs = archive.select("run_id", "issue").distinct()
    return pairs.groupBy("run_id").agg(F.sort_array(F.collect_list("issue")).alias("issues"))


def invalid_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Records whose text is not a JSON document: ``(issue, name, error)``."""
    bad = F.try_parse_json(content).isNull()
    kind = F.when(F.coalesce(F.trim(content), F.lit("")) == "", "empty").otherwise("malformed")
    return files.where(bad).select("issue", "name", kind.alias("error"))


def order_articles(articles: DataFrame, *extra: str) -> DataFrame:
    """Adds ``pos``, an article's place in its issue: start page ascending, unparsable last, then lower-cased name.

    ``extra`` columns come before the page. An issue of any size is ordered by many tasks.
    """
    # The page is read once a row; a sort by the expression itself would read it at every comparison.
    keyed = articles.withColumns({"__page": parse_pages("pages")["min_page"], "__low": F.lower("name")})
    order = [*[col(e) for e in extra], F.asc_nulls_last("__page"), F.col("__low"), F.col("name")]
    return positions(keyed, ["issue"], order).drop("__page", "__low")


def article_place(pages: Column | str, name: Column | str = "name") -> Column:
    """The same order as one comparable struct, for ordered aggregation."""
    page = parse_pages(pages)["min_page"]
    return F.struct(page.isNull().alias("last"), page.alias("page"), F.lower(col(name)).alias("name"))


def order_listing(articles: DataFrame) -> DataFrame:
    """Adds ``pos``, the place in the listing of all issues: issue, loose start page with missing last, name as written."""
    keyed = articles.withColumn("__page", start_page_loose("pages"))
    return positions(keyed, [], [F.col("issue"), F.asc_nulls_last("__page"), F.col("name")]).drop("__page")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Several formats or sources to one listing."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_in_order(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """First occurrence of every key."""
    return first_per_key(df, keys, F.col(ordinal))
