"""URL filters: dated list entries become validity intervals, and captures meet the ones active when they were fetched.

An entry adds a pattern to a list or takes it off; it holds until the next entry of the same list and pattern. A capture
has the patterns ``host:``, ``domain:`` (itself and every parent of two labels or more) and ``path:`` (host and every leading part of
the path). Both sides meet on (pattern, time cell): an interval is covered by few cells of base-8 sizes, each second in
exactly one of them, and a capture lies in one cell of each size. So a capture only meets entries that are active in its cell,
and a pattern that holds a third of all captures or entries is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, plain, saved

BASE, LEVELS = 8, 15
# Seconds are counted from this long before 1970, so that all times a table can hold are above zero, and an open interval ends
# where the cells end, after all of them.
BEFORE, FOREVER = BASE**14, BASE**LEVELS
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: Column) -> Column:
    """All patterns that name the url; empty for a null or a text that is no url."""
    host = host_of(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), "."))
    )
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    paths = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))),
        lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    every = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>")))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``list, pattern, ts, seq, action`` -> ``list, pattern, since, until`` (until is excluded; null is open).

    ``action`` is ``add`` or ``remove``; entries with a null list, pattern, time or another action say nothing. Of
    entries at one time the largest ``seq`` counts, and a removal among equals.
    """
    said = entries.where("list is not null and pattern is not null and ts is not null and action in ('add', 'remove')")
    last = F.max_by(F.col("action") == "add", F.struct(F.coalesce("seq", F.lit(-1)), F.col("action") == "remove"))
    states = said.groupBy("list", "pattern", "ts").agg(last.alias("on")).withColumn("day", F.to_date("ts"))
    # The next state is looked for within the day; the last of a day takes the first of the next day that has any.
    inside = Window.partitionBy("list", "pattern", "day").orderBy("ts")
    across = Window.partitionBy("list", "pattern").orderBy("day")
    days = states.groupBy("list", "pattern", "day").agg(F.min("ts").alias("first"))
    days = days.select("list", "pattern", "day", F.lead("first").over(across).alias("later"))
    met = states.withColumn("next", F.lead("ts").over(inside)).join(days, ["list", "pattern", "day"])
    return met.where("on").select("list", "pattern", F.col("ts").alias("since"), F.coalesce("next", "later").alias("until"))


def _seconds(ts: Column) -> Column:
    # Whole numbers: a double has no room for the microseconds of distant times.
    micros = F.unix_micros(ts.cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / F.lit(1_000_000)).cast("bigint") + F.lit(BEFORE)


def _cells(first: Column, end: Column) -> Column:
    """Array of ``level, cell`` that cover the seconds ``first .. end - 1``, each once, with the largest cells."""

    def at_level(level: int):
        return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))

    parts = []
    for level in range(LEVELS):
        size, above = BASE**level, BASE ** (level + 1)
        a, b = F.ceil(first / F.lit(size)), F.floor(end / F.lit(size))
        up_a, up_b = F.ceil(first / F.lit(above)) * BASE, F.floor(end / F.lit(above)) * BASE
        whole = (up_a < up_b) if level < LEVELS - 1 else F.lit(False)
        left_end = F.when(whole, up_a).otherwise(b)
        right_start = F.when(whole, up_b).otherwise(b)
        for lo, hi in ((a, left_end), (right_start, b)):
            cells = F.when(lo < hi, F.sequence(lo.cast("bigint"), hi.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.transform(cells, at_level(level)))
    return F.concat(*parts)


def evaluate(
    captures: DataFrame,
    entries: DataFrame,
    allow: Collection[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched",
) -> DataFrame:
    """``page_id, url, fetched, lists, n_entries, blocked`` for every capture.

    ``lists``: names of the lists with an active entry, sorted and comma-joined; ``n_entries``: active (list, pattern)
    pairs. A capture is blocked by any list that is not in ``allow``, unless one of those has an entry too. A null or
    odd url and a null time meet nothing. Captures that repeat are looked up once and give their rows again. Times
    are exact to the microsecond; an entry without an end holds for all times after it. Very long urls are read whole. Other
    columns are ignored.
    """
    seen = plain(captures, page_id=id_col, url=url_col, fetched=time_col)
    seen = seen.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n"))
    # The number stands for the capture while it is spread; it is fixed by writing it.
    seen = saved(seen.withColumn("no", F.monotonically_increasing_id()), "captures").df
    active = validity(plain(entries, list="list", pattern="pattern", ts="ts", seq="seq", action="action"))
    # To the end of the last second that the interval touches; the exact times are compared after the join.
    end = F.when(F.col("until").isNull(), F.lit(FOREVER)).otherwise(_seconds(F.col("until")) + 1)
    timed = active.withColumns({"first": _seconds(F.col("since")), "end": end})
    spans = timed.select("list", "pattern", "since", "until", F.explode(_cells(F.col("first"), F.col("end"))).alias("c"))
    spans = saved(spans.select("list", "pattern", "since", "until", "c.level", "c.cell"), "spans").df
    at = _seconds(F.col("fetched"))
    # Only cell sizes that entries use; there are ``LEVELS`` at most.
    used = sorted(r.level for r in spans.select("level").distinct().collect())
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(at / F.lit(BASE**k)).alias("cell")) for k in used])
    levels = levels if used else F.array().cast("array<struct<level:int,cell:bigint>>")
    named = seen.where("fetched is not null").select("no", "fetched", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    placed = named.select("*", F.explode(levels).alias("c")).select("no", "fetched", "pattern", "c.level", "c.cell")
    met = placed.join(spans, ["pattern", "level", "cell"]).where("since <= fetched and (until is null or fetched < until)")
    hits = met.groupBy("no").agg(F.array_sort(F.collect_set("list")).alias("names"), F.count("list").alias("n_entries"))
    known = seen.join(hits.withColumnRenamed("no", "h"), F.col("no") == F.col("h"), "left").drop("h")
    none = F.array().cast("array<string>")
    known = known.withColumns({"names": F.coalesce("names", none), "n_entries": F.coalesce("n_entries", F.lit(0).cast("bigint"))})
    allowed = F.arrays_overlap("names", F.array(*[F.lit(a) for a in allow]).cast("array<string>"))
    out = known.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(
        "page_id", "url", "fetched", F.array_join("names", ",").alias("lists"), "n_entries", ((F.size("names") > 0) & ~allowed).alias("blocked")
    )


# The lists of the query: every row of the event log is a dated entry for the host, the domain or the path of a page. Pages are
# numbered by their id, and the event's id names the number.
CAPTURES = """SELECT page_id, url,
  TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 7919 % 2592000) AS fetched FROM {pages}"""
ENTRIES = """SELECT event_type AS list, ts, event_id AS seq, CASE WHEN floor(value) % 3 < 2 THEN 'add' ELSE 'remove' END AS action,
  CASE user_id % 3 WHEN 0 THEN 'host:' || host WHEN 1 THEN 'domain:' || array_join(slice(split(host, '[.]'), -2, 2), '.')
    ELSE 'path:' || host || '/' || split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/')[1] END AS pattern
  FROM (SELECT e.*, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1)) AS host FROM {events} e JOIN {pages} p ON p.no = e.event_id % {n})"""
ALLOW = ("purchase",)


def entries_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """One entry per event, as in ``ENTRIES``."""
    lined = numbered(pages.select("page_id", "url"), [F.col("page_id"), F.col("url")], "no").df
    return events.sparkSession.sql(ENTRIES, events=events, pages=lined, n=max(1, lined.count()))


ORACLE = """
WITH hosts AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts,
  string_split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/')[2] AS first FROM pages),
captures AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 7919 % 2592000) AS fetched FROM hosts),
entries AS (SELECT event_type AS list, ts, event_id AS seq, floor(value)::BIGINT % 3 < 2 AS added,
  CASE user_id % 3 WHEN 0 THEN 'host:' || host WHEN 1 THEN 'domain:' || string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1]
    ELSE 'path:' || host || '/' || first END AS pattern
  FROM events JOIN (SELECT *, row_number() OVER (ORDER BY page_id, url) - 1 AS no FROM hosts) h
    ON h.no = event_id % (SELECT count(*) FROM pages)),
named AS (
  SELECT page_id, fetched, 'host:' || host AS pattern FROM captures UNION
  SELECT page_id, fetched, 'domain:' || array_to_string(string_split(host, '.')[i:], '.') FROM (
    SELECT *, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i FROM captures) UNION
  SELECT page_id, fetched, 'path:' || host || '/' || array_to_string(parts[:i], '/') FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM captures)),
state AS (
  SELECT page_id, list, n.pattern, arg_max(added, struct_pack(t := ts, s := seq)) AS added FROM named n JOIN entries e
  ON n.pattern = e.pattern AND e.ts <= n.fetched GROUP BY ALL),
hit AS (SELECT page_id, count(*) AS n, list_sort(list(DISTINCT list)) AS names FROM state WHERE added GROUP BY ALL)
SELECT c.page_id, url, fetched, coalesce(array_to_string(names, ','), '') AS lists, coalesce(n, 0) AS n_entries,
  coalesce(len(names) > 0 AND NOT list_contains(names, 'purchase'), false) AS blocked
FROM captures c LEFT JOIN hit USING (page_id)"""
