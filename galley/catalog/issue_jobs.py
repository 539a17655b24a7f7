"""Issue warehouse and matching jobs over an issue view derived from orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..operators import matching as M
from ..operators import warehouse as H
from ..plans.members import written
from ..plans.segments import running, spread
from .registry import LineView, View, query, read, table
from .scalars import NS, PAGES_MAX, PAGES_MIN, S

C = F.col


def issn(k: str) -> str:
    return f"substring(cast(10000000 + {k} * 37 AS string), 1, 4) || '-' || substring(cast(10000000 + {k} * 37 AS string), 5, 4)"


ISSUE = f"{issn('(o_custkey % 150)')} || '_' || year(o_orderdate) || CASE WHEN o_custkey % 2 = 1 THEN '_' || (1 + o_custkey % 9) ELSE '' END || '_' || month(o_orderdate)"
PAGES = """CASE o_orderkey % 9 WHEN 0 THEN o_custkey || '-' || (o_custkey + o_orderkey % 20) WHEN 1 THEN o_custkey || '–' || (o_custkey + 5) WHEN 2 THEN o_custkey || ' — ' || (o_custkey + 7)
  WHEN 3 THEN ' ' || o_custkey WHEN 4 THEN (o_custkey + 9) || '-' || o_custkey WHEN 5 THEN o_custkey || '-' || (o_custkey + 3) || ', ' || (o_custkey + 7) WHEN 6 THEN o_custkey || '-' WHEN 7 THEN '-' || o_custkey ELSE '' END"""
ARTICLES = View("orders", ["o_orderkey", f"{ISSUE} AS issue", "CASE WHEN o_orderkey % 2 = 0 THEN 'art' ELSE 'ART' END || o_orderkey || '.json' AS name", "'Art' || o_orderkey AS stem",
                           f"{PAGES} AS pages", "o_orderstatus = 'F' AS processed", "o_orderdate AS modified"])
JOURNALS = View("supplier", ["cast(s_suppkey AS int) AS ord", f"CASE WHEN s_suppkey % 10 = 9 THEN {issn('(s_suppkey - 1)')} ELSE {issn('s_suppkey')} END AS ISSN",
                             f"CASE WHEN s_suppkey % 4 = 0 THEN {issn('(s_suppkey + 40)')} ELSE '' END AS ISSN_Print", "'' AS ISSN_Online", "s_name AS Title",
                             "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'J ' || s_suppkey END AS TitleEn", "CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'https://j' || s_suppkey || '.example.org' END AS Url",
                             "CASE WHEN s_suppkey % 3 = 0 THEN 'N' ELSE 'y ' END AS RAS"])
STEM = "CASE WHEN o_orderkey % 50 = 0 THEN 'full_issue' WHEN o_orderkey % 50 = 1 THEN 'issue' ELSE 'Art' || (o_orderkey - o_orderkey % 3) END"
EXT = "CASE (o_orderkey + o_custkey) % 7 WHEN 0 THEN '.docx' WHEN 1 THEN '.idml' WHEN 2 THEN '.rtf' WHEN 3 THEN '.tex' WHEN 4 THEN '.html' ELSE '.pdf' END"
FILES = View("orders", [f"{ISSUE} AS issue", f"{STEM} AS stem", f"{EXT} AS ext", f"'raw/' || {STEM} || '_' || o_orderkey || {EXT} AS path"])

A, J, FL = f"{ARTICLES.sql} a", f"{JOURNALS.sql} j", f"{FILES.sql} f"


@query("archive_issues", f"SELECT o_orderkey, issue, CASE WHEN issue IN (SELECT issue FROM {A} WHERE o_orderkey % 97 = 0) THEN 'run1' ELSE '' END AS run_id FROM {A}")
def archive_issues(spark, sf):
    a = ARTICLES.df(spark, sf)
    moved, rest = H.archive_issues(a.select("o_orderkey", "issue"), a.where("o_orderkey % 97 = 0").select("issue"), "run1")
    return moved.select("o_orderkey", "issue", "run_id").unionByName(rest.select("o_orderkey", "issue", F.lit("").alias("run_id")))


_VICTIM = f"(SELECT min(issue) FROM {A} WHERE o_orderkey % 2 = 0)"


@query("restore_issue", f"""SELECT o_orderkey, issue, 'restored' AS status FROM {A} WHERE issue <> {_VICTIM} OR o_orderkey % 2 = 0""")
def restore_issue(spark, sf):
    """Half of one issue was archived; bringing it back replaces what is there."""
    a = ARTICLES.df(spark, sf).select("o_orderkey", "issue")
    victim = a.where("o_orderkey % 2 = 0").agg(F.min("issue").alias("issue"))
    name = victim.first()["issue"]
    archive = a.join(victim, "issue", "left_semi").where("o_orderkey % 2 = 0").withColumn("run_id", F.lit("r1"))
    out, status = H.restore_issue(archive, a, "r1", name, overwrite=True)
    return out.withColumn("status", F.lit(status.first()["status"]))


RUNS = View("events", ["event_id", "'run' || user_id AS run_id", "event_type AS issue", "ts AS modified"])


@query("expire_runs", f"SELECT event_id, run_id FROM {RUNS.sql} v WHERE modified >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY")
def expire_runs(spark, sf):
    return H.expire_runs(RUNS.df(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 2).select("event_id", "run_id")


@query("list_runs", f"""WITH p AS (SELECT DISTINCT run_id, issue FROM {RUNS.sql} v) SELECT dense_rank() OVER (ORDER BY run_id DESC) AS run_no, run_id,
  row_number() OVER (PARTITION BY run_id ORDER BY issue) AS issue_no, issue FROM p""")
def list_runs(spark, sf):
    return H.list_runs(RUNS.df(spark, sf))


@query("run_issue_lists", f"SELECT run_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues FROM {RUNS.sql} v GROUP BY run_id")
def run_issue_lists(spark, sf):
    return H.run_issue_lists(RUNS.df(spark, sf)).select("run_id", F.array_join("issues", ",").alias("issues"))


@query("list_current", f"SELECT DISTINCT issue FROM {A}")
def list_current(spark, sf):
    return H.list_current(ARTICLES.df(spark, sf))


@query("delete_article", f"""WITH v AS (SELECT issue, stem FROM {A} WHERE o_orderkey % 12 = 0)
  SELECT 'articles' AS tbl, issue, stem FROM {A} WHERE (issue, stem) NOT IN (SELECT issue, stem FROM v)
  UNION ALL SELECT 'files', issue, stem FROM {FL} WHERE (issue, stem) NOT IN (SELECT issue, stem FROM v)""")
def delete_article(spark, sf):
    a, f = ARTICLES.df(spark, sf), FILES.df(spark, sf)
    left = H.delete_article({"articles": a, "files": f}, a.where("o_orderkey % 12 = 0"))
    return H.union_sources(*[df.select(F.lit(n).alias("tbl"), "issue", "stem") for n, df in left.items()])


@query("drop_issue", f"""WITH v AS (SELECT DISTINCT issue FROM {A} WHERE o_orderkey % 501 = 0 UNION SELECT 'unknown')
  SELECT issue, -1::BIGINT AS removed FROM {A} WHERE issue NOT IN (SELECT issue FROM v)
  UNION ALL SELECT v.issue, count(a.issue) FROM v LEFT JOIN {A} USING (issue) GROUP BY v.issue""")
def drop_issue(spark, sf):
    a = ARTICLES.df(spark, sf)
    asked = a.where("o_orderkey % 501 = 0").select("issue").unionByName(a.limit(1).select(F.lit("unknown").alias("issue")))
    rest, report = H.drop_issue(a, asked)
    return rest.select("issue", F.lit(-1).cast("bigint").alias("removed")).unionByName(report)


_MIN, _MAX = (x.replace("(t)", "(pages)").replace("(t,", "(pages,") for x in (PAGES_MIN, PAGES_MAX))


@query("issue_page_range", f"""SELECT issue, coalesce(CASE WHEN min(lo) = max(hi) THEN cast(min(lo) AS varchar) ELSE min(lo) || '-' || max(hi) END, '') AS pages
  FROM (SELECT issue, {_MIN} AS lo, {_MAX} AS hi FROM {A}) v GROUP BY issue""")
def issue_page_range(spark, sf):
    return H.issue_page_range(ARTICLES.df(spark, sf)).select("issue", F.coalesce("pages", F.lit("")).alias("pages"))


@query("issue_progress", f"""SELECT issue, count(*) FILTER (processed) AS processed, count(*) AS total, CASE WHEN count(*) FILTER (processed) = count(*) THEN 'done' ELSE 'markup' END AS status
  FROM {A} GROUP BY issue""")
def issue_progress(spark, sf):
    return H.issue_progress(ARTICLES.df(spark, sf))


@query("event_progress", "SELECT event_type AS issue, count(*) FILTER (value > 10) AS processed, count(*) AS total, CASE WHEN count(*) FILTER (value > 10) = count(*) THEN 'done' ELSE 'markup' END AS status FROM events GROUP BY event_type")
def event_progress(spark, sf):
    """Few very large keys."""
    return H.issue_progress(table(spark, sf, "events").selectExpr("event_type AS issue", "value > 10 AS processed"))


@query("issue_file_counts", f"SELECT issue, count(*) FILTER (ext = '.pdf') AS pdf_files, count(*) FILTER (ext <> '.pdf') AS other_files FROM {FL} GROUP BY issue")
def issue_file_counts(spark, sf):
    return H.issue_file_counts(FILES.df(spark, sf))


JSONS = View("events", ["event_type AS issue", "'e' || event_id AS name", "CASE event_id % 10 WHEN 0 THEN substring(props, 1, 4) WHEN 1 THEN ' ' ELSE props END AS content"])


@query("invalid_records", f"SELECT issue, name, CASE WHEN trim(content) = '' THEN 'empty' ELSE 'malformed' END AS error FROM {JSONS.sql} v WHERE NOT json_valid(content)")
def invalid_records(spark, sf):
    return H.invalid_records(JSONS.df(spark, sf))


@query("order_articles", f"SELECT issue, name, row_number() OVER (PARTITION BY issue ORDER BY {_MIN} ASC NULLS LAST, lower(name), name) AS pos FROM {A}")
def order_articles(spark, sf):
    return H.order_articles(spread(ARTICLES.df(spark, sf))).select("issue", "name", "pos")


EVENT_ARTICLES = View("events", ["event_type AS issue", "'E' || event_id AS name", "CASE WHEN user_id % 7 = 0 THEN 'x' ELSE cast(user_id AS string) || '-' || cast(user_id + 3 AS string) END AS pages"])


@query("order_events", f"""SELECT issue, name, row_number() OVER (PARTITION BY issue ORDER BY CASE WHEN pages = 'x' THEN NULL ELSE cast(split_part(pages, '-', 1) AS INTEGER) END ASC NULLS LAST, lower(name), name) AS pos
  FROM {EVENT_ARTICLES.sql} v""")
def order_events(spark, sf):
    """Few very large issues."""
    return H.order_articles(spread(EVENT_ARTICLES.df(spark, sf))).select("issue", "name", "pos")


@query("order_listing", f"""SELECT issue, name, pages, row_number() OVER (ORDER BY issue, try_cast(nullif(regexp_extract(trim(pages), '^([0-9]+)', 1), '') AS INTEGER) NULLS LAST, name) AS pos FROM {A}""")
def order_listing(spark, sf):
    return H.order_listing(ARTICLES.df(spark, sf)).select("issue", "name", "pages", "pos")


@query("union_sources", f"SELECT issue, stem, 'article' AS kind FROM {A} UNION ALL SELECT issue, stem, 'file' FROM {FL}")
def union_sources(spark, sf):
    return H.union_sources(ARTICLES.df(spark, sf).select("issue", "stem", F.lit("article").alias("kind")), FILES.df(spark, sf).select("issue", "stem", F.lit("file").alias("kind")))


@query("distinct_in_order", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def distinct_in_order(spark, sf):
    return H.distinct_in_order(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# --- journals and files -----------------------------------------------------------------------------------------
_IK = "^([0-9]{4}-[0-9]{3}X|[0-9]{4}-[0-9]{4}X?)_([0-9]{4})_(?:([0-9]+)_)?([0-9]+)$"


@query("issue_config", f"""WITH i AS (SELECT DISTINCT issue FROM {A}), j1 AS (SELECT *, row_number() OVER (PARTITION BY upper(ISSN) ORDER BY ord) AS rn FROM {J})
  SELECT issue, 0 AS titleid, regexp_extract(issue, '{_IK}', 1) AS issn, Title AS title_ru, CASE WHEN TitleEn = '' THEN Title ELSE TitleEn END AS title_en, regexp_extract(issue, '{_IK}', 2) AS year,
  regexp_extract(issue, '{_IK}', 3) AS volume, regexp_extract(issue, '{_IK}', 4) AS number FROM i JOIN j1 ON upper(j1.ISSN) = upper(regexp_extract(issue, '{_IK}', 1)) AND rn = 1""")
def issue_config(spark, sf):
    return M.issue_config(ARTICLES.df(spark, sf).select("issue").distinct(), JOURNALS.df(spark, sf))


_NI = "CASE WHEN length(regexp_replace({0}, '[^0-9Xx]', '', 'g')) = 8 THEN upper(regexp_replace({0}, '[^0-9Xx]', '', 'g')) ELSE '' END"


@query("journal_by_any_issn", f"""WITH l AS (SELECT ord, Title, Url, RAS, unnest([{_NI.format('ISSN')}, {_NI.format('ISSN_Print')}, {_NI.format('ISSN_Online')}]) AS k FROM {J}),
  f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM l WHERE k <> '')
  SELECT o_orderkey, coalesce(Title, '') AS title, coalesce(upper(trim(RAS)) = 'Y' AND trim(Url) <> '', false) AS usable
  FROM (SELECT o_orderkey, split_part(issue, '_', 1) AS issn FROM {A}) a LEFT JOIN f ON f.k = replace(a.issn, '-', '') AND rn = 1""")
def journal_by_any_issn(spark, sf):
    a = ARTICLES.df(spark, sf).select("o_orderkey", F.substring_index("issue", "_", 1).alias("issn"))
    return M.journal_by_any_issn(a, JOURNALS.df(spark, sf)).select("o_orderkey", F.coalesce("Title", F.lit("")).alias("title"), "usable")


def _own(e):
    return f"(SELECT min(path) FROM fl WHERE fl.issue = a.issue AND fl.stem = a.stem AND ext = '{e}')"


def _all(e, stem="full_issue"):
    return f"(SELECT min(path) FROM fl WHERE fl.issue = a.issue AND fl.stem = '{stem}' AND ext = '{e}')"


_ANY = "(SELECT min(path) FROM fl WHERE fl.issue = a.issue AND ext = '.pdf')"
_EARLY = f"coalesce({_own('.idml')}, {_all('.html')}, {_all('.docx')}, {_all('.rtf')}, {_all('.tex')})"
_LATE = f"coalesce({_own('.html')}, {_own('.docx')}, {_own('.rtf')}, {_own('.tex')})"
_PDF = f"coalesce({_own('.pdf')}, {_all('.pdf')})"


@query("match_source_files", f"""WITH fl AS (SELECT * FROM {FL}) SELECT issue, stem, coalesce(e, l, p, y, '') AS file, coalesce(CASE WHEN e IS NOT NULL THEN p ELSE coalesce(p, y) END, '') AS pdf
  FROM (SELECT issue, stem, {_EARLY} AS e, {_LATE} AS l, {_PDF} AS p, {_ANY} AS y FROM {A}) z""")
def match_source_files(spark, sf):
    m = M.match_source_files(ARTICLES.df(spark, sf), FILES.df(spark, sf))
    return m.select("issue", "stem", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("pdf", F.lit("")).alias("pdf"))


@query("match_issue_file", f"""WITH fl AS (SELECT * FROM {FL} WHERE ext IN ('.docx', '.rtf', '.pdf')) SELECT issue, stem,
  coalesce({', '.join(_own(e) for e in M.TEXT_EXTENSIONS)}, {', '.join(_all(e, s) for s in M.COMMON_NAMES for e in M.TEXT_EXTENSIONS)},
   (SELECT CASE WHEN count(*) = 1 THEN min(path) END FROM fl WHERE fl.issue = a.issue), '') AS file FROM {A}""")
def match_issue_file(spark, sf):
    m = M.match_issue_file(ARTICLES.df(spark, sf), FILES.df(spark, sf))
    return m.select("issue", "stem", F.coalesce("file", F.lit("")).alias("file"))


@query("pending_files", f"SELECT issue, stem, path FROM {FL} WHERE ext = '.rtf' AND (issue, stem) NOT IN (SELECT issue, stem FROM {FL} WHERE ext = '.docx')")
def pending_files(spark, sf):
    f = FILES.df(spark, sf)
    return M.pending_files(f.where("ext = '.rtf'"), f.where("ext = '.docx'")).select("issue", "stem", "path")


# --- locating articles: the documents of a source are the articles of one issue ----------------------------------
ISSUE_LINES = LineView()
_LOC_LINES = "(SELECT d.source AS issue, (row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id, l.line_no) - 1)::BIGINT AS line_no, l.text FROM " + ISSUE_LINES.sql + " l JOIN documents d USING (doc_id))"
# The whole first line of a document is its title; every other one has a word that no line has.
_LOC_TITLE = "split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' zzz' END"
_LOC_ARTS = ("(SELECT source AS issue, 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(text, '([A-Za-z]{7,})', 1) ELSE '' END AS surname, "
             f"{_LOC_TITLE} AS title FROM documents)")
_TOCX = f"(length({S('text')}) < 5 OR (regexp_matches({S('text')}, '^\\s*\\S+.*[0-9]+\\s*$') AND len(regexp_extract_all({S('text')}, '[0-9]+')) <= 2))"


@query("locate_article", f"""WITH l AS (SELECT *, lower({NS('text')}) AS n, min(CASE WHEN regexp_matches(lower(text), 'содержание|оглавление|contents') THEN line_no END) OVER (PARTITION BY issue) AS fm FROM {_LOC_LINES} z),
  u AS (SELECT issue, line_no, n, ' ' || regexp_replace(n, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ' AS pad FROM l WHERE line_no >= coalesce(fm + 30, 50) AND NOT {_TOCX}),
  a AS (SELECT issue, name, lower({NS('surname')}) AS sn, lower({NS('title')}) AS t, array_to_string(string_split(lower({NS('title')}), ' ')[1:5], ' ') AS hd FROM {_LOC_ARTS} y),
  h AS (SELECT a.issue, a.name, 0 AS rank, line_no FROM a JOIN u ON a.issue = u.issue WHERE length(sn) >= 2 AND contains(pad, ' ' || sn || ' ')
    UNION ALL SELECT a.issue, a.name, 1, line_no FROM a JOIN u ON a.issue = u.issue WHERE t <> '' AND (t = n OR (length(t) >= 10 AND contains(n, t)))
    UNION ALL SELECT a.issue, a.name, 2, line_no FROM a JOIN u ON a.issue = u.issue WHERE len(string_split(t, ' ')) >= 3 AND contains(n, hd)),
  b AS (SELECT issue, name, min(rank * 1000000 + line_no) AS k FROM h GROUP BY issue, name)
  SELECT a.issue, a.name, coalesce(k % 1000000 + 1, -1) AS start_line FROM a LEFT JOIN b USING (issue, name)""")
def locate_article(spark, sf):
    docs = read(spark, sf, "documents")
    # A table that must be dealt is dealt once for all that reads it.
    dealt = spread(docs)
    docs = docs if dealt is docs else written(dealt, "documents")
    # Lines are numbered in their document, and documents by the lines before them, so no text moves for it.
    sizes = docs.select(C("source").alias("issue"), C("doc_id").alias("part"), F.size(split_lines("text")).alias("size"))
    starts = running(sizes, ["issue"], "part", sums={"end": C("size")}).select("issue", "part", (C("end") - C("size")).alias("start"))
    lines = docs.select(C("source").alias("issue"), C("doc_id").alias("part"), F.posexplode(split_lines("text")).alias("line_no", "text"))
    arts = docs.selectExpr("source AS issue", "'d' || doc_id AS name", "CASE WHEN doc_id % 3 = 0 THEN regexp_extract(text, '([A-Za-z]{7,})', 1) ELSE '' END AS surname",
                           f"{_LOC_TITLE} AS title")
    return M.locate_article(arts, lines, starts=starts).select("issue", "name", F.coalesce("start_line", F.lit(-1)).cast("bigint").alias("start_line"))


# --- requests and candidates ------------------------------------------------------------------------------------
PUBS = View("part", ["'u' || p_partkey AS url", "'10.1000/P' || p_partkey AS doi", "p_name || ' of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey AS title", "p_partkey AS ord"], wide=True)
REQS = View("part", ["p_partkey AS request_id", "CASE p_partkey % 4 WHEN 0 THEN '10.1000/p' || p_partkey WHEN 1 THEN '10.1000/zz' ELSE '' END AS doi",
                     """CASE p_partkey % 5 WHEN 0 THEN p_name || ' of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey
                        WHEN 1 THEN p_name || ' of the ' || p_type || ' in a long study of every single brand unlike the others'
                        WHEN 2 THEN CASE p_partkey % 4 WHEN 0 THEN regexp_extract(p_name || ' of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey, '^(([^ ]+ ){2}[^ ]+) ', 1) WHEN 1 THEN regexp_extract(p_name || ' of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey, '^(([^ ]+ ){5}[^ ]+) ', 1)
                          WHEN 2 THEN regexp_extract(p_name || ' of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey, '^(([^ ]+ ){10}[^ ]+) ', 1) ELSE 'nothing' END WHEN 3 THEN '' ELSE '  ' || p_name || '  of the ' || p_type || ' in a long study of every single brand like ' || p_brand || ' number ' || p_partkey || '!' END AS title"""], wide=True)
_T = f"lower({NS('title')})"
_12 = "array_to_string(string_split(t, ' ')[1:12], ' ')"
_70 = "trim(substr(t, 1, 70))"


@query("match_requests", f"""WITH q AS (SELECT request_id, lower(trim(doi)) AS d, {_T} AS t FROM {REQS.sql} v), p AS (SELECT url, ord, lower(trim(doi)) AS d, {_T} AS t FROM {PUBS.sql} v),
  p1 AS (SELECT *, {_12} AS t12, {_70} AS t70 FROM p), q1 AS (SELECT *, {_12} AS t12, {_70} AS t70 FROM q),
  h AS (SELECT request_id, 1 AS pass_no, p1.ord, url FROM q1 JOIN p1 ON q1.d = p1.d AND q1.t = p1.t AND q1.d <> '' AND q1.t <> ''
   UNION ALL SELECT request_id, 2, p1.ord, url FROM q1 JOIN p1 ON q1.d = p1.d AND q1.d <> ''
   UNION ALL SELECT request_id, 3, p1.ord, url FROM q1 JOIN p1 ON q1.t = p1.t AND q1.t <> ''
   UNION ALL SELECT request_id, 4, p1.ord, url FROM q1 JOIN p1 ON starts_with(p1.t, q1.t || ' ') AND len(string_split(q1.t, ' ')) >= 3
   UNION ALL SELECT request_id, 5, p1.ord, url FROM q1 JOIN p1 ON q1.t12 = p1.t12 AND length(q1.t12) > 20 AND q1.t12 <> q1.t
   UNION ALL SELECT request_id, 6, p1.ord, url FROM q1 JOIN p1 ON q1.t70 = p1.t70 AND length(q1.t70) > 25 AND q1.t70 <> q1.t),
  b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pass_no, ord) AS rn FROM h)
  SELECT q.request_id, coalesce(pass_no, 0) AS pass_no, coalesce(url, '') AS url FROM q LEFT JOIN b ON b.request_id = q.request_id AND rn = 1""")
def match_requests(spark, sf):
    m = M.match_requests(REQS.df(spark, sf), PUBS.df(spark, sf))
    return m.select("request_id", F.coalesce("pass_no", F.lit(0)).alias("pass_no"), F.coalesce("url", F.lit("")).alias("url"))


RU = View("customer", ["'u' || c_custkey AS url", "CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END AS title", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS abstract_en",
                       "CASE WHEN c_custkey % 5 = 0 THEN 'аннотация' ELSE NULL END AS abstract", "CASE WHEN c_custkey % 7 = 0 THEN 'ref' ELSE '' END AS references_en"])
EN = View("customer", ["'u' || c_custkey AS url", "'EN ' || c_name AS title", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'abs ' || c_custkey END AS abstract_en", "'r' || c_custkey AS references_en"], "c_custkey % 6 <> 0")


def _fill(own, other):
    return f"coalesce(CASE WHEN trim(coalesce(r.{own}, '')) <> '' THEN r.{own} ELSE coalesce(nullif(e.{other}, ''), r.{own}) END, '')"


@query("merge_language_pages", f"""SELECT r.url, {_fill('title', 'title')} AS title, {_fill('abstract_en', 'abstract_en')} AS abstract_en, {_fill('abstract', 'abstract_en')} AS abstract, {_fill('references_en', 'references_en')} AS references_en
  FROM {RU.sql} r LEFT JOIN {EN.sql} e ON e.url = r.url""")
def merge_language_pages(spark, sf):
    m = M.merge_language_pages(RU.df(spark, sf), EN.df(spark, sf))
    return m.select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract_en", "abstract", "references_en")])


@query("cached_results", """WITH c AS (SELECT sha256(text) AS hash, min('r' || doc_id) AS result FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
  SELECT doc_id, sha256(text) AS hash, coalesce(result, '') AS result FROM documents d LEFT JOIN c ON c.hash = sha256(d.text)""")
def cached_results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min(F.concat(F.lit("r"), "doc_id")).alias("result"))
    hits, misses = M.cached_results(docs, cache)
    return hits.select("doc_id", "hash", "result").unionByName(misses.select("doc_id", "hash", F.lit("").alias("result")))


CANDS = View("lineitem", ["l_orderkey AS request_id", "cast(l_linenumber % 3 AS int) AS stage", "l_linenumber * 100000 + l_partkey AS ord", "CASE WHEN l_partkey % 4 = 0 THEN 'jats' ELSE 'html' END AS source",
                          "'Title ' || l_orderkey AS req_title", "'10.1/' || l_orderkey AS req_doi", "CASE WHEN l_partkey % 9 = 0 THEN '10.1/' || l_orderkey ELSE '' END AS doi",
                          "CASE l_suppkey % 4 WHEN 0 THEN 'title  ' || l_orderkey WHEN 1 THEN 'The Title ' || l_orderkey || ' x' ELSE '' END AS title", "CASE WHEN l_suppkey % 5 = 0 THEN 'Title ' || l_orderkey ELSE NULL END AS original_title",
                          "CASE WHEN l_returnflag = 'A' THEN 'a' ELSE '' END AS abstract", "'' AS abstract_ru", "NULL AS abstract_en", "CASE WHEN l_linestatus = 'F' THEN 'r' ELSE '' END AS references",
                          "'' AS references_ru", "'' AS references_en", "CASE WHEN l_quantity > 25 THEN '1-2' ELSE '' END AS pages"])
CANDS = View("lineitem", [c.replace("AS references", 'AS refs') if c.endswith("AS references") else c for c in CANDS.columns])
_TT = "lower(regexp_replace(CASE WHEN title <> '' THEN title ELSE coalesce(original_title, '') END, '\\s+', ' ', 'g'))"
_SC = f"""(CASE WHEN lower(doi) = lower(req_doi) THEN 10 ELSE 0 END + CASE WHEN {_TT} = lower(req_title) THEN 8 ELSE 0 END + CASE WHEN contains({_TT}, lower(req_title)) THEN 5 ELSE 0 END
  + CASE WHEN abstract <> '' THEN 2 ELSE 0 END + CASE WHEN refs <> '' THEN 2 ELSE 0 END + CASE WHEN pages <> '' THEN 1 ELSE 0 END + CASE WHEN source = 'jats' THEN 3 ELSE 0 END)"""


def _cands(spark, sf):
    return M.score_candidate(CANDS.df(spark, sf).withColumnRenamed("refs", "references").withColumn("abstract_en", F.lit("")))


@query("score_candidate", f"SELECT request_id, ord, stage, {_SC} AS score FROM {CANDS.sql} v")
def score_candidate(spark, sf):
    return _cands(spark, sf).select("request_id", "ord", "stage", "score")


@query("best_candidate", f"""WITH s AS (SELECT request_id, ord, stage, source, {_SC} AS score FROM {CANDS.sql} v),
  m AS (SELECT *, coalesce((SELECT max(z.score) FROM s z WHERE z.request_id = s.request_id AND z.stage < s.stage), -1) AS before FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, stage, ord) AS rn FROM m WHERE before < 10)
  SELECT request_id, ord, stage, score FROM r WHERE rn = 1""")
def best_candidate(spark, sf):
    return M.best_candidate(_cands(spark, sf).select("request_id", "ord", "stage", "source", "score")).select("request_id", "ord", "stage", "score")


EXTR = View("documents", ["cast(floor(doc_id / 4) AS bigint) AS area_id", "doc_id AS ord", "text", "lang"])
from .scalars import GARBLED_SQL, TEXT_QUALITY_SQL, WORDS_SQL  # noqa: E402


@query("best_extraction", f"""WITH s AS (SELECT area_id, ord, {TEXT_QUALITY_SQL} + CASE WHEN {GARBLED_SQL} THEN 100.0 ELSE 0.0 END AS score FROM (SELECT *, {WORDS_SQL} AS ws FROM {EXTR.sql} e) v),
  r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY score, ord) AS rn FROM s) SELECT area_id, ord FROM r WHERE rn = 1""")
def best_extraction(spark, sf):
    return M.best_extraction(EXTR.df(spark, sf)).select("area_id", "ord")
