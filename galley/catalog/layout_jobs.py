"""Layout jobs over words and characters set in type from documents, and field templates over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as Y
from ..operators import lines as L
from ..operators import matching as M
from ..plans.segments import dealt
from .registry import View, query, read, table

C = F.col

# Words of a document flow over pages of 45 rows: twelve words a row for even documents, four for odd ones.
FLOW = [
    "doc_id", "ord", "text", "cast(floor(row_no / 45) AS int) + 1 AS page",
    "60.0 + 14.0 * (row_no % 45) + CASE WHEN row_no % 45 >= 6 THEN 30.0 ELSE 0.0 END + (ord * 7 % 5) * 0.25 AS top",
    "60.0 + 14.0 * (row_no % 45) + CASE WHEN row_no % 45 >= 6 THEN 30.0 ELSE 0.0 END + (ord * 7 % 5) * 0.25 + 10.0 AS bottom",
    "CASE WHEN doc_id % 2 = 0 THEN 50.0 + 42.0 * (ord % 12) ELSE 100.0 + 100.0 * (ord % 4) END AS x0",
    "CASE WHEN doc_id % 2 = 0 THEN 50.0 + 42.0 * (ord % 12) ELSE 100.0 + 100.0 * (ord % 4) END + least(40.0, 4.0 * length(text)) AS x1",
    "595.0 AS page_width", "842.0 AS page_height",
]
FLOW_DBL = [f"cast({c.rsplit(' AS ', 1)[0]} AS double) AS {c.rsplit(' AS ', 1)[1]}" if c.rsplit(" AS ", 1)[-1] in ("top", "bottom", "x0", "x1", "page_width", "page_height") else c for c in FLOW]
_ROW = "cast(floor(ord / CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 4 END) AS int) AS row_no"


class WordView:
    def df(self, spark, sf):
        docs = dealt(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").selectExpr("doc_id", "split(text, '[ \\n]+') AS ws")
        return docs.selectExpr("doc_id", "posexplode(ws) AS (ord, text)").where("text <> ''").selectExpr("*", _ROW).selectExpr(*FLOW_DBL)

    sql = (f"(SELECT {', '.join(FLOW_DBL)} FROM (SELECT *, {_ROW} FROM (SELECT doc_id, unnest(range(len(ws)))::INTEGER AS ord, unnest(ws) AS text FROM "
           f"(SELECT doc_id, string_split_regex(text, '[ \\n]+') AS ws FROM documents) w0) w1 WHERE text <> '') w2)")


WORDS = WordView()
WS = f"{WORDS.sql} w"


@query("detect_columns", f"""SELECT doc_id, page, CASE WHEN mid > n * 0.15 THEN 1 WHEN l >= need AND r >= need THEN 2 ELSE 1 END AS columns FROM (
  SELECT doc_id, page, count(*) AS n, count(*) FILTER (x0 > 297.5 * 0.9 AND x0 < 297.5 * 1.1) AS mid, count(*) FILTER (x1 <= 297.5 * 0.9) AS l, count(*) FILTER (x0 >= 297.5 * 1.1) AS r,
   CASE WHEN count(*) < 20 THEN greatest(3, count(*) // 4) ELSE 10 END AS need FROM {WS} GROUP BY doc_id, page) v""")
def detect_columns(spark, sf):
    return Y.detect_columns(WORDS.df(spark, sf))


@query("detect_columns_simple", f"""SELECT doc_id, page, CASE WHEN count(*) FILTER (x1 <= 297.5 * 0.9) >= 10 AND count(*) FILTER (x0 >= 297.5 * 1.1) >= 10 THEN 2 ELSE 1 END AS columns FROM {WS} GROUP BY doc_id, page""")
def detect_columns_simple(spark, sf):
    return Y.detect_columns(WORDS.df(spark, sf), simple=True)


# In this layout a row of type spans at most one point and rows are 14 apart, so the anchor of a line is its least top.
def _lines_sql(source: str, keys: str = "doc_id, page", tol: float = 2.0) -> str:
    run = f"SELECT *, sum(CASE WHEN pv IS NULL OR top - pv > {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY top, x0, ord) AS run FROM (SELECT *, lag(top) OVER (PARTITION BY {keys} ORDER BY top, x0, ord) AS pv FROM {source}) q0"
    fix = "regexp_replace(regexp_replace(regexp_replace(t, '([,;:!?])([A-Za-zА-Яа-яЁё])', '\\1 \\2', 'g'), '([a-zа-яё]{2,})([A-ZА-ЯЁ][a-zа-яё])', '\\1 \\2', 'g'), '([»\"'')\\]])\\s*([0-9]{1,2})(\\s|$)', '\\1[\\2]\\3', 'g')"
    return f"SELECT {keys}, line_top, x0, x1, bottom, trim(regexp_replace({fix}, '\\s+', ' ', 'g')) AS text FROM (SELECT {keys}, min(top) AS line_top, min(x0) AS x0, max(x1) AS x1, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY x0, top, ord) AS t FROM ({run}) q1 GROUP BY {keys}, run) q2"


@query("lines_from_words", _lines_sql(WS))
def lines_from_words(spark, sf):
    return Y.lines_from_words(WORDS.df(spark, sf), bounded=True)


_BOUND = f"""bnd AS (SELECT doc_id, page, CASE WHEN count(*) < 2 THEN 842.0::DOUBLE * 0.2 ELSE least(842.0::DOUBLE * 0.45, coalesce(arg_min(pv, rank) FILTER (ok), 842.0::DOUBLE * 0.2)) END AS boundary FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, gap DESC, t) AS rank FROM (
   SELECT *, t - pv AS gap, coalesce(t <= 421.0 AND t - pv >= 8.42, false) AS ok FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, page ORDER BY t) AS pv FROM (SELECT DISTINCT doc_id, page, round_even(top, 1) AS t FROM {WS}) b0) b1) b2) b3 GROUP BY doc_id, page)"""


@query("header_boundary", f"WITH {_BOUND} SELECT doc_id, page, round(boundary, 6) AS boundary FROM bnd")
def header_boundary(spark, sf):
    return Y.header_boundary(WORDS.df(spark, sf), bounded=True).select("doc_id", "page", F.round("boundary", 6).alias("boundary"))


_ZONED = f"""z0 AS (SELECT w.*, boundary FROM {WS} JOIN bnd USING (doc_id, page)),
  col AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (x0 > 297.5 * 0.9 AND x0 < 297.5 * 1.1) > count(*) * 0.15 THEN 1 WHEN count(*) FILTER (x1 <= 297.5 * 0.9) >= CASE WHEN count(*) < 20 THEN greatest(3, count(*) // 4) ELSE 10 END
    AND count(*) FILTER (x0 >= 297.5 * 1.1) >= CASE WHEN count(*) < 20 THEN greatest(3, count(*) // 4) ELSE 10 END THEN 2 ELSE 1 END AS columns FROM z0 WHERE top > least(842.0, boundary + 2.0) GROUP BY doc_id, page),
  zz AS (SELECT z0.*, CASE WHEN coalesce(columns, 1) = 1 OR top <= boundary THEN 0 WHEN x0 < 297.5 THEN 1 ELSE 2 END AS zone FROM z0 LEFT JOIN col USING (doc_id, page))"""


@query("reading_order_lines", f"WITH {_BOUND}, {_ZONED} {_lines_sql('zz', 'doc_id, page, zone')}")
def reading_order_lines(spark, sf):
    return Y.reading_order_lines(WORDS.df(spark, sf), bounded=True)


@query("bbox_lines", f"""SELECT doc_id, page, y, string_agg(text, ' ' ORDER BY x0, ord) AS text, min(x0) AS x0, arg_min(top, x0 * 100000 + ord) AS top, max(x1) AS x1, arg_min(bottom, x0 * 100000 + ord) AS bottom
  FROM (SELECT *, round_even(top, 1) AS y FROM {WS}) v GROUP BY doc_id, page, y""")
def bbox_lines(spark, sf):
    return Y.bbox_lines(WORDS.df(spark, sf))


# Characters: every letter of the words, four points apart, a third of the time with a wider gap.
class CharView:
    cols = ["doc_id", "page", "cast(ord AS bigint) * 1000 + pos AS ord", "top", "bottom", "x0 + pos * 4.0 + (pos * 3 % 7) * 0.125 AS x0", "x0 + pos * 4.0 + 3.0 AS x1"]

    def df(self, spark, sf):
        w = WORDS.df(spark, sf).selectExpr("doc_id", "page", "ord", "top", "bottom", "x0", "explode(sequence(0, length(text) - 1)) AS pos")
        return w.selectExpr(*[c.replace("4.0", "4.0D").replace("0.125", "0.125D").replace("3.0", "3.0D") for c in self.cols])

    sql = f"(SELECT {', '.join(cols)} FROM (SELECT *, unnest(range(length(text)))::INTEGER AS pos FROM {WS}) c0)"


CHARS = CharView()


@query("char_gap_stats", f"""WITH a AS (SELECT *, lag(top) OVER o AS pt, lag(x1) OVER o AS px FROM (SELECT doc_id, page, ord, top::DOUBLE AS top, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM {CHARS.sql} c) c WINDOW o AS (PARTITION BY doc_id, page ORDER BY top, x0, ord)),
  g AS (SELECT doc_id, page, x0 - px AS gap FROM a WHERE abs(top - pt) < 5 AND x0 - px > 0 AND x0 - px < 50),
  s AS (SELECT doc_id, page, list_sort(list(gap)) AS gs FROM g GROUP BY doc_id, page),
  m AS (SELECT *, len(gs) AS gaps, gs[len(gs) // 2 + 1] AS median, gs[cast(floor(len(gs) * 0.75) AS INTEGER) + 1] AS p75, gs[cast(floor(len(gs) * 0.9) AS INTEGER) + 1] AS p90 FROM s),
  b AS (SELECT *, list_filter(gs, lambda q: q > median * 2.5) AS big, list_filter(gs, lambda q: q <= median * 2.5) AS few FROM m)
  SELECT doc_id, page, gaps, round(median, 6) AS median, round(p75, 6) AS p75, round(p90, 6) AS p90,
   round(CASE WHEN len(big) >= 3 THEN greatest(0.5, least((list_max(few) + list_min(big)) / 2 * 0.8, list_min(big) * 0.5)) ELSE greatest(1.0, least(10.0, median * 1.5)) END, 6) AS x_tolerance,
   round(coalesce(CASE WHEN len(big) >= 3 THEN (list_max(few) + list_min(big)) / 2 END, -1.0), 6) AS space_threshold FROM b""")
def char_gap_stats(spark, sf):
    out = Y.char_gap_stats(CHARS.df(spark, sf), bounded=True).withColumn("space_threshold", F.coalesce("space_threshold", F.lit(-1.0)))
    return out.select("doc_id", "page", "gaps", *[F.round(c, 6).alias(c) for c in ("median", "p75", "p90", "x_tolerance", "space_threshold")])


@query("order_words", f"SELECT doc_id, page, ord FROM {WS}")
def order_words(spark, sf):
    return Y.order_words(WORDS.df(spark, sf)).select("doc_id", "page", "ord")


# Boxes: two selections a page.
BOX_COLS = ["doc_id", "page", "k AS box_id", "cast(80.0 + 90.0 * k + doc_id % 7 AS double) AS x1", "cast(100.0 + 130.0 * k + page % 5 AS double) AS y1", "cast(300.0 + 90.0 * k AS double) AS x2", "cast(190.0 + 150.0 * k AS double) AS y2"]


def boxes_df(spark, sf):
    return WORDS.df(spark, sf).select("doc_id", "page").distinct().selectExpr("doc_id", "page", "explode(array(0, 1)) AS k").selectExpr(*BOX_COLS)


BOXES = f"(SELECT {', '.join(BOX_COLS)} FROM (SELECT doc_id, page, unnest([0, 1]) AS k FROM (SELECT DISTINCT doc_id, page FROM {WS}) x0) x1)"
_INSIDE = f"(SELECT w.*, b.box_id FROM {WS} JOIN {BOXES} b ON b.doc_id = w.doc_id AND b.page = w.page AND w.x0 < b.x2 AND w.x1 > b.x1 AND w.top < b.y2 AND w.bottom > b.y1)"


@query("words_in_boxes", f"SELECT doc_id, page, box_id, ord, text FROM {_INSIDE} i")
def words_in_boxes(spark, sf):
    return Y.words_in_boxes(WORDS.df(spark, sf), boxes_df(spark, sf)).select("doc_id", "page", "box_id", "ord", "text")


@query("text_in_boxes", f"SELECT doc_id, page, box_id, string_agg(text, chr(10) ORDER BY line_top) AS text FROM ({_lines_sql(_INSIDE + ' i', 'doc_id, page, box_id', 5.0)}) z GROUP BY doc_id, page, box_id")
def text_in_boxes(spark, sf):
    return Y.text_in_boxes(WORDS.df(spark, sf), boxes_df(spark, sf), bounded=True)


@query("snap_to_line", f"""WITH ln AS ({_lines_sql(WS)}), p AS (SELECT b.doc_id, b.page, b.box_id, ln.x0, ln.line_top, ln.x1 AS lx1, ln.bottom,
   row_number() OVER (PARTITION BY b.doc_id, b.page, b.box_id ORDER BY -greatest(0.0, least(ln.bottom, b.y2) - greatest(line_top, b.y1)), abs((line_top + ln.bottom) / 2 - (b.y1 + b.y2) / 2), line_top) AS rn
   FROM {BOXES} b JOIN ln ON ln.doc_id = b.doc_id AND ln.page = b.page AND abs((line_top + ln.bottom) / 2 - (b.y1 + b.y2) / 2) <= 15)
  SELECT doc_id, page, box_id, x0 AS x1, line_top AS y1, lx1 AS x2, bottom AS y2 FROM p WHERE rn = 1""")
def snap_to_line(spark, sf):
    return Y.snap_to_line(boxes_df(spark, sf), Y.lines_from_words(WORDS.df(spark, sf), bounded=True))


@query("find_terms", f"""WITH t AS (SELECT w.*, term FROM {WS} JOIN (SELECT unnest(['Abstract', 'the', 'ung', 'eaux']) AS term) q ON contains(lower(w.text), lower(term))),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, term ORDER BY ord) AS rn FROM t)
  SELECT doc_id, page, term, ord, text, greatest(0.0, x0 - 60) AS ex0, least(842.0, bottom + 5) AS ebottom FROM r WHERE rn = 1""")
def find_terms(spark, sf):
    f = M.find_terms(WORDS.df(spark, sf), ["Abstract", "the", "ung", "eaux"], (60, 0, 0, 5))
    return f.select("doc_id", "page", "term", "ord", "text", "ex0", "ebottom")


@query("filter_words_by_script", f"""WITH a AS (SELECT doc_id, page, ord, CASE WHEN ord % 5 = 0 AND doc_id % 3 <> 1 THEN 'слово' WHEN ord % 7 = 0 THEN '12' WHEN doc_id % 3 = 1 THEN 'три' ELSE text END AS t FROM {WS}),
  b AS (SELECT *, length(regexp_replace(t, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) AS cy, length(regexp_replace(regexp_replace(t, '[^\\p{{L}}]', '', 'g'), '[\\x{{0400}}-\\x{{04FF}}]', '', 'g')) AS la FROM a),
  c AS (SELECT *, (cy > 0 OR NOT regexp_matches(t, '\\p{{L}}')) AS keep, sum(cy) OVER p AS sc, sum(la) OVER p AS sl FROM b WINDOW p AS (PARTITION BY doc_id, page)),
  d AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY doc_id, page) AS k FROM c)
  SELECT doc_id, page, ord, t AS text FROM d WHERE sc > sl OR k = 0 OR keep""")
def filter_words_by_script(spark, sf):
    w = WORDS.df(spark, sf).selectExpr("doc_id", "page", "ord", "CASE WHEN ord % 5 = 0 AND doc_id % 3 <> 1 THEN 'слово' WHEN ord % 7 = 0 THEN '12' WHEN doc_id % 3 = 1 THEN 'три' ELSE text END AS text")
    return L.filter_words_by_script(w, "ru", bounded=True)


FIELDS = View("lineitem", ["l_orderkey AS doc_id", "l_returnflag AS field_id", "l_linenumber AS page", "l_partkey * 1000000 + l_suppkey * 1000 + cast(l_quantity AS bigint) AS seq",
                           "CASE WHEN l_suppkey % 4 = 0 THEN '(Текст не найден)' WHEN l_suppkey % 4 = 1 THEN '' ELSE ' f' || l_partkey END AS text"])


@query("merge_fields", f"SELECT doc_id, field_id, trim(string_agg(text, chr(10) ORDER BY page, seq, text)) AS text FROM {FIELDS.sql} v WHERE text <> '' AND text <> '(Текст не найден)' GROUP BY doc_id, field_id")
def merge_fields(spark, sf):
    return Y.merge_fields(FIELDS.df(spark, sf))


SPAN_COLS = ["doc_id", "page", "line_top", "bottom", "842.0D AS page_height", "CASE WHEN cast(line_top AS int) % 9 = 3 AND doc_id % 4 <> 3 THEN 'ABSTRACT.' WHEN cast(line_top AS int) % 31 = 8 AND doc_id % 2 = 0 THEN 'Key words: x' WHEN line_top > 720 THEN cast(page AS string) ELSE text END AS text"]


@query("annotation_span", f"""WITH ln AS (SELECT {', '.join(c.replace('842.0D', '842.0::DOUBLE') for c in SPAN_COLS)} FROM ({_lines_sql(WS)}) q),
  t AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM ln),
  h AS (SELECT doc_id, page, min(line_top) AS at, arg_min(bottom, line_top) + 2 AS st FROM t WHERE regexp_matches(' ' || s || ' ', '[^\\p{{L}}\\p{{N}}_]abstract[^\\p{{L}}\\p{{N}}_]') GROUP BY doc_id, page),
  e AS (SELECT h.doc_id, h.page, st, min(CASE WHEN regexp_matches(' ' || s || ' ', '[^\\p{{L}}\\p{{N}}_](keywords?|key\\s*words?|index\\s*terms?)[^\\p{{L}}\\p{{N}}_]') THEN line_top END) AS kw,
    max(CASE WHEN line_top >= 842 * 0.85 AND (regexp_matches(s, '^[0-9]{{1,4}}$') OR contains(' ' || s || ' ', ' page ')) THEN line_top END) AS ft
    FROM h LEFT JOIN t ON t.doc_id = h.doc_id AND t.page = h.page AND t.line_top > h.at GROUP BY h.doc_id, h.page, st),
  f AS (SELECT doc_id, page, st AS start_top, coalesce(CASE WHEN kw - 1 - st >= 842 * 0.12 THEN kw - 1 END, ft - 1, least(842.0, st + 842 * 0.6)) AS end_bottom FROM e)
  SELECT doc_id, page, round(start_top, 6) AS start_top, round(end_bottom, 6) AS end_bottom FROM f WHERE end_bottom > start_top""")
def annotation_span(spark, sf):
    lines = Y.lines_from_words(WORDS.df(spark, sf), bounded=True).selectExpr(*SPAN_COLS)
    out = Y.annotation_span(lines)
    return out.select("doc_id", "page", F.round("start_top", 6).alias("start_top"), F.round("end_bottom", 6).alias("end_bottom"))


# --- field templates --------------------------------------------------------------------------------------------
SAMPLES = View("lineitem", ["'j' || l_suppkey AS issn", "l_returnflag AS field_id", "l_orderkey * 100000 + l_partkey * 8 + l_linenumber AS seq", "cast(l_linenumber % 3 AS int) AS page",
                            "50.0 + l_partkey % 9 AS x1", "100.0 + l_partkey % 11 AS y1", "300.0 + l_orderkey % 13 AS x2", "200.0 + l_orderkey % 7 AS y2", "595.0 AS page_width", "842.0 AS page_height"])
SAMPLES = View("lineitem", [f"cast({c.rsplit(' AS ', 1)[0]} AS double) AS {c.rsplit(' AS ', 1)[1]}" if c[0].isdigit() else c for c in SAMPLES.columns])
_NS = f"(SELECT issn, field_id, seq, page, x1 / page_width AS x1, y1 / page_height AS y1, x2 / page_width AS x2, y2 / page_height AS y2 FROM {SAMPLES.sql} s)"
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issn, field_id ORDER BY seq DESC) AS rn FROM {_NS} n) m WHERE rn <= 20)"


def last(spark, sf):
    s = Y.normalize_samples(SAMPLES.df(spark, sf).dropDuplicates(["issn", "field_id", "seq"]))
    return Y.latest_samples(s.drop("page_width", "page_height"))


_NS = _NS.replace(f"FROM {SAMPLES.sql} s", f"FROM (SELECT DISTINCT ON (issn, field_id, seq) * FROM {SAMPLES.sql} s0) s")
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issn, field_id ORDER BY seq DESC) AS rn FROM {_NS} n) m WHERE rn <= 20)"


@query("latest_samples", f"SELECT issn, field_id, seq, page FROM {_LAST} l")
def latest_samples(spark, sf):
    return last(spark, sf).select("issn", "field_id", "seq", "page")


_AVG = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issn, field_id ORDER BY n DESC, f) AS k FROM (SELECT issn, field_id, page, count(*) AS n, min(seq) AS f, avg(x1) AS x1, avg(y1) AS y1, avg(x2) AS x2, avg(y2) AS y2
  FROM {_LAST} l GROUP BY issn, field_id, page) a0) a1 WHERE k = 1)"""
_CONF = f"""(SELECT issn, field_id, count(*) AS samples, CASE WHEN count(*) < 2 THEN 0.0 ELSE least(count(*)::DOUBLE / 5, 1.0) * greatest(0.0, 1.0 - (stddev_samp(x1) + stddev_samp(y1) + stddev_samp(x2) + stddev_samp(y2)) / 4 * 10) END AS confidence
  FROM {_LAST} l GROUP BY issn, field_id)"""


@query("average_bbox", f"SELECT issn, field_id, page, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM {_AVG} a")
def average_bbox(spark, sf):
    return Y.average_bbox(last(spark, sf)).select("issn", "field_id", "page", *[F.round(c, 6).alias(c) for c in Y.CORNERS])


@query("bbox_confidence", f"SELECT issn, field_id, samples, round(confidence, 6) AS confidence FROM {_CONF} c")
def bbox_confidence(spark, sf):
    return Y.bbox_confidence(last(spark, sf)).select("issn", "field_id", "samples", F.round("confidence", 6).alias("confidence"))


@query("bbox_suggestions", f"SELECT issn, field_id, page, round(x1 * 612, 5) AS x1, round(y1 * 792, 5) AS y1, round_even(confidence, 2) AS confidence, samples FROM {_AVG} a JOIN {_CONF} c USING (issn, field_id) WHERE confidence >= 0.3")
def bbox_suggestions(spark, sf):
    s = Y.bbox_suggestions(last(spark, sf), 612.0, 792.0)
    return s.select("issn", "field_id", "page", F.round("x1", 5).alias("x1"), F.round("y1", 5).alias("y1"), "confidence", "samples")


@query("template_summary", """SELECT *, row_number() OVER (ORDER BY processed DESC, issn) AS pos FROM (
  SELECT 'j' || l_suppkey AS issn, count(*) FILTER (l_linestatus = 'F') AS processed, count(DISTINCT l_returnflag) AS fields FROM lineitem GROUP BY l_suppkey) v""")
def template_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    done = li.where("l_linestatus = 'F'").selectExpr("'j' || l_suppkey AS issn")
    return Y.template_summary(li.selectExpr("'j' || l_suppkey AS issn", "l_returnflag AS field_id"), done)
