"""Line predicates and line-table jobs over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import lines as L
from .registry import LineView, View, query, table
from .scalars import NS, RR, S

C = F.col
LINES = LineView()

# Lines of the documents, a part of them dressed as bibliographic content so that every rule has cases.
DRESSED = """CASE (doc_id * 7 + line_no) % 23
  WHEN 0 THEN 'References'
  WHEN 1 THEN '[' || line_no || '] Smith J. A. ' || text || ' ' || (1950 + line_no % 70) || '. Vol. 3. pp. 1-9'
  WHEN 2 THEN 'https://doi.org/10.1000/' || doc_id || '.' || line_no
  WHEN 3 THEN 'Information about the author'
  WHEN 4 THEN 'Иванов И. И., Петров П. П. ' || text
  WHEN 5 THEN line_no || '. ' || text
  WHEN 6 THEN 'Аннотация'
  WHEN 7 THEN 'Keywords: ' || text
  WHEN 8 THEN 'Received 01.02.2024'
  WHEN 9 THEN 'doi: 10.1000/x' || line_no
  WHEN 10 THEN 'SECTION HEADING NUMBER ' || line_no
  WHEN 11 THEN cast(line_no % 3 AS string)
  WHEN 12 THEN 'Department of Physics, ' || text
  WHEN 13 THEN 'E-mail: a' || doc_id || '@example.org'
  WHEN 14 THEN '© ' || text
  WHEN 15 THEN 'For citation: ' || text
  WHEN 16 THEN 'Original Article'
  WHEN 17 THEN '2.5.4 ' || text
  WHEN 18 THEN text || ' ' || line_no
  WHEN 19 THEN '- ' || text
  WHEN 20 THEN 'Вестник МГТУ 2025 ' || line_no
  ELSE text END"""
RICH = LineView(line_expr=DRESSED)

_NL = f"lower({NS('text')})"
DOI_L, EMAIL, URL = "(?i)DOI:\\s*[0-9]+\\.[0-9]+/[A-Z0-9-]+", "(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", "(?i)https?://[^\\s]+"
_TYPE = "(?i)(Оригинальная\\s+статья|Original\\s+Article|Обзорная\\s+статья|Review\\s+Article|Краткое\\s+сообщение|Short\\s+Message)"
_META = "(?i)(doi|https?://|@|©|[0-9]{4}\\s*г\\.)"


def m(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{p}')"


def predicate(name: str, make, sql: str, view=RICH):
    @query(name, f"SELECT doc_id, line_no, {sql} AS flag FROM {view.sql} v")
    def run(spark, sf):
        return view.df(spark, sf).select("doc_id", "line_no", make("text").alias("flag"))

    return run


_MK = f"regexp_replace({NS('replace(lower(text), chr(1105), chr(1077))')}, '^[ .:;–—-]+|[ .:;–—-]+$', '', 'g')"
TOKENS = f"({m('text', DOI_L)} OR {m('text', EMAIL)} OR {m('text', URL)})"
SERVICE = f"""(length({S('text')}) < 3 OR {' OR '.join(f"contains(lower({S('text')}), '{w}')" for w in P.SERVICE_WORDS)})"""
DATED = m(NS("text"), "(?i)^(Поступила|Поступил|После доработки|Принята к публикации|Received|Revised|Accepted)([^\\p{L}\\p{N}_]|$)")
_SPACED = "regexp_replace(" + NS("text") + ", '([^\\p{L}\\p{N}_-])', '\\1\\1', 'g')"
_SURN = f"len(regexp_extract_all({_SPACED}, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-ZА-ЯЁ][a-zа-яё-]{{2,}}(?:[^\\p{{L}}\\p{{N}}_]|$)'))"
_INIT = "len(regexp_extract_all(text, '[A-ZА-ЯЁ]\\.'))"
AUTHOR = f"(NOT {m('text', EMAIL)} AND NOT {m('text', URL)} AND {_SURN} >= 2 AND (({_INIT} >= 2 AND (contains(text, ',') OR contains(text, ';') OR contains({_NL}, ' и ') OR contains({_NL}, ' and '))) OR {_INIT} >= 4))"
AFFIL = f"""(({' OR '.join(f"contains({_NL}, '{w}')" for w in P.AFFILIATION_STEMS)}) AND len(string_split({NS('text')}, ' ')) <= 28
  AND ({m(NS('text'), '^[0-9*#,.\\s]+')} OR contains(text, ',') OR NOT {m('text', _META)}))"""
FRONT = f"({NS('text')} <> '' AND ({TOKENS} OR {m('text', _TYPE)} OR {DATED} OR {AUTHOR} OR {AFFIL} OR {m(NS('text'), '(?i)^\\*?\\s*e-?mail')}))"
_UP = "(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))))"
HEADERISH = f"""(length({S('text')}) < 10 OR {m('text', _META)} OR {m('text', _TYPE)} OR {m('text', '(?i)(For\\s+citation|Для\\s+цитирования):')}
  OR {m(S('text'), '(?i)^(Источники|Литература|References|Список\\s+литературы|Bibliography|Библиография)')}
  OR {m(S('text'), '(?i)^(Введение|Методы?|Результаты|Обсуждение|Заключение|Выводы|Introduction|Methods?|Results?|Discussion|Conclusion|Background|Materials?\\s+and\\s+Methods?|Acknowledgements?)\\.?\\s*$')}
  OR (length({S('text')}) >= 20 AND {_UP} >= 0.7))"""
REFHEAD_PREFIX = m(NS("text"), "(?i)^(СПИСОК\\s+ЛИТЕРАТУРЫ|ЛИТЕРАТУРА|REFERENCES|BIBLIOGRAPHY|СПИСОК\\s+ИСТОЧНИКОВ)([^\\p{L}\\p{N}_]|$)")
REFEND_PREFIX = m(NS("text"), "(?i)^(Поступила|Рукопись|Received|Accepted|Информация\\s+об\\s+авторе|Information\\s+about\\s+the\\s+author)([^\\p{L}\\p{N}_]|$)")
REF_HEADING = f"""({_MK} IN ({', '.join(f"'{x}'" for x in P.HEADING_MARKERS)}))"""
REF_END = f"""({_MK} IN ({', '.join(f"'{x}'" for x in P.END_MARKERS)}) OR starts_with({_MK}, 'информация об автор') OR starts_with({_MK}, 'information about the author'))"""
RUNNING = f"({m(_MK, '^2\\.5\\.[4567]')} OR contains({_MK}, '{P.HEADER_PHRASES[0]}') OR (starts_with({_MK}, 'вестник мгту') AND (contains({_MK}, '2025') OR contains({_MK}, '2026'))))"
SAFE_HF = f"""({NS('text')} <> '' AND length({NS('text')}) <= 80 AND NOT {FRONT} AND NOT {REFHEAD_PREFIX} AND NOT {REFEND_PREFIX}
  AND NOT {TOKENS} AND NOT (len(string_split({NS('text')}, ' ')) >= 8 AND {_UP} < 0.55))"""
_EN_AUTH = "^[A-Z][A-Za-z'']*[A-Za-z''-]+(\\s+[A-Z][A-Za-z''-]+){0,2},?\\s+([A-Z]\\.\\s*){0,2}[A-Z]\\.\\s*[A-Za-z0-9_\\p{L}]"
REF_START = f"""({m(NS('text'), '^(\\[[0-9]{1,4}\\]|[0-9]{1,4}[.)])\\s+')} OR
  (({m(NS('text'), '^[А-ЯЁ][а-яё-]+(\\s+[А-ЯЁ][а-яё-]+){0,2}\\s+[А-ЯЁ]\\.\\s*[А-ЯЁ]\\.[\\p{L}\\p{N}_]')} OR {m(NS('text'), _EN_AUTH)})
   AND ({m(' || '.join(["' '", NS('text'), "' '"]), '(^|[^\\p{L}\\p{N}_])(18|19|20)[0-9]{2}([^\\p{L}\\p{N}_]|$)')} OR {m('text', '(?i)(doi\\s*:|https?://doi\\.org/|(vol|no)\\.\\s*[0-9]|pp?\\.\\s*[0-9])')})))"""

predicate("is_service_line", P.is_service_line, SERVICE)
predicate("is_reference_heading", P.is_reference_heading, REF_HEADING)
predicate("is_reference_heading_prefix", P.is_reference_heading_prefix, REFHEAD_PREFIX)
predicate("is_reference_end", P.is_reference_end, REF_END)
predicate("is_reference_end_prefix", P.is_reference_end_prefix, REFEND_PREFIX)
predicate("is_reference_start", P.is_reference_start, REF_START)
predicate("is_author_line", P.is_author_line, AUTHOR)
predicate("is_affiliation_line", P.is_affiliation_line, AFFIL)
predicate("is_editorial_date_line", P.is_editorial_date_line, DATED)
predicate("is_front_matter", P.is_front_matter, FRONT)
predicate("is_metadata_or_header", P.is_metadata_or_header, HEADERISH)
predicate("is_running_header", P.is_running_header, RUNNING)
TOC = f"(length({S('text')}) < 5 OR ({m(S('text'), '^\\s*\\S+.*[0-9]+\\s*$')} AND len(regexp_extract_all({S('text')}, '[0-9]+')) <= 2))"
predicate("is_toc_line", P.is_toc_line, TOC)
predicate("is_safe_header_footer", P.is_safe_header_footer, SAFE_HF)


@query("filter_service_blocks", f"SELECT doc_id, line_no, text FROM {RICH.sql} v WHERE NOT {SERVICE}")
def filter_service_blocks(spark, sf):
    return L.filter_service_blocks(RICH.df(spark, sf))


# --- repeated lines ---------------------------------------------------------------------------------------------
_FREQ = f"(SELECT *, count(*) OVER (PARTITION BY doc_id, {S('text')}) AS freq FROM {LINES.sql} l)"


@query("repeated_lines_table", f"SELECT doc_id, line_no, text FROM {_FREQ} v WHERE NOT (freq >= 3 AND length({S('text')}) >= 3)")
def repeated_lines_table(spark, sf):
    return L.remove_repeated_lines(LINES.df(spark, sf), bounded=True)


_W, _U, _LO = "[а-яА-Яa-zA-Z]{4,}", "[А-ЯA-Z]", "[а-яa-z]"


def _tidy(x: str) -> str:
    for gap in ("-\\s+", "-\\n\\s+"):
        x = RR(x, f"({_W}{gap}{_U})|({_W}){gap}({_LO})", "\\1\\2\\3")
    x = f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')"
    return S(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda q: {S('q')}), chr(10))")


@query("remove_repeated_lines", f"""SELECT d.doc_id, {_tidy("coalesce(j.t, '')")} AS text FROM documents d LEFT JOIN
  (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS t FROM {_FREQ} v
   WHERE NOT (freq >= 3 AND length({S('text')}) >= 3) GROUP BY doc_id) j USING (doc_id)""")
def remove_repeated_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.clean_document_text("text").alias("text"))


PAGED = LineView(line_expr="""CASE WHEN line_no % 6 = 0 AND doc_id % 2 = 0 THEN 'Journal of Things ' || doc_id
  WHEN line_no % 6 = 5 THEN cast(doc_id % 3 AS string) WHEN line_no % 6 = 3 AND doc_id % 5 = 0 THEN '№ ' || line_no
  WHEN line_no % 12 = 4 THEN 'page ' || doc_id % 7 ELSE text END""", per_page=6)
_N = f"lower({NS('text')})"
_SAFE_N = SAFE_HF.replace("text", "n")


@query("remove_page_furniture", f"""WITH a AS (SELECT *, {_N} AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS idx,
    count(*) OVER (PARTITION BY doc_id, page) AS size, max(page) OVER (PARTITION BY doc_id) AS pages FROM {PAGED.sql} v),
  b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS freq, greatest(3, (pages + 1) // 2) AS thr,
    regexp_matches(n, '^\\s*[0-9]+\\s*$|^стр\\.\\s*[0-9]+|^page\\s+[0-9]+|^[0-9]+\\s*/\\s*[0-9]+') AS num FROM a),
  c AS (SELECT *, num AND freq >= thr AND pages >= 2 AS fnum FROM b),
  d AS (SELECT *, CASE WHEN fnum THEN row_number() OVER (PARTITION BY doc_id, fnum ORDER BY page, line_no) END AS k FROM c)
  SELECT doc_id, page, line_no, text FROM d WHERE pages < 2 OR n = '' OR NOT (
    (fnum AND k > 1) OR (NOT num AND {_SAFE_N} AND ((freq >= thr AND (idx <= 2 OR idx > size - 2))
      OR regexp_matches(n, '^№\\s*[0-9]+|^no\\.\\s*[0-9]+|^[0-9]{{4}}\\s*г\\.'))))""")
def remove_page_furniture(spark, sf):
    return L.remove_page_furniture(PAGED.df(spark, sf), bounded=True)


PAGE_TABLE = LineView(per_page=2)


@query("select_pages", f"""WITH p AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, page FROM {PAGE_TABLE.sql} v) w)
  SELECT doc_id, page FROM p WHERE page <= 3 OR page > greatest(3, n - 3)""")
def select_pages(spark, sf):
    return L.select_pages(PAGE_TABLE.df(spark, sf).select("doc_id", "page").distinct(), bounded=True)


# Ordinals with gaps: every line keeps its order, and how far apart two stand depends on the text.
SPARSE = "cast(line_no * 3 + length(text) % 3 AS bigint)"


@query("renumber", f"SELECT doc_id, {SPARSE} AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_number FROM {LINES.sql} v")
def renumber(spark, sf):
    return L.renumber(LINES.df(spark, sf).selectExpr("doc_id", f"{SPARSE} AS line_no"), bounded=True)


@query("renumber_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system'")
def renumber_turns(spark, sf):
    return L.renumber(table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn"), ["conv_id"], "turn", "n")


@query("chunk_lines", f"""SELECT doc_id, chunk, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS lines FROM (
  SELECT doc_id, line_no, {S('text')} AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5 AS chunk
  FROM {LINES.sql} v WHERE {S('text')} <> '') w GROUP BY doc_id, chunk""")
def chunk_lines(spark, sf):
    return L.chunk_lines(LINES.df(spark, sf), 5, bounded=True)


@query("chunk_text", f"""WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS chunk, '' AS piece, {S("replace(text, chr(10), ' ')")} AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk + 1, trim(substr(rest, 1, cut)), ltrim(substr(rest, cut + 1)) FROM (
    SELECT *, CASE WHEN length(rest) <= 800 THEN length(rest)
      WHEN 800 - length(regexp_extract(substr(rest, 1, 800), '\\.[^.]*$')) < 480 THEN 800
      WHEN NOT contains(substr(rest, 1, 800), '.') THEN 800
      ELSE 800 - length(regexp_extract(substr(rest, 1, 800), '\\.[^.]*$')) END AS cut FROM c WHERE rest <> '') q)
  SELECT doc_id, chunk - 1 AS pos, piece AS text FROM c WHERE chunk > 0""")
def chunk_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return docs.select("doc_id", F.posexplode(L.chunk_text("text", 800)).alias("pos", "text"))


_G = "list_filter(list_transform(string_split({0}, chr(10)), lambda q: trim(q)), lambda q: q <> '')"


@query("split_oversized", f"""WITH c AS (SELECT doc_id, text, {_G.format('text')} AS ls FROM documents),
  a AS (SELECT doc_id, unnest(CASE WHEN length(text) > 2000 THEN list_transform(range(0, greatest(1, len(ls)), 12), lambda i: array_to_string(ls[i + 1:i + 12], chr(10))) ELSE [text] END) AS t,
        unnest(CASE WHEN length(text) > 2000 THEN range(0, greatest(1, len(ls)), 12) ELSE [0] END) AS o FROM c),
  b AS (SELECT doc_id, o, t, {_G.format('t')} AS ls FROM a),
  d AS (SELECT doc_id, o, unnest(CASE WHEN length(t) // 4 > 375 THEN list_transform(range(0, greatest(1, len(ls)), 8), lambda i: array_to_string(ls[i + 1:i + 8], chr(10))) ELSE [t] END) AS text,
        unnest(CASE WHEN length(t) // 4 > 375 THEN range(0, greatest(1, len(ls)), 8) ELSE [0] END) AS o2 FROM b)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, o2) - 1)::INTEGER AS part, text FROM d""")
def split_oversized(spark, sf):
    return L.split_oversized(table(spark, sf, "documents").select("doc_id", "text"), 25, 2000, 375)


NAMES = View("part", ["p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '..' WHEN 1 THEN p_name || '/x' WHEN 2 THEN ' ' || p_name || ' ' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE p_name END AS name"])


@query("safe_names", f"SELECT p_partkey, trim(name) AS name FROM {NAMES.sql} v WHERE trim(coalesce(name, '')) <> '' AND NOT contains(name, '/') AND name NOT IN ('.', '..')")
def safe_names(spark, sf):
    return L.safe_names(NAMES.df(spark, sf))


MEMBERS = View("part", ["p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '/etc/' || p_name WHEN 1 THEN 'a/../' || p_name WHEN 2 THEN '__MACOSX/' || p_name WHEN 3 THEN 'x/.DS_Store' WHEN 4 THEN 'C:/x' ELSE 'raw/' || p_name END AS path"])


@query("safe_members", f"""SELECT p_partkey, path, CASE WHEN starts_with(path, '/') OR starts_with(path, 'C:') OR contains(path, '/../') THEN 'rejected'
  WHEN starts_with(path, '__MACOSX') OR path LIKE '%.DS_Store' THEN 'ignored' ELSE 'ok' END AS status FROM {MEMBERS.sql} v""")
def safe_members(spark, sf):
    return L.safe_members(MEMBERS.df(spark, sf))


@query("paragraphs_to_html", f"""SELECT doc_id, CASE WHEN len(ps) = 0 THEN '<div></div>' ELSE array_to_string(list_transform(ps, lambda q: '<p>' ||
  replace(replace(replace(replace(replace(q, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>'), chr(10)) END AS html
  FROM (SELECT doc_id, {_G.format('text')} AS ps FROM documents) v""")
def paragraphs_to_html(spark, sf):
    from ..functions.text import split_lines

    return table(spark, sf, "documents").select("doc_id", L.paragraphs_to_html(split_lines("text")).alias("html"))


@query("blocks_to_html", f"""SELECT doc_id, string_agg('<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>', chr(10) ORDER BY line_no) AS html
  FROM {RICH.sql} v WHERE {S('text')} <> '' GROUP BY doc_id""")
def blocks_to_html(spark, sf):
    return L.blocks_to_html(RICH.df(spark, sf).withColumnRenamed("line_no", "pos"))


STYLES = View("part", ["p_partkey", """CASE p_partkey % 12 WHEN 0 THEN 'Заголовок 1' WHEN 1 THEN 'Heading2' WHEN 2 THEN 'Authors' WHEN 3 THEN 'Abstract' WHEN 4 THEN 'Аннотация EN'
  WHEN 5 THEN 'Ключевые слова' WHEN 6 THEN 'Список литературы' WHEN 7 THEN 'Table caption' WHEN 8 THEN 'Рис. подпись' WHEN 9 THEN 'Список' WHEN 10 THEN 'Numbered' ELSE p_type END AS style"""])


@query("section_of_style", f"""SELECT p_partkey, CASE WHEN upper(style) LIKE '%ЗАГОЛОВОК%' OR upper(style) LIKE '%TITLE%' OR upper(style) LIKE '%H1%' THEN 'title'
  WHEN upper(style) LIKE '%HEADING2%' THEN 'subtitle' WHEN upper(style) LIKE '%AUTHOR%' THEN 'authors'
  WHEN (upper(style) LIKE '%АННОТАЦ%' OR upper(style) LIKE '%ABSTRACT%') THEN CASE WHEN upper(style) LIKE '%EN%' THEN 'abstract_en' ELSE 'abstract' END
  WHEN upper(style) LIKE '%КЛЮЧ%' THEN 'keywords' WHEN upper(style) LIKE '%ЛИТЕРАТУР%' THEN 'references' WHEN upper(style) LIKE '%TABLE%' THEN 'table-caption'
  WHEN upper(style) LIKE '%РИС%' THEN 'figure-caption' WHEN upper(style) LIKE '%СПИСОК%' THEN 'list-ul' WHEN upper(style) LIKE '%NUMBER%' THEN 'list-ol' ELSE 'body' END AS section FROM {STYLES.sql} v""")
def section_of_style(spark, sf):
    return STYLES.df(spark, sf).select("p_partkey", P.section_of_style("style").alias("section"))


_LK = f"CASE WHEN {m('text', '^\\s*[•*–—-]\\s+')} THEN 'ul' WHEN {m('text', '^\\s*(\\(?[0-9]{1,3}[.)]|\\[[0-9]{1,3}\\])\\s+')} THEN 'ol' ELSE '' END"


@query("list_kind", f"""SELECT doc_id, line_no, k AS kind, CASE k WHEN 'ul' THEN {S("regexp_replace(text, '^\\s*[•*–—-]\\s+', '')")}
  WHEN 'ol' THEN {S("regexp_replace(text, '^\\s*(\\(?[0-9]{1,3}[.)]|\\[[0-9]{1,3}\\])\\s+', '')")} ELSE text END AS text
  FROM (SELECT *, {_LK} AS k FROM {RICH.sql} v) w""")
def list_kind(spark, sf):
    kind = P.list_kind("text")
    return RICH.df(spark, sf).select("doc_id", "line_no", F.coalesce(kind, F.lit("")).alias("kind"), P.strip_list_marker("text", kind).alias("text"))
