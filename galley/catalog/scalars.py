"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, codes, text
from .registry import View, query, scalar

C = F.col


def S(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def NS(x: str) -> str:
    return S(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def RR(x: str, p: str, r: str = "") -> str:
    return f"regexp_replace({x}, '{p}', '{r}', 'g')"


DOCS = View("documents", ["doc_id", "text", "lang"])
TABBED = View("documents", ["doc_id", "replace(replace(text, '. ', '.' || chr(9) || '  '), ', ', ',' || chr(13)) AS t"])
ORD = "o_orderkey"

scalar("clean_text", TABBED, "doc_id", lambda: text.clean_text("t"),
       S("regexp_replace(replace(replace(replace(t, chr(9), ' '), chr(10), ' '), chr(13), ' '), ' {2,}', ' ', 'g')"))
scalar("norm_space", TABBED, "doc_id", lambda: text.norm_space("t"), NS("t"))

INVIS = View("documents", ["doc_id", "replace(replace(text, 'e', 'e­'), ' th', '​ th﻿') AS t"])
scalar("strip_invisible", INVIS, "doc_id", lambda: text.strip_invisible("t"),
       "replace(replace(replace(t, '­', ''), '​', ''), '﻿', '')")

EMPTYISH = View("orders", [ORD, """CASE o_orderkey % 6 WHEN 0 THEN ' — ' WHEN 1 THEN '-' WHEN 2 THEN '   '
  WHEN 3 THEN ' – - ' WHEN 4 THEN '  ' || o_orderpriority || ' ' ELSE NULL END AS t"""])
scalar("norm_empty", EMPTYISH, ORD, lambda: text.norm_empty("t"),
       f"CASE WHEN regexp_matches({S('coalesce(t, chr(32))')}, '^[\\s–—-]+$') THEN '' "
       f"ELSE {S('coalesce(t, chr(32))')} END")

DATES = View("orders", [ORD, """CASE o_orderkey % 7
  WHEN 0 THEN ' ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ' г.'
  WHEN 1 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
  WHEN 2 THEN year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate)
  WHEN 3 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
  WHEN 4 THEN lpad(cast(day(o_orderdate) AS string), 2, '0') || '-' || lpad(cast(month(o_orderdate) AS string), 2, '0')
       || '-' || year(o_orderdate)
  WHEN 5 THEN 'около ' || year(o_orderdate) ELSE NULL END AS t"""])
_D1, _D2 = "^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", "^([0-9]{4})[./]([0-9]{1,2})[./]([0-9]{1,2})"
_ST = S("coalesce(t, '')")
scalar("normalize_date", DATES, ORD, lambda: codes.normalize_date("t"), f"""CASE
  WHEN length({_ST}) = 10 AND length({_ST}) - length(replace({_ST}, '-', '')) = 2 THEN {_ST}
  WHEN regexp_matches({_ST}, '{_D1}') THEN regexp_extract({_ST}, '{_D1}', 3) || '-' ||
    lpad(regexp_extract({_ST}, '{_D1}', 2), 2, '0') || '-' || lpad(regexp_extract({_ST}, '{_D1}', 1), 2, '0')
  WHEN regexp_matches({_ST}, '{_D2}') THEN regexp_extract({_ST}, '{_D2}', 1) || '-' ||
    lpad(regexp_extract({_ST}, '{_D2}', 2), 2, '0') || '-' || lpad(regexp_extract({_ST}, '{_D2}', 3), 2, '0')
  ELSE {_ST} END""")

DOIS = View("orders", [ORD, """CASE o_orderkey % 5 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'DOI: '
  WHEN 2 THEN ' http://dx.doi.org/' WHEN 3 THEN 'doi:' ELSE '' END
  || '10.' || (1000 + o_orderkey % 9000) || CASE WHEN o_orderkey % 2 = 0 THEN ' / ' ELSE '/' END || 'S' || o_custkey
  || CASE WHEN o_orderkey % 3 = 0 THEN ' - 1' ELSE '-1' END
  || CASE o_orderkey % 4 WHEN 0 THEN ').' WHEN 1 THEN ';' ELSE '' END AS t"""])
scalar("normalize_doi", DOIS, ORD, lambda: codes.normalize_doi("t"),
       S(f"regexp_replace({RR('t', '\\s*([/-])\\s*', '\\1')}, '(?i)^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', '')"))
scalar("normalize_doi_site", DOIS, ORD, lambda: codes.normalize_doi("t", "site"),
       f"regexp_replace({S(f'''regexp_replace({NS('t')}, '(?i)^(?:doi:\\s*|https?://doi\\.org/)', '')''')}, "
       "'[).,;]+$', '')")

SPLIT_DOIS = View("orders", [ORD, """'Текст. DOI: 10.' || (1000 + o_orderkey % 9000) || '/abc.' || o_custkey ||
  CASE o_orderkey % 5 WHEN 0 THEN ' 2-192. Далее' WHEN 1 THEN '-' || chr(10) || ' 77 x' WHEN 2 THEN ', 5.6-7; конец'
  WHEN 3 THEN ' 2024 год' ELSE ').' END AS t"""])
scalar("extract_best_doi", SPLIT_DOIS, ORD, lambda: codes.extract_best_doi("t"),
       """'10.' || (1000 + o_orderkey % 9000) || '/abc.' || regexp_extract(t, '/abc\\.([0-9]+)', 1) ||
       CASE o_orderkey % 5 WHEN 0 THEN '2-192' WHEN 1 THEN '-77' WHEN 2 THEN '5.6-7' ELSE '' END""")

ISSNS = View("supplier", ["s_suppkey", """CASE s_suppkey % 4 WHEN 0 THEN 'ISSN ' ELSE '' END ||
  substring(lpad(cast(1000000 + s_suppkey * 37 AS string), 7, '0'), 1, 4) ||
  CASE WHEN s_suppkey % 3 = 0 THEN ' – ' ELSE '-' END || substring(cast(1000000 + s_suppkey * 37 AS string), 5, 3) ||
  CASE s_suppkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE cast(s_suppkey % 10 AS string) END AS t"""])
scalar("normalize_issn", ISSNS, "s_suppkey", lambda: codes.normalize_issn("t"),
       "CASE WHEN length(regexp_replace(t, '[^0-9Xx]', '', 'g')) = 8 THEN "
       "upper(substr(regexp_replace(t, '[^0-9Xx]', '', 'g'), 1, 4)) || '-' || "
       "upper(substr(regexp_replace(t, '[^0-9Xx]', '', 'g'), 5, 4)) ELSE '' END")

KEYWORDS = View("part", ["p_partkey", """p_name || CASE p_partkey % 3 WHEN 0 THEN ', ' WHEN 1 THEN ' ; ' ELSE ' ;; ' END
  || p_type || CASE WHEN p_partkey % 2 = 0 THEN ',, ' ELSE '; ' END || p_brand ||
  CASE p_partkey % 4 WHEN 0 THEN ' . .' WHEN 1 THEN '.' WHEN 2 THEN ';' ELSE '' END AS t"""])
_KWL = f"list_filter(list_transform(string_split_regex({{}}, '[;,]'), lambda x: {S('x')}), lambda x: x <> '')"
scalar("normalize_keywords", KEYWORDS, "p_partkey", lambda: codes.normalize_keywords("t"),
       f"regexp_replace(array_to_string({_KWL.format(S('t'))}, '; '), '[\\s.]+$', '')")
SITE_KEYWORDS = View("part", ["p_partkey", """CASE p_partkey % 4 WHEN 0 THEN 'Keywords: ' WHEN 1 THEN 'Ключевые слова - '
  ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ', ' || p_type || '; ' || p_brand || '.' ELSE '.' END AS t"""])
_SK = "regexp_replace(regexp_replace({}, '^[ ,;.]+|[ ,;.]+$', '', 'g'), '(?i)^(keywords|key words|ключевые слова)\\s*[:-]\\s*', '')".format(NS("t"))
_SKL = f"list_filter(list_transform(string_split_regex({_SK}, '[;,]'), lambda x: regexp_replace(x, '^[ ,;.]+|[ ,;.]+$', '', 'g')), lambda x: x <> '')"
scalar("split_keywords", SITE_KEYWORDS, "p_partkey", lambda: codes.split_keywords("t"),
       f"CASE WHEN len({_SKL}) <= 1 THEN {_SK} ELSE array_to_string({_SKL}, '; ') END")

PAGES_RAW = """CASE l_orderkey % 9 WHEN 0 THEN l_partkey || '-' || (l_partkey + l_linenumber)
  WHEN 1 THEN l_partkey || '–' || (l_partkey + l_linenumber) WHEN 2 THEN l_partkey || ' — ' || (l_partkey + l_linenumber)
  WHEN 3 THEN ' ' || l_partkey WHEN 4 THEN (l_partkey + 9) || '-' || l_partkey
  WHEN 5 THEN l_partkey || '-' || (l_partkey + 3) || ', ' || (l_partkey + 7) || '-' || (l_partkey + 9)
  WHEN 6 THEN l_partkey || '-' WHEN 7 THEN '-' || l_partkey ELSE 'с. ' || l_partkey END"""
PAGES = View("lineitem", ["l_orderkey", "l_linenumber", f"{PAGES_RAW} AS t"])
_PT = f"replace({S('t')}, ' ', '')"
_PA = f"try_cast(nullif(regexp_extract({_PT}, '^([0-9]+)[–—,-]([0-9]+)(?:[–—,-]|$)', 1), '') AS INTEGER)"
_PB = f"try_cast(nullif(regexp_extract({_PT}, '^([0-9]+)[–—,-]([0-9]+)(?:[–—,-]|$)', 2), '') AS INTEGER)"
_P1 = f"try_cast(nullif(regexp_extract({_PT}, '^([0-9]+)(?:[–—,-]|$)', 1), '') AS INTEGER)"
PAGES_MIN = f"CASE WHEN {_PA} IS NOT NULL THEN least({_PA}, {_PB}) ELSE {_P1} END"
PAGES_MAX = f"CASE WHEN {_PA} IS NOT NULL THEN greatest({_PA}, {_PB}) ELSE {_P1} END"


@query("parse_pages", f"SELECT l_orderkey, l_linenumber, coalesce({PAGES_MIN}, -1) AS min_page, coalesce({PAGES_MAX}, -1) AS max_page FROM {PAGES.sql} v")
def parse_pages(spark, sf):
    p = codes.parse_pages("t")
    return PAGES.df(spark, sf).select("l_orderkey", "l_linenumber", *[F.coalesce(p[f], F.lit(-1)).alias(f) for f in ("min_page", "max_page")])


scalar("start_page_loose", PAGES, "l_orderkey", lambda: F.coalesce(codes.start_page_loose("t"), F.lit(-1)),
       f"coalesce(try_cast(nullif(regexp_extract({S('t')}, '^([0-9]+)', 1), '') AS INTEGER), -1)")

PAGE_PAIR = View("lineitem", ["l_orderkey", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE cast(l_partkey AS int) END AS a",
                              "CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN cast(l_partkey AS int) ELSE cast(l_partkey + l_linenumber AS int) END AS b"])
scalar("format_pages", PAGE_PAIR, "l_orderkey", lambda: codes.format_pages("a", "b"),
       "CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN a || '-' || b "
       "ELSE coalesce(cast(a AS varchar), cast(b AS varchar), '') END")
PAGE_META = View("lineitem", ["l_orderkey", "CASE WHEN l_partkey % 3 = 0 THEN ' ' || l_partkey ELSE '' END AS a",
                              "CASE WHEN l_partkey % 2 = 0 THEN cast(l_partkey + 4 AS string) ELSE NULL END AS b",
                              """CASE l_orderkey % 4 WHEN 0 THEN 'pp. ' || l_partkey || ' – ' || (l_partkey + 2) || '.'
                                 WHEN 1 THEN cast(l_partkey AS string) WHEN 2 THEN 'p' || l_partkey ELSE NULL END AS p"""])
_MR = "\\b([0-9]+)\\s*[–—-]\\s*([0-9]+)\\b"
scalar("parse_pages_meta", PAGE_META, "l_orderkey", lambda: codes.parse_pages_meta("a", "b", "p"), f"""CASE
  WHEN trim(a) <> '' AND coalesce(trim(b), '') <> '' THEN trim(a) || '-' || trim(b)
  WHEN regexp_matches(coalesce(p, ''), '{_MR}') THEN regexp_extract(p, '{_MR}', 1) || '-' || regexp_extract(p, '{_MR}', 2)
  WHEN regexp_matches(coalesce(trim(p), ''), '^[0-9]+$') THEN trim(p) ELSE '' END""")
INTS = View("lineitem", ["l_orderkey", """CASE l_orderkey % 5 WHEN 0 THEN ' ' || l_partkey || ' ' WHEN 1 THEN '—' WHEN 2 THEN '-' || l_partkey
  WHEN 3 THEN l_partkey || '.0' ELSE cast(l_partkey AS string) END AS t"""])
scalar("optional_positive_int", INTS, "l_orderkey", lambda: F.coalesce(codes.optional_positive_int("t"), F.lit(-1)),
       "CASE WHEN regexp_matches(trim(t), '^[0-9]+$') THEN cast(trim(t) AS INTEGER) ELSE -1 END")

ISSUE_KEYS = View("orders", [ORD, """substring(cast(10000000 + o_custkey * 37 AS string), 1, 4) ||
  CASE WHEN o_orderkey % 3 = 0 THEN '–' ELSE '-' END || substring(cast(10000000 + o_custkey * 37 AS string), 5, 3) ||
  CASE o_orderkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN '5' WHEN 2 THEN '5X' ELSE 'x' END || '_' || year(o_orderdate) ||
  CASE WHEN o_orderkey % 2 = 0 THEN '_' || (1 + o_custkey % 40) ELSE '' END || '_' || month(o_orderdate) ||
  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE '' END AS t"""])
_IK = "^([0-9]{4}-[0-9]{3}X|[0-9]{4}-[0-9]{4}X?)_([0-9]{4})_(?:([0-9]+)_)?([0-9]+)$"
_IT = "replace(replace(replace(t, '–', '-'), '—', '-'), '−', '-')"


def _ik(i: int) -> str:
    return f"CASE WHEN regexp_matches({_IT}, '{_IK}') THEN regexp_extract({_IT}, '{_IK}', {i}) END"


@query("parse_issue_key", f"SELECT {ORD}, {_ik(1)} AS issn, {_ik(2)} AS year, nullif({_ik(3)}, '') AS volume, {_ik(4)} AS number FROM {ISSUE_KEYS.sql} v")
def parse_issue_key(spark, sf):
    k = codes.parse_issue_key("t")
    return ISSUE_KEYS.df(spark, sf).select(ORD, *[k[f].alias(f) for f in ("issn", "year", "volume", "number")])


TITLES = View("part", ["p_partkey", "'  “' || p_name || '”  – ‘' || p_type || '’ — ' || p_brand || '​ ' AS t"])
scalar("normalize_search_title", TITLES, "p_partkey", lambda: text.normalize_search_title("t"),
       S("replace(replace(" + NS("translate(replace(t, '​', ''), '“”‘’', '\"\"' || chr(39) || chr(39))") + ", '–', '-'), '—', '-')"))

NAMES = View("customer", ["c_custkey", """CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ', I. ' || c_custkey WHEN 1 THEN ' Ivan  ' || c_mktsegment
  WHEN 2 THEN c_mktsegment WHEN 3 THEN 'Anna Maria ' || c_mktsegment ELSE '' END AS t"""])


@query("split_person_name", f"""SELECT c_custkey,
  CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE list_last(string_split(n, ' ')) END AS family,
  CASE WHEN contains(n, ',') THEN trim(substr(n, instr(n, ',') + 1))
       ELSE array_to_string(list_slice(string_split(n, ' '), 1, len(string_split(n, ' ')) - 1), ' ') END AS given
  FROM (SELECT c_custkey, {NS('t')} AS n FROM {NAMES.sql} v) w""")
def split_person_name(spark, sf):
    n = codes.split_person_name("t")
    return NAMES.df(spark, sf).select("c_custkey", n["family"].alias("family"), n["given"].alias("given"))


INITIALS = View("customer", ["c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'И.С.' WHEN 1 THEN 'A.B.C.' ELSE 'Dr.' || c_custkey END AS t"])
scalar("format_initials", INITIALS, "c_custkey", lambda: codes.format_initials("t"),
       "regexp_replace(regexp_replace(t, '([А-ЯЁA-Z])\\.', '\\1. ', 'g'), '\\s+$', '')")

MARKUP = View("pages", ["page_id", "html"])
_ENT = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_AT = _ENT.format("regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</(div|p|li)>', chr(10), 'g'), '<[^>]+>', '', 'g')")
scalar("annotation_to_text", MARKUP, "page_id", lambda: text.annotation_to_text("html"),
       S(f"regexp_replace({_AT}, '\\n{{3,}}', chr(10) || chr(10), 'g')"))
scalar("strip_tags", MARKUP, "page_id", lambda: text.strip_tags("html"), NS(_ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")))
ABSTRACTS = View("documents", ["doc_id", """'<div class=\"x\">' || replace(replace(replace(text, '. ', '.</P><p>'), ' th', ' <B id=1>th</B>'), ' an', ' & <sup>an</sup>')
  || '</div><br/><br><BR />' AS t"""])
_SAN = ("regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '(?i)<br\\s*/?>', chr(1), 'g'), '(?i)</?(div|p)[^>]*>', '', 'g'), "
        "'<B id=1>', chr(2)), '</B>', chr(3)), '<sup>', chr(4)), '</sup>', chr(5)), '&', '&amp;'), '\"', '&quot;', 'g'), chr(39), '&#x27;', 'g')")
_SAN = f"replace(replace(replace(replace({_SAN}, chr(2), '<b>'), chr(3), '</b>'), chr(4), '<sup>'), chr(5), '</sup>')"
_SAN = f"replace(replace({_SAN}, chr(10), '<br>'), chr(1), '<br>')"
_SAN = S(f"regexp_replace({_SAN}, '(?:<br>\\s*){{3,}}', '<br><br>', 'g')")
scalar("sanitize_annotation", ABSTRACTS, "doc_id", lambda: text.sanitize_annotation("t"),
       S(f"regexp_replace({_SAN}, '^(?:<br>\\s*)+|(?:<br>\\s*)+$', '', 'g')"))

SQUEEZED = View("documents", ["doc_id", "replace(replace(replace(text, ', ', ','), '. A', 'A'), ' th', '») 7 th') AS t"])
scalar("restore_missing_spaces", SQUEEZED, "doc_id", lambda: text.restore_missing_spaces("t"),
       NS(RR(RR(RR("t", "([,;:!?])([A-Za-zА-Яа-яЁё])", "\\1 \\2"), "([a-zа-яё]{2,})([A-ZА-ЯЁ][a-zа-яё])", "\\1 \\2"),
             "([»\"'')\\]])\\s*([0-9]{1,2})(\\s|$)", "\\1[\\2]\\3")))

BROKEN = View("documents", ["doc_id", "replace(replace(replace(text, 'tion', 'ti- on'), 'eren', 'er-' || chr(10) || '  Ren'), 'ing ', 'in– ' || chr(10) || 'g ') AS t"])
_W, _U, _L = "[а-яА-Яa-zA-Z]{4,}", "[А-ЯA-Z]", "[а-яa-z]"


def _dh(x: str, gap: str) -> str:
    return RR(x, f"({_W}{gap}{_U})|({_W}){gap}({_L})", "\\1\\2\\3")


scalar("dehyphenate_prose", BROKEN, "doc_id", lambda: text.dehyphenate("t"), _dh(_dh("t", "-\\s+"), "-\\n\\s+"))
_DASH = "[‑–—-]"
scalar("dehyphenate_field", BROKEN, "doc_id", lambda: text.dehyphenate("t", "field"),
       RR(RR("t", f"([A-Za-zА-Яа-яЁё]){_DASH}\\s*\\n\\s*([a-zа-яё])", "\\1\\2"), f"([A-Za-zА-Яа-яЁё]){_DASH}\\s+([a-zа-яё])", "\\1\\2"))

MERGED = View("documents", ["doc_id", "CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.') WHEN doc_id % 3 = 1 THEN replace(text, ' ', '.') ELSE text END AS t"])
scalar("split_merged_words", MERGED, "doc_id", lambda: text.split_merged_words("t"),
       f"CASE WHEN regexp_matches(t, '\\S{{51,}}') THEN {S(RR(RR('t', '([а-яёa-z])\\.([А-ЯЁA-Z])', '\\1. \\2'), ' +', ' '))} ELSE t END")

FIELD_TEXT = View("documents", ["doc_id", """CASE doc_id % 4 WHEN 0 THEN 'annotation' WHEN 1 THEN 'keywords_en' WHEN 2 THEN 'references_en' ELSE 'title' END AS field""",
                                """CASE doc_id % 4 WHEN 0 THEN 'Аннотация: ' WHEN 1 THEN 'Keywords - ' ELSE '' END || replace(text, '. ', '.' || chr(13) || chr(10) || ' C org ') AS t"""])
_FT = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FT = f"CASE WHEN regexp_matches({_FT}, '\\S{{51,}}') THEN {S(RR(RR(_FT, '([а-яёa-z])\\.([А-ЯЁA-Z])', '\\1. \\2'), ' +', ' '))} ELSE {_FT} END"
_FT = RR(RR(_FT, f"([A-Za-zА-Яа-яЁё]){_DASH}\\s*\\n\\s*([a-zа-яё])", "\\1\\2"), f"([A-Za-zА-Яа-яЁё]){_DASH}\\s+([a-zа-яё])", "\\1\\2")
_FT = f"regexp_replace(regexp_replace({_FT}, '(?i)^(аннотация|abstract)\\s*[:-]\\s*', ''), '(?i)^(ключевые слова|keywords)\\s*[:-]\\s*', '')"
_FT = f"CASE WHEN field LIKE 'references%' THEN {_FT} ELSE {RR(_FT, '[ \\t]*\\n[ \\t]*', ' ')} END"
_WB = "(^|[^\\p{L}\\p{N}_])"
_FT = RR(_FT, _WB + "(?i:([A-ZА-ЯЁ]))\\s+(?i:(org))([^\\p{L}\\p{N}_]|$)", "\\1\\2_\\3\\4")
scalar("normalize_field_text", FIELD_TEXT, "doc_id", lambda: text.normalize_field_text("t", "field"), S(RR(_FT, "[ \\t]+", " ")))

scalar("upper_ratio", DOCS, "doc_id", lambda: F.round(text.upper_ratio("text"), 9),
       "round(CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE "
       "length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) * 1.0::DOUBLE / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END, 9)")
SCRIPTS = View("documents", ["doc_id", """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(replace(replace(text, 'e', 'е'), 't', 'т'), 'n', 'ж')
  WHEN 2 THEN '1234 абвг ABCD' ELSE '12 - 34' END AS t"""])
_CY, _LA = "length(regexp_replace(t, '[^\\x{0400}-\\x{04FF}]', '', 'g'))", "length(regexp_replace(regexp_replace(t, '[^\\p{L}]', '', 'g'), '[\\x{0400}-\\x{10FFFF}]', '', 'g'))"
scalar("detect_script", SCRIPTS, "doc_id", lambda: text.detect_script("t"),
       f"CASE WHEN {_CY} = 0 AND {_LA} = 0 THEN 'unknown' WHEN {_CY} > {_LA} THEN 'ru' ELSE 'en' END")

WORDS_SQL = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_AVG = "(list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE / len(ws))"
_SHORT = "(len(list_filter(ws, lambda w: length(w) <= 2))::DOUBLE / len(ws))"
TEXT_QUALITY_SQL = f"""CASE WHEN len(ws) = 0 THEN 'inf'::DOUBLE ELSE
  CASE WHEN {_AVG} BETWEEN 3.0 AND 15.0 THEN 0.0 ELSE 50.0 END + abs({_AVG} - CASE lang WHEN 'en' THEN 5.5 WHEN 'ru' THEN 6.5 ELSE 6.0 END)
  + CASE WHEN {_SHORT} > 0.3 THEN {_SHORT} * 20 ELSE 0.0 END END"""


@query("text_quality", f"SELECT doc_id, round({TEXT_QUALITY_SQL}, 6) AS out FROM (SELECT doc_id, lang, {WORDS_SQL} AS ws FROM documents) v")
def text_quality(spark, sf):
    return DOCS.df(spark, sf).select("doc_id", F.round(text.text_quality("text", "lang"), 6).alias("out"))


_V = "length(regexp_replace(lower(w), '[^аеёиоуыэюяaeiouy]', '', 'g'))"
GARBLED_SQL = f"""coalesce({_AVG} > 15
  OR len(list_filter(ws, lambda w: length(w) > 3 AND regexp_matches(substr(w, 2), '\\p{{Lu}}')))::DOUBLE / len(ws) > 0.05
  OR len(list_filter(ws, lambda w: {_V} = 0))::DOUBLE / len(ws) > 0.3
  OR len(list_filter(ws, lambda w: length(w) >= 5 AND {_V} > 0 AND {_V}::DOUBLE / length(w) < 0.2))::DOUBLE / len(ws) > 0.3, false)"""


@query("is_garbled", f"SELECT doc_id, {GARBLED_SQL} AS out FROM (SELECT doc_id, lang, {WORDS_SQL} AS ws FROM documents) v")
def is_garbled(spark, sf):
    return DOCS.df(spark, sf).select("doc_id", text.is_garbled("text", "lang").alias("out"))


CAND_DOIS = View("orders", [ORD, "'https://j' || o_custkey % 90 || '.example.org' || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END AS site",
                            "CASE o_orderkey % 4 WHEN 0 THEN 'doi: 10.1134/S' || o_orderkey WHEN 1 THEN '10.1134/S' || o_orderkey || '-2' WHEN 2 THEN 'S' || o_orderkey ELSE 'https://doi.org/10.7868/A/B' || o_orderkey || '.' END AS doi"])


@query("doi_url_candidates", f"""WITH n AS (SELECT {ORD}, rtrim(site, '/') || '/' AS root,
   rtrim(regexp_replace(doi, '(?i)^(doi:\\s*|https?://doi\\.org/)', ''), ').,;') AS v FROM {CAND_DOIS.sql} x),
 t AS (SELECT {ORD}, root, lower(substr(v, instr(v, '/') + 1)) AS token FROM n WHERE contains(v, '/'))
 SELECT {ORD}, 0 AS pos, CASE WHEN regexp_matches(token, '-[0-9]+$') THEN root || token || '/' ELSE root || token || '-1/' END AS url FROM t
 UNION ALL SELECT {ORD}, 1 AS pos, root || token || '/' FROM t WHERE NOT regexp_matches(token, '-[0-9]+$')""")
def doi_url_candidates(spark, sf):
    return CAND_DOIS.df(spark, sf).select(ORD, F.posexplode(codes.doi_url_candidates("site", "doi")).alias("pos", "url"))


URLS = View("pages", ["page_id", "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '&sl=ru&z=1#top' WHEN 2 THEN 'https://h.example/p?sl=ru' ELSE 'https://h.example/p/' || page_id || '#f' END AS u"])
scalar("with_lang_param", URLS, "page_id", lambda: codes.with_lang_param("u", "en"), """
  CASE WHEN regexp_matches(u, '[?][^#]*sl=') THEN regexp_replace(u, '([?&])sl=[^&#]*', '\\1sl=en', 'g')
       WHEN contains(u, '?') THEN regexp_replace(u, '^([^#]*)(#.*)?$', '\\1&sl=en\\2')
       ELSE regexp_replace(u, '^([^#]*)(#.*)?$', '\\1?sl=en\\2') END""")
scalar("safe_key", DOIS, ORD, lambda: text.safe_key("t"), "regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g')")
scalar("content_hash", DOCS, "doc_id", lambda: text.content_hash("text"), "sha256(text)")

BOXES = View("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice / 200.0 AS x1", "l_quantity * 10.0 AS y1", "l_partkey / 4.0 AS x2", "l_suppkey * 3.0 AS y2"])


@query("bbox_ops", f"""SELECT l_orderkey, l_linenumber, round(x1 / 595.0, 9) AS nx1, round(y1 / 842.0, 9) AS ny1,
  round(x2 / 595.0 * 612.0, 6) AS dx2, round(greatest(0.0, least(x1, x2) - 5.0), 6) AS px1, round(least(842.0, greatest(y1, y2) + 3.0), 6) AS py2,
  (greatest(0.0, least(x1, x2) - 5.0) < least(595.0, greatest(x1, x2) + 5.0)) AND (greatest(0.0, least(y1, y2) - 3.0) < least(842.0, greatest(y1, y2) + 3.0)) AS valid
  FROM {BOXES.sql} v""")
def bbox_ops(spark, sf):
    df = BOXES.df(spark, sf).withColumn("w", F.lit(595.0)).withColumn("h", F.lit(842.0)).withColumn("b", F.struct("x1", "y1", "x2", "y2"))
    df = df.withColumn("n", boxes.box_normalize("b", "w", "h")).withColumn("p", boxes.box_pad(boxes.box_order("b"), 5.0, 3.0, "w", "h"))
    d = boxes.box_denormalize("n", F.lit(612.0), F.lit(792.0))
    return df.select("l_orderkey", "l_linenumber", F.round(C("n.x1"), 9).alias("nx1"), F.round(C("n.y1"), 9).alias("ny1"), F.round(d["x2"], 6).alias("dx2"),
                     F.round(C("p.x1"), 6).alias("px1"), F.round(C("p.y2"), 6).alias("py2"), boxes.box_valid("p").alias("valid"))


FIRSTS = View("customer", ["c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE ' ' || c_mktsegment END AS a", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || '  x' END AS b"])
scalar("first_non_empty", FIRSTS, "c_custkey", lambda: text.first_non_empty("a", "b"),
       "coalesce(nullif(trim(a), ''), nullif(regexp_replace(b, '\\s+', ' ', 'g'), ''), '')")
