"""Reference-list jobs over lines derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import split_lines
from ..operators import references as R
from .line_jobs import _EN_AUTH, _MK, REF_END, REF_HEADING, RICH, RUNNING, m
from .registry import LineView, View, query, table
from .scalars import NS, RR, S

C = F.col
W = "OVER (PARTITION BY doc_id ORDER BY line_no)"

REFS = LineView(line_expr="""CASE WHEN line_no % 40 = 1 THEN 'References' WHEN line_no % 40 = 30 THEN 'Information about the author'
  WHEN line_no % 11 = 3 THEN line_no || '. ' || text WHEN line_no % 11 = 5 THEN 'https://doi.org/10.1000/' || doc_id || '.' || line_no
  WHEN line_no % 11 = 7 THEN '2.5.4 header' WHEN line_no % 11 = 8 THEN 'doi: 10.1000/' || (line_no % 3) || '.x' WHEN line_no % 11 = 9 THEN ' '
  ELSE text || CASE WHEN line_no % 2 = 0 THEN ' ' || (1900 + line_no % 100) || '. pp. 3-4' ELSE '' END END""")
BLOCK_TYPE = "CASE WHEN (doc_id + line_no) % 4 = 0 THEN 'li' ELSE 'p' END"


def agg(source: str, extra: str = "", sep: str = "' '") -> str:
    return f"SELECT doc_id, min(line_no) AS line_no, {extra}string_agg(text, {sep} ORDER BY line_no) AS text FROM {source} GROUP BY doc_id, isl"


def _merge_sql(test: str) -> str:
    return agg(f"(SELECT *, sum(CASE WHEN {test} THEN 0 ELSE 1 END) {W} AS isl FROM (SELECT doc_id, line_no, {S('text')} AS text FROM {REFS.sql} v) a WHERE text <> '')")


@query("merge_doi_lines", _merge_sql(m("text", "(?i)^(https?://|doi\\.org/|doi:)")))
def merge_doi_lines(spark, sf):
    return R.merge_doi_lines(REFS.df(spark, sf), bounded=True)


@query("merge_doi_lines_narrow", _merge_sql("starts_with(text, 'http') AND contains(lower(text), 'doi.org')"))
def merge_doi_lines_narrow(spark, sf):
    return R.merge_doi_lines(REFS.df(spark, sf), "narrow", bounded=True)


@query("merge_doi_items", f"""SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM ({_merge_sql(m("text", "(?i)^(https?://|doi\\.org/|doi:)"))}) z GROUP BY doc_id""")
def merge_doi_items(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(split_lines("text")).alias("line_no", "text"))
    lines = docs.selectExpr("doc_id", "line_no", f"{REFS.line_expr} AS text")
    items = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return items.select("doc_id", F.array_join(R.merge_doi_items(C("ls.text")), "\n").alias("text")).where("text <> ''")


_ASSEMBLE = f"""WITH a AS (SELECT doc_id, line_no, {BLOCK_TYPE} AS block_type, {S('text')} AS text FROM {REFS.sql} v),
  b AS (SELECT *, {_MK} AS mk, {RUNNING} AS hd, {REF_HEADING} AS isopen, {REF_END} AS isend FROM a),
  c AS (SELECT *, CASE WHEN hd THEN NULL WHEN isopen THEN 'open' WHEN isend THEN 'end' END AS ev FROM b),
  d AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {W}, 'end') AS st FROM c),
  e AS (SELECT *, st = 'open' AND ev IS NULL AND NOT hd AND block_type <> 'li' AS pl FROM d),
  f AS (SELECT *, pl AND coalesce(lag(pl) {W}, false) AND NOT {m('text', '^\\s*(\\[[0-9]{1,3}\\]|[0-9]{1,3}[.)])')} AS cont FROM e),
  g AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) {W} AS isl FROM f),
  h AS (SELECT doc_id, min(line_no) AS pos, arg_min(block_type, line_no) AS block_type, {S("string_agg(text, ' ' ORDER BY line_no)")} AS text FROM g WHERE NOT hd GROUP BY doc_id, isl)
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_number FROM h"""


@query("assemble_references", _ASSEMBLE)
def assemble_references(spark, sf):
    blocks = REFS.df(spark, sf).selectExpr("doc_id", "line_no AS pos", f"{BLOCK_TYPE} AS block_type", "text")
    return R.assemble_references(blocks, bounded=True)


@query("merge_doi_paragraphs", f"""WITH a AS (SELECT doc_id, line_no, '<p>' || text || '</p>' AS html, line_no % 5 <> 0 AS adjacent, {S('text')} AS t FROM {REFS.sql} v),
  b AS (SELECT *, sum(CASE WHEN adjacent AND starts_with(t, 'http') AND contains(lower(t), 'doi.org') THEN 0 ELSE 1 END) {W} AS isl FROM a)
  SELECT doc_id, min(line_no) AS pos, string_agg(html, ' ' ORDER BY line_no) AS html FROM b GROUP BY doc_id, isl""")
def merge_doi_paragraphs(spark, sf):
    blocks = REFS.df(spark, sf).selectExpr("doc_id", "line_no AS pos", "'<p>' || text || '</p>' AS html", "line_no % 5 <> 0 AS adjacent")
    return R.merge_doi_paragraphs(blocks, bounded=True)


PAIRS = LineView(line_expr="""CASE line_no % 9 WHEN 1 THEN 'URL:' WHEN 2 THEN 'https://www.' WHEN 3 THEN 'https://h.example/a-' WHEN 4 THEN 'tail' || line_no || '.pdf'
  WHEN 5 THEN 'See DOI: 10.7868/' WHEN 6 THEN 'S' || line_no || '-X' WHEN 7 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://a.' ELSE 'URL' END ELSE text END""")
_GLUE = f"""a AS (SELECT doc_id, line_no, text, lead(text) {W} AS nx, row_number() {W} AS n FROM {{src}}),
  b AS (SELECT *, CASE WHEN {m('text', '(?i)^URL\\s*:?$')} AND {m("coalesce(nx, '')", '(?i)^https?://\\S*$')} THEN ' '
     WHEN {m('text', '(?i)DOI:\\s*\\S+/\\s*$')} AND {m("coalesce(nx, '')", '(?i)^[A-Z0-9][A-Z0-9./-]+$')} THEN ''
     WHEN {m('text', '(?i)^https?://\\S*$')} AND coalesce(nx, '') <> '' AND NOT {m("nx", '(?i)^https?://')} AND {m('text', '[./-]$')} THEN '' END AS j FROM a),
  c AS (SELECT *, j IS NOT NULL AND (n - coalesce(max(CASE WHEN j IS NULL THEN n END) {W}, 0)) % 2 = 1 AS tk FROM b),
  d AS (SELECT *, coalesce(lag(tk) {W}, false) AS gone FROM c),
  glued AS (SELECT doc_id, line_no, CASE WHEN tk THEN {NS("text || j || nx")} ELSE text END AS text FROM d WHERE NOT gone)"""


@query("glue_pairs", f"WITH s0 AS (SELECT doc_id, line_no, {NS('text')} AS text FROM {PAIRS.sql} v), {_GLUE.format(src='s0')} SELECT * FROM glued")
def glue_pairs(spark, sf):
    return R.glue_pairs(PAIRS.df(spark, sf), bounded=True)


_HEAD = m("text", "(?i)^(СПИСОК\\s+ЛИТЕРАТУРЫ|ЛИТЕРАТУРА|REFERENCES|BIBLIOGRAPHY|СПИСОК\\s+ИСТОЧНИКОВ)([^\\p{L}\\p{N}_]|$)")
_END = m("text", "(?i)^(Поступила|Рукопись|Received|Accepted|Информация\\s+об\\s+авторе|Information\\s+about\\s+the\\s+author)([^\\p{L}\\p{N}_]|$)")
_BLOCK = f"""r0 AS (SELECT doc_id, line_no, {NS('text')} AS text FROM {REFS.sql} v),
  r1 AS (SELECT *, min(CASE WHEN {_HEAD} THEN line_no END) OVER (PARTITION BY doc_id) AS h FROM r0 WHERE text <> ''),
  r2 AS (SELECT *, min(CASE WHEN {_END} THEN line_no END) OVER (PARTITION BY doc_id) AS e FROM r1 WHERE line_no > h),
  blk AS (SELECT doc_id, line_no, text FROM r2 WHERE e IS NULL OR line_no < e)"""
_HINT = "(length(text) < 120 AND " + m("' ' || text || ' '", "(?i)[^\\p{L}\\p{N}_](19|20)[0-9]{2}[^\\p{L}\\p{N}_]|№\\s*[0-9]+|[^\\p{L}\\p{N}_]pp?\\.[\\p{L}\\p{N}_]|[^\\p{L}\\p{N}_]с\\.[\\p{L}\\p{N}_]|Славяноведение|Slavic Studies") + ")"
_FILTERED = f"""{_BLOCK}, f0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS size, lower(text) AS n FROM blk),
  f1 AS (SELECT *, count(CASE WHEN length(text) >= 8 THEN 1 END) OVER (PARTITION BY doc_id, n) AS fq FROM f0),
  flt AS (SELECT doc_id, line_no, text FROM f1 WHERE NOT (fq >= CASE WHEN size >= 40 THEN 3 ELSE 2 END AND {_HINT}))"""


@query("reference_block", f"WITH {_BLOCK} SELECT * FROM blk")
def reference_block(spark, sf):
    return R.reference_block(REFS.df(spark, sf), bounded=True)


@query("filter_repeated_in_references", f"WITH {_FILTERED} SELECT * FROM flt")
def filter_repeated(spark, sf):
    return R.filter_repeated_in_references(R.reference_block(REFS.df(spark, sf), bounded=True), bounded=True)


_STARTS = f"({m('text', '^(\\[[0-9]{1,4}\\]|[0-9]{1,4}[.)])\\s+')} OR {m('text', '^[А-ЯЁ][а-яё-]+(\\s+[А-ЯЁ][а-яё-]+){0,2}\\s+[А-ЯЁ]\\.\\s*[А-ЯЁ]\\.[\\p{L}\\p{N}_]')} OR {m('text', _EN_AUTH)})"


def _tidy(x: str) -> str:
    x = RR(f"regexp_replace({NS(x)}, '(?i)\\bURL\\s*:\\s*', 'URL: ', 'g')", "\\s+([,.;:])", "\\1")
    return RR(RR(x, "([(/])\\s+", "\\1"), "\\s+([)])", "\\1")


_NORM = f"""{_FILTERED}, {_GLUE.format(src='flt')},
  n0 AS (SELECT *, sum(CASE WHEN {_STARTS} THEN 1 ELSE 0 END) {W} AS isl FROM glued WHERE text <> ''),
  n1 AS ({agg('n0 WHERE isl > 0')}), entries AS (SELECT doc_id, line_no, {_tidy('text')} AS text FROM n1)"""


@query("normalize_references", f"WITH {_NORM} SELECT * FROM entries WHERE text <> ''")
def normalize_references(spark, sf):
    return R.normalize_references(REFS.df(spark, sf), bounded=True)


_SHARE = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0 END)"
_Q = f"""round(greatest(0.0, least(1.0, {_SHARE.format(m("' ' || text || ' '", '[^\\p{L}\\p{N}_](18|19|20)[0-9]{2}[^\\p{L}\\p{N}_]'))} * 0.45::DOUBLE
  + {_SHARE.format(m("' ' || text || ' '", '(?i)[^\\p{L}\\p{N}_](pp?\\.\\s*[0-9]+|с\\.\\s*[0-9]+)[^\\p{L}\\p{N}_]|[^\\p{L}\\p{N}_]doi\\s*:|https?://doi\\.org/'))} * 0.35::DOUBLE
  + (1.0::DOUBLE - {_SHARE.format(f'length({S("text")}) < 20')}) * 0.10::DOUBLE
  + (1.0::DOUBLE - {_SHARE.format(m('text', 'https?://\\S*\\s+\\S+'))}) * 0.10::DOUBLE)), 6)"""


@query("reference_quality", f"WITH {_NORM} SELECT doc_id, count(*) AS entries, {_Q} AS score FROM entries WHERE text <> '' GROUP BY doc_id")
def reference_quality(spark, sf):
    q = R.reference_quality(R.normalize_references(REFS.df(spark, sf), bounded=True))
    return q.select("doc_id", "entries", F.round("score", 6).alias("score"))


RAWREFS = View("documents", ["doc_id", """CASE WHEN doc_id % 2 = 0 THEN '1. ' ELSE '' END || replace(replace(text, '. ', '.' || chr(10) || 'Smith 1999 — '), ', ', chr(10) || ' 12) ') AS t"""])


@query("estimate_reference_count", f"""SELECT doc_id, greatest(len(regexp_extract_all(t, '(?:^|\\n)\\s*(?:\\[[0-9]{{1,3}}\\]|[0-9]{{1,3}}[.)])\\s+')),
  len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё''’.-]+\\s+(?:18|19|20)[0-9]{{2}}\\s*[—–-]\\s*')))::INTEGER AS n FROM {RAWREFS.sql} v""")
def estimate_reference_count(spark, sf):
    return RAWREFS.df(spark, sf).select("doc_id", R.estimate_reference_count("t").alias("n"))


KEY_SQL = """CASE WHEN regexp_matches(g, '(?i)\\b(?:doi:\\s*)?10\\.[0-9]{4,9}/[^\\s,;]+') THEN 'doi:' || lower(regexp_extract(g, '(?i)\\b(?:doi:\\s*)?(10\\.[0-9]{4,9}/[^\\s,;]+)', 1))
  WHEN regexp_matches(s, '(?i)\\bhttps?://[^\\s)]+') THEN 'url:' || lower(regexp_extract(s, '(?i)\\bhttps?://[^\\s)]+'))
  ELSE 'txt:' || trim(regexp_replace(lower(s), '[^\\p{L}\\p{N}_]+', ' ', 'g')) END"""


def _dedupe_sql(source: str) -> str:
    return f"""SELECT doc_id, line_no, s AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) AS rn FROM (
      SELECT *, {KEY_SQL} AS k FROM (SELECT *, {RR('s', '\\s*([/-])\\s*', '\\1')} AS g FROM (SELECT doc_id, line_no, {NS('text')} AS s FROM {source}) q0) q1 WHERE s <> '') q2) q3 WHERE rn = 1"""


@query("dedupe_references", _dedupe_sql(f"{REFS.sql} v"))
def dedupe_references(spark, sf):
    return R.dedupe_references(REFS.df(spark, sf))


@query("dedupe_corpus_lines", f"SELECT lang, line_no, text FROM ({_dedupe_sql('(SELECT lang AS doc_id, doc_id * 100000 + line_no AS line_no, text FROM ' + LineView().sql + ' l JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id)) v')}) z JOIN (SELECT DISTINCT lang FROM documents) y ON y.lang = z.doc_id")
def dedupe_corpus_lines(spark, sf):
    """The same over a few very large keys: every line of a language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(split_lines("text")).alias("n", "text"))
    lines = docs.select("lang", (C("doc_id") * 100000 + C("n")).alias("line_no"), "text")
    return R.dedupe_references(lines, ["lang"])


FALL = LineView(line_expr="""CASE WHEN line_no % 7 = 2 AND doc_id % 3 = 0 THEN line_no || '. ' || text
  WHEN line_no % 7 = 4 THEN 'Smith 1999 — ' || text WHEN line_no % 7 = 5 THEN 'url:' WHEN line_no % 7 = 6 THEN '10.1000/' || line_no ELSE text END""")
_FALL_BLOCK = f"""r0 AS (SELECT doc_id, line_no, {NS('text')} AS text FROM {FALL.sql} v WHERE {S('text')} <> ''),
  r2 AS (SELECT *, min(CASE WHEN {_END} THEN line_no END) OVER (PARTITION BY doc_id) AS e FROM r0),
  blk AS (SELECT doc_id, line_no, text FROM r2 WHERE e IS NULL OR line_no < e)"""
_FALL_NORM = f"WITH {_NORM.replace(_BLOCK, _FALL_BLOCK)}"


@query("fallback_references", f"""{_FALL_NORM}, strict AS (SELECT doc_id, line_no, text FROM entries WHERE text <> ''),
  l0 AS (SELECT doc_id, line_no, {S('text')} AS text FROM {FALL.sql} v WHERE {S('text')} <> ''),
  l1 AS (SELECT *, lag(text) {W} AS pv FROM l0),
  l2 AS (SELECT *, sum(CASE WHEN ({m('text', '^(?:\\[[0-9]{1,3}\\]|[0-9]{1,3}[.)])\\s+')} OR {m('text', "^[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё''’.-]+\\s+(?:18|19|20)[0-9]{2}\\s*[—–-]\\s*")})
     AND NOT {m('text', '(?i)^(?:doi\\s*:|https?://|doi\\.org/|10\\.[0-9]{4,9}/)')} AND NOT {m("coalesce(pv, '')", '(?i)(doi\\s*:|url\\s*:)\\s*$')} THEN 1 ELSE 0 END) {W} AS isl FROM l1),
  l3 AS ({agg('l2')}), u AS (SELECT * FROM strict UNION ALL SELECT * FROM l3 WHERE doc_id NOT IN (SELECT doc_id FROM strict))
  {_dedupe_sql('u')}""")
def fallback_references(spark, sf):
    return R.fallback_references(FALL.df(spark, sf), bounded=True)


_LF = "list_filter({}, lambda q: q <> '')"


@query("split_references", f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(t, chr(10), ' ') ELSE t END AS t FROM {RAWREFS.sql} v),
  b AS (SELECT doc_id, {_LF.format("list_transform(string_split(t, chr(10)), lambda q: " + NS('q') + ")")} AS ls FROM a),
  c AS (SELECT doc_id, CASE WHEN len(ls) = 1 THEN string_split(regexp_replace(ls[1], '\\s(\\[[0-9]+\\]|[0-9]+\\.)', chr(1) || '\\1', 'g'), chr(1)) ELSE ls END AS xs FROM b)
  SELECT doc_id, array_to_string({_LF.format("list_transform(xs, lambda q: trim(regexp_replace(trim(q), '^(\\[[0-9]+\\]|[0-9]+\\.)\\s*', '')))")}, chr(10)) AS text FROM c""")
def split_references(spark, sf):
    df = RAWREFS.df(spark, sf).withColumn("t", F.when(C("doc_id") % 2 == 0, F.replace("t", F.lit("\n"), F.lit(" "))).otherwise(C("t")))
    return df.select("doc_id", F.array_join(R.split_references("t"), "\n").alias("text"))


_NUMB = "'(?:^|\\n)\\s*[0-9]{1,3}\\s*[).:\\]]|\\[[0-9]{1,3}\\]'"


@query("numbered_references", f"""WITH a AS (SELECT doc_id, array_to_string({_LF.format("list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN text ELSE t END, chr(10)), lambda q: " + S('q') + ")")}, chr(10)) AS t
    FROM {RAWREFS.sql} v JOIN documents USING (doc_id)),
  b AS (SELECT doc_id, CASE WHEN regexp_matches(t, {_NUMB}) THEN list_transform(string_split_regex(t, {_NUMB})[2:], lambda q: {S("regexp_replace(q, '\\s*\\n\\s*', ' ', 'g')")})
     ELSE list_transform(string_split(t, chr(10)), lambda q: {NS('q')}) END AS xs FROM a)
  SELECT doc_id, array_to_string({_LF.format('xs')}, chr(10)) AS text FROM b""")
def numbered_references(spark, sf):
    df = RAWREFS.df(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    t = F.when(C("doc_id") % 3 == 0, C("text")).otherwise(C("t"))
    return df.select("doc_id", F.array_join(R.numbered_references(t), "\n").alias("text"))


ALLOC = View("orders", ["o_orderkey", "'r' || o_custkey AS a", "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE ' e' || o_custkey END AS b",
                        """CASE o_orderkey % 4 WHEN 0 THEN 'x' || chr(10) || ' Список  литературы: ' || chr(10) || 'y' WHEN 1 THEN 'REFERENCES' || chr(10) || 'Литература.' WHEN 2 THEN 'z' || chr(10) || 'references' ELSE 'see references here' END AS t"""])
_RU, _EN = m("t", "(?im)^\\s*(список\\s+литературы|литература|библиография|источники)\\s*[:.]?\\s*$"), m("t", "(?im)^\\s*references\\s*[:.]?\\s*$")


@query("allocate_references", f"""SELECT o_orderkey, CASE WHEN {_RU} AND {_EN} THEN a WHEN {_EN} THEN '' ELSE a || CASE WHEN trim(b) <> '' THEN '|' || trim(b) ELSE '' END END AS rus,
  CASE WHEN {_RU} AND {_EN} THEN trim(b) WHEN {_EN} THEN a || CASE WHEN trim(b) <> '' THEN '|' || trim(b) ELSE '' END ELSE '' END AS eng FROM {ALLOC.sql} v""")
def allocate_references(spark, sf):
    r = R.allocate_references(F.array("a"), F.array("b"), "t")
    df = ALLOC.df(spark, sf).withColumn("r", r)
    return df.select("o_orderkey", F.array_join("r.RUS", "|").alias("rus"), F.array_join("r.ENG", "|").alias("eng"))


# --- sections ---------------------------------------------------------------------------------------------------
STYLE = "CASE (doc_id + line_no) % 13 WHEN 3 THEN 'Abstract EN' WHEN 7 THEN 'Колонтитул' WHEN 9 THEN 'Title' ELSE 'Body' END"
SECT = LineView(line_expr="""CASE (doc_id * 3 + line_no) % 17 WHEN 1 THEN 'Аннотация' WHEN 4 THEN 'Keywords: ' || text WHEN 5 THEN 'one, two' WHEN 8 THEN 'For citation: x'
  WHEN 10 THEN 'References.' WHEN 12 THEN 'Об авторах: x' WHEN 14 THEN 'Introduction' WHEN 15 THEN 'Резюме - ' || text ELSE replace(replace(text, ',', ''), ';', '') END""")
_M = "regexp_replace(" + NS("replace(lower(text), 'ё', 'е')") + ", '^[ .:;–—-]+|[ .:;–—-]+$', '', 'g')"
_ALL = {k: "|".join(sorted(v, key=len, reverse=True)) for k, v in R.SECTION_MARKERS.items()}
_ALONE = "CASE " + " ".join(f"WHEN regexp_matches(mk, '^({v})$') THEN '{k}'" for k, v in _ALL.items()) + " END"
_INL = "CASE " + " ".join(f"WHEN regexp_matches(pl, '(?i)^\\s*({v})\\s*[:.—–-]\\s*(.+?)\\s*$') THEN '{k}'" for k, v in _ALL.items()) + " END"
_EVERY = "|".join(w for v in _ALL.values() for w in v.split("|"))


@query("carry_sections", f"""WITH a AS (SELECT doc_id, line_no, {STYLE} AS style, {S('text')} AS pl, {_M} AS mk FROM {SECT.sql} v),
  b AS (SELECT *, style = 'Колонтитул' OR starts_with(mk, 'for citation') OR regexp_matches(mk, '^({"|".join(R.BODY_HEADINGS)})$') AS cl,
    CASE style WHEN 'Abstract EN' THEN 'abstract_en' WHEN 'Title' THEN 'title' ELSE 'body' END AS tag FROM a),
  c AS (SELECT *, CASE WHEN NOT cl AND mk <> '' THEN {_ALONE} END AS al FROM b),
  d AS (SELECT *, CASE WHEN NOT cl AND mk <> '' AND al IS NULL THEN {_INL} END AS inl FROM c),
  e AS (SELECT *, CASE WHEN cl THEN '-' WHEN al IS NOT NULL THEN al WHEN inl IS NOT NULL THEN inl WHEN tag = 'abstract_en' THEN tag
     WHEN contains(mk, 'об авторах') OR tag <> 'body' OR mk = '' THEN '-' END AS ev FROM d),
  f AS (SELECT *, last_value(ev IGNORE NULLS) {W} AS op, count(ev) {W} AS ep, ev IS NULL AND len(string_split(mk, ' ')) > 25 AND NOT contains(mk, ',') AND NOT contains(mk, ';') AS stp FROM e),
  g AS (SELECT *, sum(CASE WHEN stp THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ep ORDER BY line_no) AS stops FROM f),
  h AS (SELECT *, CASE WHEN cl OR al IS NOT NULL THEN NULL WHEN op LIKE 'keywords%' AND stops > 0 THEN NULL ELSE nullif(op, '-') END AS section FROM g)
  SELECT doc_id, line_no, coalesce(section, '') AS section, CASE WHEN section IS NULL THEN '' WHEN inl IS NOT NULL THEN regexp_extract(pl, '(?i)^\\s*({_EVERY})\\s*[:.—–-]\\s*(.+?)\\s*$', 2) ELSE pl END AS content FROM h""")
def carry_sections(spark, sf):
    paras = SECT.df(spark, sf).selectExpr("doc_id", "line_no", f"{STYLE} AS style", "text")
    out = R.carry_sections(paras, bounded=True)
    return out.select("doc_id", "line_no", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("content", F.lit("")).alias("content"))


@query("inline_tokens")
def inline_tokens(spark, sf):
    df = RICH.df(spark, sf).select("doc_id", "line_no", F.explode(R.inline_tokens("text")).alias("t"))
    return df.select("doc_id", "line_no", "t.*")


@query("split_metadata_line")
def split_metadata_line(spark, sf):
    return RICH.df(spark, sf).select("doc_id", "line_no", F.posexplode(R.split_metadata_line("text")).alias("part", "text"))


@query("paragraphs")
def paragraphs(spark, sf):
    """Whole texts; the rules keep a state, so there is no SQL for it. Tested against worked examples."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(R.paragraphs("text")).alias("pos", "text"))
