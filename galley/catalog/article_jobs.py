"""Record jobs: overlay, flattening, catalogue messages, XML assembly and rules, over records derived from orders."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import articles as R
from ..operators import issues as K
from ..schemas import AUTHORS
from ..session import checkpoint_dir
from ..sources import files
from .issue_jobs import ISSUE, JOURNALS, PAGES
from .registry import View, query
from .scalars import S

C = F.col
FLAT = View("orders", [
    "o_orderkey", f"{ISSUE} AS issue", "'a' || o_orderkey AS name", f"{PAGES} AS pages", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'RAR' END AS art_type",
    "CASE o_orderkey % 4 WHEN 0 THEN 'RUS' WHEN 1 THEN 'ENG' WHEN 2 THEN '' ELSE 'DEU' END AS lang", "CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'Статья & ' || o_orderkey END AS title_ru",
    "CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE 'Paper <' || o_orderkey || '>' END AS title_en", "'Аннотация ' || o_orderkey AS abs_ru", "CASE WHEN o_orderkey % 5 = 0 THEN ' — ' ELSE 'Text<br>two ' || o_custkey END AS abs_en",
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '001.' || o_custkey END AS udk", "'10.1000/J.' || o_orderkey AS doi", "o_orderpriority || ';' || o_orderstatus AS kw", "'Ref ' || o_orderkey || chr(10) || 'https://doi.org/10.1/' || o_custkey AS refs",
    "'2024-01-0' || (1 + o_orderkey % 9) AS received", "CASE WHEN o_orderkey % 2 = 0 THEN 'Grant ' || o_custkey ELSE '' END AS fund", "'Иванов' || o_custkey AS sn_ru", "'Ivanov' || o_custkey AS sn_en",
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '0000-' || o_custkey END AS orcid", "CASE WHEN o_orderkey % 2 = 0 THEN 'sp' || o_custkey ELSE ' ' END AS spin", "CASE WHEN o_orderkey % 4 = 0 THEN '/x/y' || o_orderkey || '.pdf' ELSE NULL END AS file",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'https://h.example/f/' || o_orderkey || '.pdf' ELSE '' END AS pdf_url"], wide=True)
FSQL = f"{FLAT.sql} a"
_I = "named_struct('surname', {0}, 'initials', 'И.', 'orgName', cast(null AS string), 'address', '', 'email', cast(null AS string), 'otherInfo', cast(null AS string), 'authorCodes', named_struct('spin', {1}, 'orcid', {2}, 'scopusid', '', 'researcherid', cast(null AS string)))"
NESTED = [
    "issue", "name", "pages", "art_type AS artType", "lang AS PublLang",
    f"CASE WHEN o_orderkey % 10 = 7 THEN cast(array() AS {AUTHORS}) WHEN o_orderkey % 10 = 8 THEN NULL ELSE cast(array(named_struct('num', '1', 'correspondence', CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, 'individInfo', "
    f"named_struct('RUS', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_I.format('sn_ru', 'null', 'orcid')} END, 'ENG', CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE {_I.format('sn_en', 'spin', 'null')} END))) AS {AUTHORS}) END AS authors",
    "named_struct('RUS', title_ru, 'ENG', title_en) AS artTitles", "named_struct('RUS', abs_ru, 'ENG', abs_en) AS abstracts", "named_struct('udk', udk, 'bbk', cast(null AS string), 'doi', doi, 'edn', '') AS codes",
    "named_struct('RUS', split(kw, ';'), 'ENG', cast(array() AS array<string>)) AS keywords", "named_struct('RUS', split(refs, chr(10)), 'ENG', array('E ' || o_orderkey)) AS references",
    "named_struct('dateReceived', received, 'dateAccepted', cast(null AS string), 'datePublication', '') AS dates", "named_struct('RUS', fund, 'ENG', cast(null AS string)) AS fundings", "named_struct('RUS', '', 'ENG', '') AS shortMessage",
    "file", "cast(null AS string) AS article_url", "pdf_url", "false AS processed"]


def records(spark, sf):
    return FLAT.df(spark, sf).selectExpr(*NESTED)


FORMS = View("orders", [f"{ISSUE} AS issue", "'a' || o_orderkey AS name", "CASE o_orderkey % 4 WHEN 0 THEN ' — ' WHEN 1 THEN ' New ' || o_orderkey WHEN 2 THEN NULL ELSE '' END AS title",
                        "CASE WHEN o_orderkey % 3 = 0 THEN 'Plain' ELSE NULL END AS annotation", "CASE WHEN o_orderkey % 6 = 0 THEN '<p>Rich <b class=x>b</b></p>' ELSE NULL END AS annotation_html",
                        "CASE o_orderkey % 4 WHEN 0 THEN 'x, y; -; z.' WHEN 1 THEN '' ELSE NULL END AS keywords", "CASE o_orderkey % 5 WHEN 0 THEN 'R1' || chr(10) || ' doi: 10.2/x ' || chr(10) || ' - ' || chr(10) || 'R2' WHEN 1 THEN '' ELSE NULL END AS references_ru",
                        "CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) ELSE NULL END AS received_date"], "o_orderkey % 7 <> 3")
_NE = f"CASE WHEN regexp_matches({S('{0}')}, '^[\\s–—-]+$') THEN '' ELSE {S('{0}')} END"


def ne(x):
    x = f"coalesce({x}, '')"
    return f"CASE WHEN regexp_matches({S(x)}, '^[\\s–—-]+$') THEN '' ELSE {S(x)} END"


_FD = "regexp_extract(f.received_date, '([0-9]+)\\.([0-9]+)\\.([0-9]+)', 3) || '-' || lpad(regexp_extract(f.received_date, '([0-9]+)\\.([0-9]+)\\.([0-9]+)', 2), 2, '0') || '-' || lpad(regexp_extract(f.received_date, '([0-9]+)\\.([0-9]+)\\.([0-9]+)', 1), 2, '0')"


@query("apply_form", f"""SELECT a.issue, a.name, CASE WHEN {ne('f.title')} <> '' THEN {ne('f.title')} ELSE coalesce(a.title_ru, '') END AS title, CASE WHEN f.annotation_html IS NOT NULL THEN 'Rich <b>b</b>' WHEN f.annotation IS NOT NULL THEN 'Plain' ELSE a.abs_ru END AS abstract,
  CASE f.keywords WHEN 'x, y; -; z.' THEN 'x|y|z' WHEN '' THEN '' ELSE replace(a.kw, ';', '|') END AS keywords, CASE WHEN f.references_ru = '' THEN '' WHEN f.references_ru IS NOT NULL THEN 'R1 doi: 10.2/x|R2' ELSE replace(a.refs, chr(10), '|') END AS refs,
  CASE WHEN f.received_date IS NOT NULL THEN {_FD} ELSE a.received END AS received, a.doi FROM {FSQL} LEFT JOIN {FORMS.sql} f ON f.issue = a.issue AND f.name = a.name""")
def apply_form(spark, sf):
    out = R.apply_form(records(spark, sf), FORMS.df(spark, sf))
    return out.select("issue", "name", C("artTitles.RUS").alias("title"), C("abstracts.RUS").alias("abstract"), F.array_join("keywords.RUS", "|").alias("keywords"), F.array_join("references.RUS", "|").alias("refs"),
                      C("dates.dateReceived").alias("received"), C("codes.doi").alias("doi"))


@query("to_form", f"""SELECT issue, name, coalesce(title_ru, '') AS title, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Text' || chr(10) || 'two ' || split_part(abs_en, ' ', 2) END AS annotation_en, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE abs_en END AS annotation_en_html,
  replace(kw, ';', '; ') AS keywords, refs AS references_ru, udk AS udc, received AS received_date, lang AS publ_lang, {ne('pages')} AS pages, fund AS funding FROM {FSQL}""")
def to_form(spark, sf):
    return R.to_form(records(spark, sf)).select("issue", "name", "title", "annotation_en", "annotation_en_html", "keywords", "references_ru", "udc", "received_date", "publ_lang", "pages", "funding")


RAWF = View("orders", ["o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'T' || o_orderkey END AS title", "CASE o_orderkey % 3 WHEN 0 THEN ' ' || year(o_orderdate) WHEN 1 THEN 'около 1999' ELSE NULL END AS year",
                       "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' A ' || chr(10) || chr(10) || 'http://x.y/' || o_orderkey || chr(10) || 'B' END AS references_ru", "o_orderpriority AS pages"])


@query("build_form", f"""SELECT o_orderkey, coalesce(nullif(title, ''), '~') AS title, coalesce(try_cast(trim(year) AS INTEGER), -1) AS year, coalesce(year, '~') AS year_raw, CASE WHEN references_ru IS NULL THEN '' ELSE 'A http://x.y/' || o_orderkey || '|B' END AS refs, pages, '~' AS funding FROM {RAWF.sql} v""")
def build_form(spark, sf):
    f = R.build_form(RAWF.df(spark, sf), ("o_orderkey",))
    return f.select("o_orderkey", F.coalesce("title", F.lit("~")).alias("title"), F.coalesce("year", F.lit(-1)).alias("year"), F.coalesce("year_raw", F.lit("~")).alias("year_raw"), F.array_join("references_ru", "|").alias("refs"), "pages", F.coalesce("funding", F.lit("~")).alias("funding"))


# --- catalogue --------------------------------------------------------------------------------------------------
MSG = View("orders", ["'10.1/' || o_orderkey AS doi", """CASE WHEN o_orderkey % 2 = 0 THEN '{"status":"ok","message":' ELSE '' END || '{"title":' || CASE o_orderkey % 3 WHEN 0 THEN '["", "T' || o_orderkey || '"]' WHEN 1 THEN '" T' || o_orderkey || ' "' ELSE 'null' END
  || ',"container-title":["J' || o_custkey || '"]' || CASE WHEN o_orderkey % 4 = 0 THEN ',"issued":{"date-parts":[]}' ELSE '' END || ',"published-print":{"date-parts":[[' || year(o_orderdate) || ',' || month(o_orderdate) || ']]}'
  || ',"author":[{"family":"F' || o_custkey || '","given":"G","ORCID":"http://orcid.org/0-' || o_custkey || '","affiliation":[{"name":"Org"},{"name":" "},"Lab"]},{"name":"Team"}]'
  || ',"abstract":"<jats:p>Abs &amp; ' || o_orderkey || '</jats:p>"' || ',"reference":[{"key":"r1","DOI":"10.9/' || o_orderkey || '","article-title":"AT","year":"1999","author":"A"},{"unstructured":" U ' || o_orderkey || ' "}]}' || CASE WHEN o_orderkey % 2 = 0 THEN '}' ELSE '' END AS payload"""])


@query("parse_catalog_message", """SELECT '10.1/' || o_orderkey AS doi, CASE WHEN o_orderkey % 3 = 2 THEN '~' ELSE 'T' || o_orderkey END AS title, 'J' || o_custkey AS journal, year(o_orderdate)::INTEGER AS year, 'Abs & ' || o_orderkey AS abstract,
  'F' || o_custkey || '/G/G F' || o_custkey || '/0-' || o_custkey || '/Org; Lab|//Team//' AS authors FROM orders""")
def parse_catalog_message(spark, sf):
    m = R.parse_catalog_message(MSG.df(spark, sf))
    a = F.array_join(F.transform("authors", lambda x: F.concat_ws("/", x["family"], x["given"], x["name"], x["orcid"], x["affiliation"])), "|")
    return m.select("doi", F.coalesce("title", F.lit("~")).alias("title"), "journal", "year", "abstract", a.alias("authors"))


@query("catalog_references", """SELECT '10.1/' || o_orderkey AS doi, 0 AS pos, '10.9/' || o_orderkey AS ref_doi, 'AT' AS ref_title, '~' AS ref_unstructured, 'A. AT. 1999. 10.9/' || o_orderkey AS line FROM orders
  UNION ALL SELECT '10.1/' || o_orderkey, 1, '~', '~', ' U ' || o_orderkey || ' ', 'U ' || o_orderkey FROM orders""")
def catalog_references(spark, sf):
    refs = R.catalog_references(R.parse_catalog_message(MSG.df(spark, sf)).select("doi", "reference"))
    line = R.format_reference({k: C(f"ref_{k}") for k in R.REFERENCE_KEYS})
    return refs.select("doi", "pos", *[F.coalesce(c, F.lit("~")).alias(c) for c in ("ref_doi", "ref_title", "ref_unstructured")], line.alias("line"))


REFV = View("lineitem", ["l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 4 = 0 THEN ' whole ' || l_partkey ELSE '  ' END AS unstructured", "'A' || l_partkey AS author", "CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE 'T' || l_suppkey END AS title",
                         "'J' AS journal", "cast(l_linenumber AS string) AS volume", "NULL AS doi", "cast(year(l_shipdate) AS string) AS year"])


@query("format_reference", f"SELECT l_orderkey, l_linenumber, CASE WHEN trim(unstructured) <> '' THEN trim(unstructured) ELSE concat_ws('. ', author, nullif(trim(title), ''), journal, volume, year) END AS full_line, CASE WHEN trim(unstructured) <> '' THEN trim(unstructured) ELSE concat_ws('. ', author, nullif(trim(title), ''), journal, year, volume) END AS short_line FROM {REFV.sql} v")
def format_reference(spark, sf):
    df = REFV.df(spark, sf)
    parts = {c: C(c).cast("string") for c in df.columns[2:]}
    return df.select("l_orderkey", "l_linenumber", R.format_reference(parts).alias("full_line"), R.format_reference(parts, short=True).alias("short_line"))


@query("normalize_authors", "SELECT c_custkey, c_name || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'I.' ELSE '' END || '|' || CASE WHEN c_custkey % 3 = 0 THEN 'Given name' ELSE trim(CASE WHEN c_custkey % 2 = 0 THEN 'I.' ELSE '' END || ' ' || c_name) END || '|' || c_mktsegment AS author FROM customer")
def normalize_authors(spark, sf):
    from .registry import table

    df = table(spark, sf, "customer").selectExpr("c_custkey", "array(map('surname', c_name, 'initials', CASE WHEN c_custkey % 2 = 0 THEN ' I. ' ELSE NULL END, 'name', CASE WHEN c_custkey % 3 = 0 THEN 'Given name' ELSE ' ' END, 'affiliation', c_mktsegment)) AS a")
    x = F.get(R.normalize_authors(C("a")), F.lit(0))
    return df.select("c_custkey", F.concat_ws("|", x["family"], x["given"], x["name"], x["affiliation"]).alias("author"))


# --- exploded records -------------------------------------------------------------------------------------------
_HASA = "o_orderkey % 10 NOT IN (7, 8)"


@query("explode_authors", f"SELECT issue, name, 'RUS' AS lang, sn_ru AS surname FROM {FSQL} WHERE {_HASA} AND o_orderkey % 7 <> 0 UNION ALL SELECT issue, name, 'ENG', sn_en FROM {FSQL} WHERE {_HASA} AND o_orderkey % 14 <> 0")
def explode_authors(spark, sf):
    return R.explode_article(records(spark, sf))["authors"].select("issue", "name", "lang", "surname")


@query("explode_references", f"""SELECT issue, name, 0 AS pos, 'RUS' AS lang, split_part(refs, chr(10), 1) AS text FROM {FSQL} UNION ALL SELECT issue, name, 1, 'RUS', split_part(refs, chr(10), 2) FROM {FSQL}
  UNION ALL SELECT issue, name, 2, 'ENG', 'E ' || o_orderkey FROM {FSQL}""")
def explode_references(spark, sf):
    return R.explode_article(records(spark, sf))["references"].select("issue", "name", "pos", "lang", "text")


@query("explode_keywords", f"SELECT issue, name, 0 AS n, split_part(kw, ';', 1) AS text FROM {FSQL} UNION ALL SELECT issue, name, 1, split_part(kw, ';', 2) FROM {FSQL}")
def explode_keywords(spark, sf):
    return R.explode_article(records(spark, sf))["keywords"].select("issue", "name", "n", "text")


@query("explode_titles", f"SELECT issue, name, 'RUS' AS lang, title_ru AS text FROM {FSQL} WHERE title_ru IS NOT NULL UNION ALL SELECT issue, name, 'ENG', title_en FROM {FSQL} WHERE title_en IS NOT NULL")
def explode_titles(spark, sf):
    return R.explode_article(records(spark, sf))["titles"]


LEGACY = View("orders", ["o_orderkey", """CASE o_orderkey % 2 WHEN 0 THEN '["a' || o_orderkey || '", {"refInfo":{"lang":"RUS","text":"b"}}, {"refInfo":{"text":"c"}}]' ELSE '{"RUS":["r"],"ENG":["e' || o_orderkey || '"]}' END AS raw"""])


@query("legacy_references", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ANY:a' || o_orderkey || '|RUS:b|ANY:c' ELSE 'RUS:r|ENG:e' || o_orderkey END AS refs FROM {LEGACY.sql} v")
def legacy_references(spark, sf):
    x = R.legacy_references(C("raw"))
    return LEGACY.df(spark, sf).select("o_orderkey", F.array_join(F.transform(x, lambda r: F.concat(r["lang"], F.lit(":"), r["text"])), "|").alias("refs"))


@query("pick_author_codes", f"""SELECT issue, name, CASE WHEN o_orderkey % 7 <> 0 AND orcid <> '' THEN 'orcid=' || orcid WHEN o_orderkey % 14 <> 0 AND trim(spin) <> '' THEN 'spin=' || spin ELSE '' END AS codes FROM {FSQL} WHERE {_HASA}""")
def pick_author_codes(spark, sf):
    a = records(spark, sf).select("issue", "name", F.explode("authors").alias("a")).withColumn("c", R.pick_author_codes("a.individInfo"))
    text = F.concat_ws(",", *[F.when(C(f"c.{k}").isNotNull(), F.concat(F.lit(k + "="), C(f"c.{k}"))) for k in R.CODE_TYPES])
    return a.select("issue", "name", text.alias("codes"))


@query("resolve_file_name", f"SELECT issue, name, CASE WHEN file IS NOT NULL THEN 'y' || o_orderkey || '.pdf' WHEN pdf_url <> '' THEN o_orderkey || '.pdf' ELSE '~' END AS f FROM {FSQL}")
def resolve_file_name(spark, sf):
    return records(spark, sf).select("issue", "name", F.coalesce(R.resolve_file_name("file", "pdf_url", F.lit(None).cast("string")), F.lit("~")).alias("f"))


# --- model output -----------------------------------------------------------------------------------------------
RESP = View("orders", ["o_orderkey", """CASE o_orderkey % 5 WHEN 0 THEN '{"a":' || o_orderkey || '}' WHEN 1 THEN 'Here: ' || chr(10) || '{"a":' || o_orderkey || '} done' WHEN 2 THEN 'no json' WHEN 3 THEN '{"a": oops}' ELSE ' [1, 2] ' END AS r"""])


@query("parse_model_json", f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN r WHEN 1 THEN '{{\"a\":' || o_orderkey || '}}' WHEN 4 THEN '[1, 2]' ELSE '~' END AS out FROM {RESP.sql} v")
def parse_model_json(spark, sf):
    return RESP.df(spark, sf).select("o_orderkey", F.coalesce(R.parse_model_json("r"), F.lit("~")).alias("out"))


MREF = View("orders", ["o_orderkey", """CASE o_orderkey % 4 WHEN 0 THEN '{"references":["A  1","B","a 1"]}' WHEN 1 THEN '["C","D' || o_orderkey || '"]' WHEN 2 THEN 'x {"references":["E"]} y' ELSE '{' || chr(10) || 'F' || o_orderkey || chr(10) || ' G ' || chr(10) || '}' END AS r"""])


@query("model_references", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A 1|B' WHEN 1 THEN 'C|D' || o_orderkey WHEN 2 THEN 'E' ELSE 'F' || o_orderkey || '|G' END AS refs FROM {MREF.sql} v")
def model_references(spark, sf):
    return MREF.df(spark, sf).select("o_orderkey", F.array_join(R.model_references("r"), "|").alias("refs"))


@query("mark_processed", f"SELECT issue, name, o_orderkey % 3 = 0 AS processed FROM {FSQL}")
def mark_processed(spark, sf):
    r = records(spark, sf).select("issue", "name", "processed")
    done = FLAT.df(spark, sf).where("o_orderkey % 3 = 0").select("issue", "name")
    return R.mark_processed(r, done).withColumn("processed", R.is_processed())


EXT = View("orders", ["o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'doi: 10.1000/J.' ELSE 'https://doi.org/10.1000/J.' || o_orderkey END AS doi", "'DOI 10.1000/J.' || o_orderkey || CASE WHEN o_orderkey % 4 = 2 THEN '-a1' ELSE '' END || ' end' AS t"])


@query("extend_doi", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 2 THEN '10.1000/J.' || o_orderkey || '-a1' ELSE '10.1000/J.' || o_orderkey END AS doi FROM {EXT.sql} v")
def extend_doi(spark, sf):
    return EXT.df(spark, sf).select("o_orderkey", R.extend_doi("doi", "t").alias("doi"))


@query("references_parity", f"SELECT issue, name, 2 AS rus, 1 AS eng FROM {FSQL} WHERE o_orderkey % 2 = 0")
def references_parity(spark, sf):
    t = F.when(F.substring("name", 2, 20).cast("bigint") % 2 == 0, F.lit("Литература\nx\nReferences:\ny")).otherwise(F.lit("References\ny"))
    return R.references_parity(records(spark, sf).withColumn("text", t))


@query("empty_payloads", "SELECT o_orderkey, o_orderkey % 4 = 0 AS empty FROM orders")
def empty_payloads(spark, sf):
    from .registry import table

    c = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN ' — ' WHEN o_orderkey % 4 = 1 THEN 'T' ELSE '' END AS title", "CASE WHEN o_orderkey % 4 = 2 THEN '1-2' END AS pages", "CASE WHEN o_orderkey % 4 = 3 THEN array('r') ELSE cast(array() AS array<string>) END AS references")
    ok, bad = R.empty_payloads(c)
    return ok.select("o_orderkey", F.lit(False).alias("empty")).unionByName(bad.select("o_orderkey", F.lit(True).alias("empty")))


# --- XML --------------------------------------------------------------------------------------------------------
def esc(x):
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_INFO = "'<individInfo lang=\"{0}\"><surname>' || {1} || '</surname><initials>И.</initials></individInfo>'"
_AUTH = f"""CASE WHEN o_orderkey % 10 IN (7, 8) THEN '<authors/>' WHEN o_orderkey % 14 = 0 AND o_orderkey % 3 = 2 THEN '<authors><author num="1"/></authors>' ELSE '<authors><author num="1">' || CASE o_orderkey % 3 WHEN 0 THEN '<correspondent>1</correspondent>' WHEN 1 THEN '<correspondent>0</correspondent>' ELSE '' END
  || CASE WHEN o_orderkey % 7 <> 0 AND orcid <> '' THEN '<authorCodes><orcid>' || orcid || '</orcid></authorCodes>' WHEN o_orderkey % 14 <> 0 AND trim(spin) <> '' THEN '<authorCodes><spin>' || spin || '</spin></authorCodes>' ELSE '' END
  || CASE WHEN o_orderkey % 7 <> 0 THEN {_INFO.format('RUS', 'sn_ru')} ELSE '' END || CASE WHEN o_orderkey % 14 <> 0 THEN {_INFO.format('ENG', 'sn_en')} ELSE '' END || '</author></authors>' END"""


def el(name, x):
    return f"CASE WHEN {x} = '' THEN '<{name}/>' ELSE '<{name}>' || {x} || '</{name}>' END"


_XML = f"""'<article>' || {el('pages', 'pages')} || {el('artType', "coalesce(art_type, '')")} || CASE WHEN lang <> '' THEN '<langPubl>' || lang || '</langPubl>' ELSE '' END || {_AUTH}
  || CASE WHEN title_ru IS NULL AND title_en IS NULL THEN '<artTitles/>' ELSE '<artTitles>' || coalesce('<artTitle lang="RUS">' || {esc('title_ru')} || '</artTitle>', '') || coalesce('<artTitle lang="ENG">' || {esc('title_en')} || '</artTitle>', '') || '</artTitles>' END
  || '<abstracts><abstract lang="RUS">' || abs_ru || '</abstract><abstract lang="ENG">' || {esc('abs_en')} || '</abstract></abstracts><codes>' || CASE WHEN udk <> '' THEN '<udk>' || udk || '</udk>' ELSE '' END || '<doi>' || doi || '</doi></codes>'
  || '<keywords><kwdGroup lang="RUS"><keyword>' || replace(kw, ';', '</keyword><keyword>') || '</keyword></kwdGroup></keywords><references><reference><refInfo lang="RUS"><text>' || replace(refs, chr(10), '</text></refInfo></reference><reference><refInfo lang="RUS"><text>')
  || '</text></refInfo></reference><reference><refInfo lang="ENG"><text>E ' || o_orderkey || '</text></refInfo></reference></references>'
  || CASE WHEN file IS NOT NULL THEN '<files><file desc="fullText">y' || o_orderkey || '.pdf</file></files>' WHEN pdf_url <> '' THEN '<files><file desc="fullText">' || o_orderkey || '.pdf</file></files>' ELSE '' END
  || '<dates><dateReceived>' || received || '</dateReceived><datePublication/></dates><artFunding>' || CASE WHEN fund = '' THEN '<funding lang="RUS"/>' ELSE '<funding lang="RUS">' || fund || '</funding>' END || '</artFunding></article>'"""


@query("article_xml", f"SELECT issue, name, {_XML} AS xml FROM {FSQL}")
def article_xml(spark, sf):
    return K.article_xml(records(spark, sf)).select("issue", "name", _FLATX_col().alias("xml"))


def _FLATX_col():
    return F.regexp_replace("xml", r">\s+<", "><")


from .issue_jobs import _IK, _MAX, _MIN  # noqa: E402

_CFG = f"""cfg AS (SELECT i.issue, regexp_extract(i.issue, '{_IK}', 1) AS issn, j.Title AS title, regexp_extract(i.issue, '{_IK}', 2) AS year, regexp_extract(i.issue, '{_IK}', 3) AS volume, regexp_extract(i.issue, '{_IK}', 4) AS number,
   CASE WHEN lo = hi THEN cast(lo AS varchar) WHEN lo IS NULL THEN '' ELSE lo || '-' || hi END AS pages FROM (SELECT issue, min({_MIN}) AS lo, max({_MAX}) AS hi FROM {FSQL} GROUP BY issue) i
   JOIN (SELECT *, row_number() OVER (PARTITION BY upper(ISSN) ORDER BY ord) AS rn FROM {JOURNALS.sql} j0) j ON upper(j.ISSN) = upper(regexp_extract(i.issue, '{_IK}', 1)) AND rn = 1)"""


ISSUE_XML = f"""WITH {_CFG}, arts AS (SELECT issue, string_agg({_XML}, '' ORDER BY {_MIN} NULLS LAST, lower(name)) AS x FROM {FSQL} GROUP BY issue)
  SELECT issue, '<journal><titleid>0</titleid><issn>' || issn || '</issn><journalInfo lang="RUS"><title>' || title || '</title></journalInfo><issue>' || {el('volume', 'volume')} || '<number>' || number || '</number><dateUni>' || year || '</dateUni><pages>' || pages
   || '</pages><articles>' || x || '</articles></issue></journal>' AS xml FROM cfg JOIN arts USING (issue) WHERE pages <> ''"""


@query("issue_xml", ISSUE_XML)
def issue_xml(spark, sf):
    return K.issue_xml(records(spark, sf), JOURNALS.df(spark, sf)).select("issue", _FLATX_col().alias("xml"))


@query("write_issue_xml", ISSUE_XML)
def write_issue_xml(spark, sf):
    """The files as they are read back, one per issue, by the name that the writer gave them."""
    folder = f"{checkpoint_dir(spark)}/issue-files-{uuid.uuid4().hex}"
    made = files.write_issue_xml(records(spark, sf), JOURNALS.df(spark, sf), folder)
    read = spark.read.option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    named = read.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f"), F.regexp_replace("value", r"\A<\?xml[^>]*\?>\s*", "").alias("xml"))
    met = named.join(made, F.col("f") == F.col("file"))
    return met.select("issue", F.regexp_replace(_FLATX_col(), r"\s+\z", "").alias("xml"))


@query("issue_xml_parts", f"""WITH {_CFG}, good AS (SELECT issue FROM cfg WHERE pages <> '') SELECT issue, 0 AS part, count(*) AS n FROM good GROUP BY issue UNION ALL SELECT issue, 2, count(*) FROM good GROUP BY issue
  UNION ALL SELECT issue, 1, count(*) FROM {FSQL} WHERE issue IN (SELECT issue FROM good) GROUP BY issue""")
def issue_xml_parts(spark, sf):
    return K.issue_xml_parts(records(spark, sf), JOURNALS.df(spark, sf)).groupBy("issue", "part").agg(F.count(F.lit(1)).alias("n"))


@query("config_errors", f"WITH {_CFG} SELECT issue, 'pages' AS rule FROM cfg WHERE pages = ''")
def config_errors(spark, sf):
    return K.config_errors(K.configured_issues(records(spark, sf), JOURNALS.df(spark, sf))).select("issue", "rule")


@query("article_errors", f"""SELECT issue, name, 'artType' AS rule FROM {FSQL} WHERE art_type IS NULL UNION ALL SELECT issue, name, 'langPubl' FROM {FSQL} WHERE lang = 'DEU' UNION ALL SELECT issue, name, 'authors' FROM {FSQL} WHERE o_orderkey % 10 = 8
  UNION ALL SELECT issue, name, 'author' FROM {FSQL} WHERE o_orderkey % 10 = 7 UNION ALL SELECT issue, name, 'artTitle' FROM {FSQL} WHERE title_ru IS NULL AND title_en IS NULL UNION ALL SELECT issue, name, 'individInfo' FROM {FSQL} WHERE o_orderkey % 14 = 0 AND {_HASA}""")
def article_errors(spark, sf):
    return K.article_errors(records(spark, sf)).select("issue", "name", "rule")


DOCS = View("orders", ["o_orderkey AS issue", """CASE o_orderkey % 6 WHEN 0 THEN '<journal><titleid>1</titleid><journalInfo lang="RUS"><title>t</title></journalInfo><issue><volume/><number>1</number><dateUni>1</dateUni><pages>1</pages><articles/></issue></journal>'
  WHEN 1 THEN '<journal><journalInfo/><issue><number>1</number><articles><article><pages>1</pages></article></articles></issue></journal>' WHEN 2 THEN '<book/>' WHEN 3 THEN '<journal><titleid>'
  WHEN 4 THEN '<journal><titleid>1</titleid></journal>' ELSE '<journal><titleid>1</titleid><journalInfo lang="ENG"></journalInfo><issue><volume>1</volume><number>1</number><dateUni>1</dateUni><pages>1</pages></issue></journal>' END AS xml"""])


@query("issue_structure_errors", """SELECT o_orderkey AS issue, unnest(CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['titleid', 'journalInfo.lang', 'journalInfo.title', 'issue.volume', 'issue.dateUni', 'issue.pages']
  WHEN 2 THEN ['journal'] WHEN 3 THEN ['parse'] WHEN 4 THEN ['journalInfo', 'issue'] ELSE ['journalInfo.title', 'issue.articles'] END) AS rule FROM orders""")
def issue_structure_errors(spark, sf):
    return K.issue_structure_errors(DOCS.df(spark, sf)).select("issue", "rule")


NOTES = View("orders", ["o_orderkey", """'<journal><titleid>' || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE cast(o_custkey AS string) END || '</titleid>' || CASE o_orderkey % 3 WHEN 0 THEN '<volume/>' WHEN 1 THEN '<volume> </volume>' ELSE '<volume>3</volume>' END
  || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '<number>1</number>' END || CASE WHEN o_orderkey % 2 = 0 THEN '<references></references>' ELSE '<references><reference>r</reference></references>' END || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '</journal>' END AS xml"""], wide=True)


@query("xsd_errors", """SELECT o_orderkey, f.element AS element, f.rule AS rule FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 11 = 0 THEN [{'element': 'journal', 'rule': 'parse'}]
  ELSE list_filter([CASE WHEN o_orderkey % 5 = 0 THEN {'element': 'titleid', 'rule': 'value'} END, CASE WHEN o_orderkey % 7 = 0 THEN {'element': 'number', 'rule': 'missing'} END], lambda x: x IS NOT NULL) END) AS f FROM orders) v""")
def xsd_errors(spark, sf):
    return K.xsd_errors(NOTES.df(spark, sf), os.path.join(os.path.dirname(os.path.abspath(__file__)), "order_note.xsd"))


ASKED = f"CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE {ISSUE} END"


@query("preflight", f"""WITH q AS (SELECT DISTINCT {ASKED} AS issue FROM orders), fld AS (SELECT issue, max(o_orderkey) % 3 <> 0 AS jd FROM {FSQL} GROUP BY issue HAVING max(o_orderkey) % 4 <> 0),
  fs AS (SELECT issue, count(*) AS n, count(*) FILTER (o_orderkey % 17 = 0) AS bad FROM {FSQL} WHERE o_orderkey % 5 <> 0 GROUP BY issue), k AS (SELECT DISTINCT upper(ISSN) AS i FROM {JOURNALS.sql} j)
  SELECT q.issue, CASE WHEN q.issue = '' THEN 'archive_not_selected' WHEN fld.issue IS NULL THEN 'archive_dir_missing' WHEN NOT jd THEN 'json_dir_missing' WHEN n IS NULL THEN 'json_files_missing' WHEN bad > 0 THEN 'invalid_json_files'
   WHEN regexp_extract(q.issue, '{_IK}', 1) NOT IN (SELECT i FROM k) THEN 'journal_config_not_found' ELSE 'ok' END AS code FROM q LEFT JOIN fld USING (issue) LEFT JOIN fs ON fs.issue = q.issue""")
def preflight(spark, sf):
    a = FLAT.df(spark, sf)
    asked = a.select(F.when(C("o_orderkey") % 13 == 0, F.lit("")).otherwise(C("issue")).alias("issue"))
    folders = a.groupBy("issue").agg(F.max("o_orderkey").alias("m")).where("m % 4 <> 0").selectExpr("issue", "m % 3 <> 0 AS has_json_dir")
    files = a.where("o_orderkey % 5 <> 0").selectExpr("issue", "name", "CASE WHEN o_orderkey % 17 = 0 THEN '{' ELSE '{}' END AS content")
    return K.preflight(asked, folders, files, JOURNALS.df(spark, sf))
