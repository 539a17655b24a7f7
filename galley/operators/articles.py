"""Article records: form overlay and flattening, catalogue messages, authors, references and record rules."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import extract_best_doi, normalize_date, normalize_doi, normalize_keywords, strip_orcid_url
from ..functions.text import (
    annotation_to_text,
    blank_to_null,
    col,
    let,
    norm_empty,
    norm_space,
    nz,
    sanitize_annotation,
    split_lines,
    strip,
    strip_tags,
)
from ..schemas import ARTICLE_DDL, FORM_FIELDS, FORM_LISTS
from .references import EN_HEADING, RU_HEADING, merge_doi_items, reference_key

_NONE = "array<string>"


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _list(c: Column | str) -> Column:
    return F.coalesce(col(c), F.array().cast(_NONE))


# --- form overlay -----------------------------------------------------------------------------------------------


def _items(df: DataFrame, name: str) -> Column:
    """A list field of a form: an array column or text with one item per line, placeholders dropped."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.filter(F.transform(F.col(name), norm_empty), lambda x: x != "")
    return F.filter(F.transform(split_lines(name), norm_empty), lambda x: x != "")


def _keyword_items(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return _items(df, name)
    return F.filter(F.transform(F.split(normalize_keywords(name), ";"), norm_empty), lambda x: x != "")


def apply_form(articles: DataFrame, forms: DataFrame, keys: tuple[str, ...] = ("issue", "name")) -> DataFrame:
    """Overlay of edited forms on records.

    A text field changes only when the form has it and it is not a placeholder; a marked-up abstract beats a plain
    one; keyword and reference lists replace even when empty; authors are replaced by a non-empty list only. A form
    column that is absent or null counts as not given.
    """
    edited = forms.select(*keys, *[F.col(c).alias(f"f_{c}") for c in forms.columns if c not in keys])
    df = articles.join(edited, list(keys), "left")

    def given(name: str) -> bool:
        return _has(df, f"f_{name}")

    def text(name: str, old: Column, fix=None) -> Column:
        if not given(name):
            return F.coalesce(old, F.lit(""))
        new = blank_to_null(f"f_{name}")
        return F.coalesce(fix(new) if fix else new, old, F.lit(""))

    def abstract(name: str, old: Column) -> Column:
        plain = text(name, old)
        if not given(f"{name}_html"):
            return plain
        return F.coalesce(blank_to_null(sanitize_annotation(f"f_{name}_html")), plain)

    def replaced(name: str, old: Column, items) -> Column:
        if not given(name):
            return _list(old)
        c = f"f_{name}"
        return F.when(F.col(c).isNotNull(), items(df, c)).otherwise(_list(old))

    def dated(c: Column) -> Column:
        return F.when(c.isNotNull(), normalize_date(c))

    a = F.col
    out = {
        "pages": text("pages", a("pages")),
        "artType": text("art_type", a("artType")),
        "PublLang": text("publ_lang", a("PublLang")),
        "authors": F.when(F.size(a("f_authors")) > 0, a("f_authors")).otherwise(a("authors"))
        if given("authors")
        else a("authors"),
        "artTitles": F.struct(
            text("title", a("artTitles.RUS")).alias("RUS"), text("title_en", a("artTitles.ENG")).alias("ENG")
        ),
        "abstracts": F.struct(
            abstract("annotation", a("abstracts.RUS")).alias("RUS"),
            abstract("annotation_en", a("abstracts.ENG")).alias("ENG"),
        ),
        "codes": F.struct(
            text("udc", a("codes.udk")).alias("udk"),
            text("bbk", a("codes.bbk")).alias("bbk"),
            text("doi", a("codes.doi")).alias("doi"),
            text("edn", a("codes.edn")).alias("edn"),
        ),
        "keywords": F.struct(
            replaced("keywords", a("keywords.RUS"), _keyword_items).alias("RUS"),
            replaced("keywords_en", a("keywords.ENG"), _keyword_items).alias("ENG"),
        ),
        "references": F.struct(
            replaced("references_ru", a("references.RUS"), lambda d, c: merge_doi_items(_items(d, c))).alias("RUS"),
            replaced("references_en", a("references.ENG"), lambda d, c: merge_doi_items(_items(d, c))).alias("ENG"),
        ),
        "dates": F.struct(
            text("received_date", a("dates.dateReceived"), dated).alias("dateReceived"),
            text("accepted_date", a("dates.dateAccepted"), dated).alias("dateAccepted"),
            text("date_publication", a("dates.datePublication"), dated).alias("datePublication"),
        ),
        "fundings": F.struct(
            text("funding", a("fundings.RUS")).alias("RUS"), text("funding_en", a("fundings.ENG")).alias("ENG")
        ),
        "shortMessage": F.struct(
            text("short_message", a("shortMessage.RUS")).alias("RUS"),
            text("short_message_en", a("shortMessage.ENG")).alias("ENG"),
        ),
    }
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in articles.columns])


def to_form(articles: DataFrame, keys: tuple[str, ...] = ("issue", "name")) -> DataFrame:
    """Records to the flat edit form; abstracts come as plain text and as sanitized markup."""

    def plain(c: str) -> Column:
        return F.when(nz(c).contains("<"), annotation_to_text(norm_empty(c))).otherwise(norm_empty(c))

    def marked(c: str) -> Column:
        return F.when(norm_empty(c) == "", F.lit("")).otherwise(sanitize_annotation(c))

    def joined(c: str, sep: str) -> Column:
        return F.array_join(F.filter(_list(c), lambda x: norm_empty(x) != ""), sep)

    e = norm_empty
    return articles.select(
        *keys,
        e("artTitles.RUS").alias("title"),
        e("artTitles.ENG").alias("title_en"),
        plain("abstracts.RUS").alias("annotation"),
        plain("abstracts.ENG").alias("annotation_en"),
        marked("abstracts.RUS").alias("annotation_html"),
        marked("abstracts.ENG").alias("annotation_en_html"),
        e(F.array_join(_list("keywords.RUS"), "; ")).alias("keywords"),
        e(F.array_join(_list("keywords.ENG"), "; ")).alias("keywords_en"),
        joined("references.RUS", "\n").alias("references_ru"),
        joined("references.ENG", "\n").alias("references_en"),
        e("codes.udk").alias("udc"),
        e("codes.doi").alias("doi"),
        e("codes.bbk").alias("bbk"),
        e("codes.edn").alias("edn"),
        e("dates.dateReceived").alias("received_date"),
        e("dates.dateAccepted").alias("accepted_date"),
        e("dates.datePublication").alias("date_publication"),
        e("artType").alias("art_type"),
        e("PublLang").alias("publ_lang"),
        F.col("authors"),
        e("pages").alias("pages"),
        e("fundings.RUS").alias("funding"),
        e("fundings.ENG").alias("funding_en"),
        e("shortMessage.RUS").alias("short_message"),
        e("shortMessage.ENG").alias("short_message_en"),
    )


def build_form(raw: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Browser fields to the full form: every key present, lists joined over addresses, a whole-number year.

    A year that does not parse stays in ``year_raw``. A missing list gives an empty one.
    """
    out: list[Column] = []
    for name in FORM_FIELDS:
        have = _has(raw, name)
        if name in FORM_LISTS:
            if not have:
                value = F.array().cast(_NONE)
            elif isinstance(raw.schema[name].dataType, T.ArrayType):
                value = merge_doi_items(_list(name))
            else:
                value = merge_doi_items(split_lines(name))
        elif name == "year":
            text = F.nullif(F.col(name).cast("string"), F.lit("")) if have else F.lit(None).cast("string")
            out.append(strip(text).try_cast("int").alias("year"))
            out.append(text.alias("year_raw"))
            continue
        else:
            value = F.nullif(F.col(name).cast("string"), F.lit("")) if have else F.lit(None).cast("string")
        out.append(value.alias(name))
    return raw.select(*keys, *out)


# --- catalogue messages -----------------------------------------------------------------------------------------

MESSAGE = (
    "struct<title:string,`original-title`:string,`container-title`:string,issued:string,`published-print`:string,"
    "`published-online`:string,author:string,abstract:string,reference:string>"
)


def _message(payload: Column) -> Column:
    """The message object inside an envelope, or the payload itself; nested values stay as JSON text."""
    inner = F.get_json_object(payload, "$.message")
    return F.from_json(F.when(inner.startswith("{"), inner).otherwise(payload), MESSAGE)


def _text_or_list(c: Column) -> Column:
    """First non-blank of a JSON string or list of strings."""
    listed = F.filter(F.transform(F.from_json(c, _NONE), lambda x: strip(nz(x))), lambda x: x != "")
    return F.when(c.startswith("["), F.get(listed, F.lit(0))).otherwise(blank_to_null_strip(c))


def blank_to_null_strip(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_catalog_message(df: DataFrame) -> DataFrame:
    """Catalogue responses ``(doi, payload)`` to titles, journal, year, authors, abstract and raw references."""
    m = df.withColumn("m", _message(F.col("payload")))

    def year_of(field: str) -> Column:
        parts = F.from_json(F.get_json_object(F.col(f"m.`{field}`"), "$.date-parts"), "array<array<int>>")
        return F.when(F.size(parts) > 0, F.get(F.get(parts, F.lit(0)), F.lit(0)))

    container = F.col("m.`container-title`")
    journal = F.when(container.startswith("["), F.get(F.from_json(container, _NONE), F.lit(0))).otherwise(container)
    authors = normalize_authors(F.from_json(F.col("m.author"), "array<map<string,string>>"))
    return m.select(
        *[c for c in df.columns if c != "payload"],
        _text_or_list(F.col("m.title")).alias("title"),
        _text_or_list(F.col("m.`original-title`")).alias("original_title"),
        journal.alias("journal"),
        F.coalesce(*[year_of(f) for f in ("issued", "published-print", "published-online")]).alias("year"),
        F.coalesce(authors, F.array().cast(authors_type())).alias("authors"),
        F.nullif(strip_tags(F.col("m.abstract"), ""), F.lit("")).alias("abstract"),
        F.col("m.reference").alias("reference"),
    )


def authors_type() -> str:
    return "array<struct<family:string,given:string,name:string,orcid:string,affiliation:string,sequence:string>>"


def normalize_authors(raw: Column) -> Column:
    """Author maps of any source to one struct: alternative keys, name fallback, bare ORCID, joined affiliations."""

    def field(a: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(strip(nz(F.try_element_at(a, F.lit(n)))), F.lit("")) for n in names], F.lit(""))

    def affiliation(a: Column) -> Column:
        text = strip(nz(F.try_element_at(a, F.lit("affiliation"))))
        parts = F.transform(
            F.from_json(text, _NONE),
            lambda x: strip(nz(F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))),
        )
        joined = F.array_join(F.filter(parts, lambda x: x != ""), "; ")
        single = F.when(text.startswith("{"), nz(F.get_json_object(text, "$.name"))).otherwise(text)
        return F.when(text.startswith("["), joined).otherwise(single)

    def one(a: Column) -> Column:
        family, given = field(a, "family", "surname"), field(a, "given", "initials")
        name = F.coalesce(F.nullif(field(a, "name"), F.lit("")), strip(F.concat_ws(" ", given, family)))
        return F.struct(
            family.alias("family"),
            given.alias("given"),
            name.alias("name"),
            strip_orcid_url(field(a, "orcid", "ORCID")).alias("orcid"),
            affiliation(a).alias("affiliation"),
            field(a, "sequence").alias("sequence"),
        )

    return F.transform(raw, one)


# Output columns of a catalogue reference and the key spellings that feed them.
REFERENCE_KEYS = {
    "doi": ["DOI", "doi"],
    "author": ["author"],
    "year": ["year"],
    "title": ["article-title", "article_title", "title"],
    "journal": ["journal-title", "journal_title", "journal"],
    "volume": ["volume"],
    "issue": ["issue"],
    "first_page": ["first-page", "first_page"],
    "publisher": ["publisher"],
    "isbn": ["ISBN", "isbn"],
    "issn": ["ISSN", "issn"],
    "series_title": ["series-title", "series_title"],
    "volume_title": ["volume-title", "volume_title"],
    "edition": ["edition"],
    "key": ["key"],
    "unstructured": ["unstructured"],
}
# Order of the parts in a printed reference, for the first and the second source.
PRINTED = [
    "author", "title", "journal", "series_title", "volume_title", "publisher", "edition", "volume", "issue",
    "first_page", "year", "doi", "isbn", "issn",
]
PRINTED_SHORT = ["author", "title", "journal", "year", "volume", "first_page", "doi"]


def catalog_references(df: DataFrame, reference: str = "reference") -> DataFrame:
    """JSON reference lists to one row per reference with sixteen columns."""
    maps = F.from_json(F.col(reference), "array<map<string,string>>")
    rows = df.select(*[c for c in df.columns if c != reference], F.posexplode(maps).alias("pos", "r"))
    picked = [
        F.coalesce(*[F.nullif(F.try_element_at("r", F.lit(k)), F.lit("")) for k in names]).alias(f"ref_{out}")
        for out, names in REFERENCE_KEYS.items()
    ]
    return rows.select(*[c for c in rows.columns if c != "r"], *picked)


def format_reference(parts: dict[str, Column], short: bool = False) -> Column:
    """One printed line: the unstructured text, else the non-blank parts in order."""
    whole = F.nullif(strip(nz(parts["unstructured"])), F.lit(""))
    order = PRINTED_SHORT if short else PRINTED
    line = F.concat_ws(". ", *[F.nullif(strip(nz(parts[k])), F.lit("")) for k in order if k in parts])
    return F.coalesce(whole, line)


# --- exploding records ------------------------------------------------------------------------------------------


def _by_language(articles: DataFrame, field: str, keys) -> DataFrame:
    """Lists of a language pair to rows, Russian before English, order kept."""
    pairs = F.concat(_tagged(f"{field}.RUS", "RUS"), _tagged(f"{field}.ENG", "ENG"))
    return articles.select(*keys, F.posexplode(pairs).alias("pos", "i")).select(*keys, "pos", "i.lang", "i.n", "i.text")


def _tagged(path: str, lang: str) -> Column:
    return F.transform(_list(path), lambda x, i: F.struct(F.lit(lang).alias("lang"), i.alias("n"), x.alias("text")))


def explode_article(articles: DataFrame, keys: tuple[str, ...] = ("issue", "name")) -> dict[str, DataFrame]:
    """``authors``, ``keywords``, ``references`` and ``titles`` of records, one row each."""
    authors = articles.select(*keys, F.posexplode_outer("authors").alias("pos", "a")).where("a IS NOT NULL")
    info = F.array(
        F.struct(F.lit("RUS").alias("lang"), F.col("a.individInfo.RUS").alias("info")),
        F.struct(F.lit("ENG").alias("lang"), F.col("a.individInfo.ENG").alias("info")),
    )
    authors = authors.select(
        *keys, "pos", "a.num", "a.correspondence", F.inline(F.filter(info, lambda x: x["info"].isNotNull()))
    ).select(*keys, "pos", "num", "correspondence", "lang", "info.*")
    titles = articles.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("RUS").alias("lang"), F.col("artTitles.RUS").alias("text")),
                F.struct(F.lit("ENG").alias("lang"), F.col("artTitles.ENG").alias("text")),
            )
        ),
    ).where("text IS NOT NULL")
    return {
        "authors": authors,
        "keywords": _by_language(articles, "keywords", keys),
        "references": _by_language(articles, "references", keys),
        "titles": titles,
    }


def legacy_references(raw: Column) -> Column:
    """Older layouts of a reference list, as JSON text, to ``array<struct<lang,text>>``.

    Items are strings or ``{refInfo: {lang, text}}``; the language of a bare item is ``ANY``.
    """
    any_lang = F.lit("ANY")

    def one(x: Column) -> Column:
        lang, text = F.get_json_object(x, "$.refInfo.lang"), F.get_json_object(x, "$.refInfo.text")
        return F.when(
            x.startswith("{"), F.struct(F.coalesce(lang, any_lang).alias("lang"), nz(text).alias("text"))
        ).otherwise(F.struct(any_lang.alias("lang"), x.alias("text")))

    def of(lang: str) -> Column:
        items = _list(F.from_json(F.get_json_object(raw, f"$.{lang}"), _NONE))
        return F.transform(items, lambda x: F.struct(F.lit(lang).alias("lang"), x.alias("text")))

    return F.when(strip(raw).startswith("["), F.transform(F.from_json(raw, _NONE), one)).otherwise(
        F.concat(of("RUS"), of("ENG"))
    )


CODE_TYPES = ["spin", "orcid", "scopusid", "researcherid"]


def pick_author_codes(info: Column | str) -> Column:
    """Codes of the first language that has any non-blank one; null when there is none."""
    info = col(info)

    def codes(lang: str) -> Column:
        parts = [F.nullif(strip(nz(info[lang]["authorCodes"][c])), F.lit("")).alias(c) for c in CODE_TYPES]
        s = F.struct(*parts)
        return F.when(F.coalesce(*[s[c] for c in CODE_TYPES]).isNotNull(), s)

    return F.coalesce(codes("RUS"), codes("ENG"))


def resolve_file_name(file: Column | str, pdf_url: Column | str, meta_name: Column | str) -> Column:
    """Last path part of the first filled source; null when there is none."""
    first = F.coalesce(*[F.nullif(nz(c), F.lit("")) for c in (file, pdf_url, meta_name)])
    return strip(F.regexp_extract(F.regexp_replace(first, r"[/\\]+\z", ""), r"([^/\\]*)\z", 1))


# --- model output -----------------------------------------------------------------------------------------------


def parse_model_json(c: Column | str) -> Column:
    """JSON text of a response: the whole, else the outermost braces; null when neither parses."""
    s = strip(nz(c))
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return (
        F.when(F.try_parse_json(s).isNotNull() & (s != ""), s)
        .when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)
    )


def model_references(c: Column | str) -> Column:
    """References of a response: the ``references`` key, a bare list, embedded JSON, or plain lines."""
    s = strip(nz(c))

    def listed(text: Column) -> Column:
        return F.when(strip(text).startswith("["), F.from_json(text, _NONE))

    embedded = F.regexp_extract(s, r'(?s)\{.*"references".*\}', 0)
    lines = F.filter(
        F.transform(split_lines(s), strip), lambda x: (x != "") & ~x.startswith("{") & ~x.startswith("}")
    )
    found = F.coalesce(
        listed(F.get_json_object(s, "$.references")), listed(s), listed(F.get_json_object(embedded, "$.references"))
    )
    items = F.transform(F.coalesce(found, lines), lambda x: norm_space(x))
    filled = F.filter(items, lambda x: x != "")

    def first_of_key(xs: Column) -> Column:
        return let(
            F.transform(xs, reference_key),
            lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1),
        )

    return let(filled, first_of_key)


def mark_processed(df: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("issue", "name")) -> DataFrame:
    """Sets the processed flag on saved records; others keep theirs."""
    saved = done.select(*keys).distinct().withColumn("__saved", F.lit(True))
    flag = F.coalesce("__saved", "processed", F.lit(False))
    return df.join(saved, list(keys), "left").withColumn("processed", flag).drop("__saved")


def is_processed(c: Column | str = "processed") -> Column:
    return F.coalesce(col(c), F.lit(False))


# --- record rules -----------------------------------------------------------------------------------------------


def extend_doi(current: Column | str, text: Column | str) -> Column:
    """Normalizes a record's DOI, or lengthens it when the text continues it; never invents one."""
    have, seen = normalize_doi(current), extract_best_doi(text)
    longer = seen.startswith(have) & (F.length(seen) > F.length(have))
    return F.when(have == "", nz(current)).when(longer, seen).otherwise(have)


def references_parity(articles: DataFrame, text: str = "text", keys: tuple[str, ...] = ("issue", "name")) -> DataFrame:
    """Records whose text has both reference sections but whose lists differ in length."""
    both = nz(text).rlike(RU_HEADING) & nz(text).rlike(EN_HEADING)
    ru, en = F.size(_list("references.RUS")), F.size(_list("references.ENG"))
    return articles.where(both & (ru != en)).select(*keys, ru.alias("rus"), en.alias("eng"))


# Fields that make a candidate record worth merging.
PAYLOAD_TEXT = [
    "title", "original_title", "abstract", "abstract_ru", "abstract_en", "pages", "keywords", "keywords_en",
]
PAYLOAD_LISTS = ["authors", "references", "references_ru", "references_en"]


def empty_payloads(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, empty)`` candidates; empty ones are reported, not merged."""
    filled = F.lit(False)
    for c in PAYLOAD_TEXT:
        if _has(cands, c):
            filled = filled | (norm_empty(c) != "")
    for c in PAYLOAD_LISTS:
        if _has(cands, c):
            is_list = isinstance(cands.schema[c].dataType, T.ArrayType)
            filled = filled | (F.coalesce(F.size(c), F.lit(0)) > 0 if is_list else norm_empty(c) != "")
    return cands.where(filled), cands.where(~filled)


def _unknown(value, kind: T.DataType):
    """What the type has no place for; null when there is nothing. Items of a list keep their ``num``, if all have their own."""
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        types = {f.name: f.dataType for f in kind.fields if f.name != "extras"}
        rest = {k: _unknown(v, types[k]) if k in types else v for k, v in value.items()}
        return {k: v for k, v in rest.items() if k not in types or v is not None} or None
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        items = [_unknown(v, kind.elementType) for v in value]
        if not any(i is not None for i in items):
            return None
        if _numbered(value):
            items = [(i or {}) | {"num": v["num"]} for v, i in zip(value, items)]
        return items
    return None


def _numbered(items: list) -> bool:
    """Whether the items are objects that each have a ``num`` of their own."""
    nums = [i.get("num") if isinstance(i, dict) else None for i in items]
    return all(isinstance(n, str) and n for n in nums) and len(set(nums)) == len(nums)


def _with_unknown(known, rest):
    """Puts what :func:`_unknown` found back; values that are there stay."""
    if isinstance(known, dict) and isinstance(rest, dict):
        return known | {k: _with_unknown(known[k], v) if k in known else v for k, v in rest.items()}
    if isinstance(known, list) and isinstance(rest, list) and rest and _numbered(rest) and all(isinstance(k, dict) for k in known):
        by_num = {r["num"]: r for r in rest}
        return [_with_unknown(k, by_num[k["num"]]) if k.get("num") in by_num else k for k in known]
    if isinstance(known, list) and isinstance(rest, list):
        return [_with_unknown(k, rest[i]) if i < len(rest) else k for i, k in enumerate(known)]
    return known


def article_extras(c: Column | str) -> Column:
    """The keys of a record that the fixed struct does not have, at any depth, as JSON text; null if there are none."""
    kind = T._parse_datatype_string(ARTICLE_DDL)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                rest = _unknown(json.loads(text), kind)
            except ValueError:
                rest = None
            out.append(None if rest is None else json.dumps(rest, ensure_ascii=False))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(nz(c))


def article_to_json(record: Column, extras: Column | str) -> Column:
    """A record as JSON text with the keys of ``extras`` in their places; list items meet by ``num``, else by position."""

    def run(texts: pa.Array, more: pa.Array) -> pa.Array:
        out = [
            t if m is None else json.dumps(_with_unknown(json.loads(t), json.loads(m)), ensure_ascii=False)
            for t, m in zip(texts.to_pylist(), more.to_pylist())
        ]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.to_json(record), F.col(extras) if isinstance(extras, str) else extras)


def article_from_json(c: Column | str) -> Column:
    """Record text to the fixed struct with other keys in ``extras``; null for text that is not an object."""
    parsed = F.from_json(nz(c), ARTICLE_DDL).withField("extras", article_extras(c))
    return F.when(strip(nz(c)).startswith("{"), parsed)

