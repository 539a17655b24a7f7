"""Web pages and article XML to metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import (
    parse_pages_meta,
    normalize_keywords,
    optional_positive_int,
    format_pages,
    resolve_url,
    rstrip_chars,
    split_keywords,
    split_person_name,
    strip_orcid_url,
)
from ..functions.nodes import (
    attr,
    children,
    first,
    first_text,
    has_class,
    has_text,
    heading_block,
    meta_first,
    meta_pairs,
    meta_values,
    section_text as node_section,
    text_of,
    with_headings,
    with_nodes,
    within,
)
from ..functions.text import (
    decode_entities,
    has_cyrillic,
    let,
    norm_space,
    nz,
    pattern_spans,
    strip,
    strip_tags,
)
from .references import split_references

# --- blocks -----------------------------------------------------------------------------------------------------

# The block patterns of a page; each is scanned on its own, so they may overlap.
BLOCKS = {
    "table": r"<table[^>]*>(.*?)</table>",
    "li": r"<li[^>]*>(.*?)</li>",
    "p": r"<p[^>]*>(.*?)</p>",
    "h": r"<h[1-6][^>]*>(.*?)</h[1-6]>",
    "div": r"<div[^>]*>(.*?)</div>",
}
_spans = pattern_spans(BLOCKS, 18)  # ignore case, dot matches newline


def block_text(c: Column) -> Column:
    s = decode_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    return norm_space(F.replace(s, F.lit("\u00ad"), F.lit("")))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Block elements in document order: ``(key, pos, block_type, html, text)``.

    Table rows join their cells; a paragraph with list items and a division with blocks inside are left to those;
    nothing inside a table counts twice. A paragraph inside a list item appears as both.
    """
    df = pages.select(key, _spans(html).alias("s"))
    tables = F.filter("s", lambda x: x["kind"] == "table")

    def free(x: Column) -> Column:
        return ~F.exists(tables, lambda t: (t["start"] <= x["start"]) & (x["start"] < t["end"]))

    def content(x: Column) -> Column:
        return F.regexp_replace(x["text"], r"(?is)\A<[^>]*>|</[^>]*>\z", "")

    plain = F.filter(
        "s",
        lambda x: (x["kind"] != "table")
        & free(x)
        & ~((x["kind"] == "p") & content(x).rlike(r"(?i)<li[^>]*>"))
        & ~((x["kind"] == "div") & content(x).rlike(r"(?i)<(?:p|ul|ol|li|h[1-6])[^>]*>")),
    )
    others = F.transform(
        plain,
        lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("row"), x["kind"].alias("block_type"), content(x).alias("html")),
    )
    rows = F.flatten(
        F.transform(
            tables,
            lambda t: F.transform(
                F.regexp_extract_all(t["text"], F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0)),
                lambda r, i: F.struct(t["start"].alias("at"), i.alias("row"), F.lit("table-row").alias("block_type"), r.alias("html")),
            ),
        )
    )
    # Cells are parted by a mark that survives tag removal, so a row is cleaned once and not cell by cell.
    mark = "\ue000"

    def cleaned(x: Column) -> Column:
        row = x["block_type"] == "table-row"

        def joined(text: Column) -> Column:
            cells = F.split(text, mark)
            filled = F.filter(F.transform(F.slice(cells, F.lit(2), F.size(cells)), strip), lambda c: c != "")
            return F.when(row, F.array_join(filled, " | ")).otherwise(text)

        marked = F.when(row, F.regexp_replace(x["html"], r"(?i)<t[hd][^>]*>", mark)).otherwise(x["html"])
        return F.struct(x["block_type"].alias("block_type"), x["html"].alias("html"), let(block_text(marked), joined).alias("text"))

    blocks = F.filter(F.transform(F.array_sort(F.concat(others, rows)), cleaned), lambda x: x["text"] != "")
    return df.select(key, F.posexplode(blocks).alias("i", "b")).select(key, (F.col("i") + 1).alias("pos"), "b.block_type", "b.html", "b.text")


# --- tags and embedded data -------------------------------------------------------------------------------------


def meta_tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Meta elements as ``(key, name, value, n)``, from the node list: comments and odd quoting are the parser's work."""
    metas = F.filter("nodes", lambda x: x["tag"] == "meta")
    df = with_nodes(pages.select(key, html), html).select(key, F.posexplode(metas).alias("n", "tag"))

    def value(name: str) -> Column:
        return F.nullif(nz(F.col("tag.attrs")[name]), F.lit(""))

    name = F.lower(norm_space(F.coalesce(*[value(a) for a in ("name", "property", "itemprop", "http-equiv")])))
    df = df.select(key, "n", name.alias("name"), norm_space(nz(value("content"))).alias("value"))
    return df.where("value <> '' AND name <> ''")


# Node types that describe an article.
ARTICLE_TYPES = ["article", "scholarlyarticle", "creativework", "newsarticle"]


def _ld_nodes(docs: Column) -> Column:
    """Objects of embedded data in reading order: lists and ``@graph`` members unfolded, at any depth.

    A step unfolds every open item by one level, and steps do nothing once no item is open; a text cannot nest deeper
    than it has opening brackets.
    """
    texts = F.array().cast("array<string>")
    items = "array<struct<text:string,done:boolean>>"

    def open_items(found: Column) -> Column:
        return F.transform(F.coalesce(found, texts), lambda t: F.struct(strip(nz(t)).alias("text"), F.lit(False).alias("done")))

    def unfold(item: Column) -> Column:
        t = item["text"]
        graph = F.get_json_object(t, "$['@graph']")
        members = F.when(graph.startswith("["), F.from_json(graph, "array<string>"))
        own = F.array(F.struct(t.alias("text"), F.lit(True).alias("done")))
        return (
            F.when(item["done"], F.array(item))
            .when(t.startswith("["), open_items(F.from_json(t, "array<string>")))
            .otherwise(F.concat(own, open_items(members)))
        )

    def state(found: Column) -> Column:
        return F.struct(found.alias("items"), F.exists(found, lambda x: ~x["done"]).alias("open"))

    def step(was: Column, _: Column) -> Column:
        return F.when(was["open"], let(F.flatten(F.transform(was["items"], unfold)).cast(items), state)).otherwise(was)

    def unfolded(doc: Column) -> Column:
        levels = F.sequence(F.lit(0), F.length(doc) - F.length(F.replace(doc, F.lit("["), F.lit(""))) + 1)
        return F.aggregate(levels, state(open_items(F.array(doc)).cast(items)), step, lambda was: F.transform(was["items"], lambda x: x["text"]))

    return F.flatten(F.transform(docs, lambda d: unfolded(nz(d))))


def embedded_article(html: Column | str) -> Column:
    """First embedded node that describes an article, as JSON text; null without one."""
    scripts = F.regexp_extract_all(
        nz(html), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"'][^\"'>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1)
    )
    valid = F.filter(scripts, lambda s: F.try_parse_json(strip(s)).isNotNull())

    def is_article(n: Column) -> Column:
        raw = F.get_json_object(n, "$['@type']")
        types = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        return F.exists(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.lower(norm_space(t)).isin(ARTICLE_TYPES))

    return first(F.filter(_ld_nodes(valid), lambda n: n.startswith("{") & is_article(n)))


def json_ld_article(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with an embedded article: ``(key, node)``; pages without one are absent."""
    return pages.select(key, F.explode(F.array_compact(F.array(embedded_article(html)))).alias("node"))


# --- article XML ------------------------------------------------------------------------------------------------


def _xml_text(c: Column) -> Column:
    bare = norm_space(F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]+>", " "))
    return F.translate(bare, "\ue010\ue011", "<>")


def _elements(xml: Column, tags: str) -> Column:
    """``struct(tag, lang, text)`` of the named elements in document order."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?(?:{tags})(?:\s[^>]*)?>.*?</(?:\w+:)?(?:{tags})\s*>"), F.lit(0))
    return F.transform(
        found,
        lambda e: F.struct(
            F.regexp_extract(e, r"\A<(?:\w+:)?([\w-]+)", 1).alias("tag"),
            F.lower(norm_space(F.regexp_extract(e, r"\A<[^>]*\bxml:lang\s*=\s*[\"']([^\"']*)", 1))).alias("lang"),
            _xml_text(e).alias("text"),
        ),
    )


def jats_metadata(docs: DataFrame, key: str = "url", xml: str = "xml") -> DataFrame:
    """Article XML to titles, abstracts and references by language; undeclared languages are told by script.

    Escaped angle brackets are set aside while tags are read, and are characters of the text in the end. Text that is
    not well-formed gives a row of empty fields with ``error`` set.
    """
    bare = F.regexp_replace(nz(xml), r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>", "")
    broken = F.coalesce(F.from_xml(bare, "_corrupt_record string")["_corrupt_record"].isNotNull(), F.lit(False)) & (strip(bare) != "")
    marked = F.regexp_replace(nz(xml), r"(?i)&(?:lt|#0*60|#x0*3c);", "\ue010")
    marked = F.regexp_replace(marked, r"(?i)&(?:gt|#0*62|#x0*3e);", "\ue011")
    df = docs.select(key, broken.alias("error"), decode_entities(F.when(broken, F.lit("")).otherwise(marked)).alias("__x"))
    x = F.col("__x")
    empty = F.struct(F.lit("").alias("en"), F.lit("").alias("ru"))

    def fold(items: Column, rule) -> Column:
        return F.aggregate(items, empty, rule)

    def put(acc: Column, side: str, value: Column) -> Column:
        return F.struct(
            (value if side == "en" else acc["en"]).alias("en"), (value if side == "ru" else acc["ru"]).alias("ru")
        )

    def title_rule(acc: Column, e: Column) -> Column:
        ru, en, t = e["lang"].startswith("ru"), e["lang"].startswith("en"), e["text"]
        main = e["tag"] == "article-title"
        guess = main & ~ru & ~en
        to_ru = (acc["ru"] == "") & (ru | (guess & has_cyrillic(t)))
        to_en = (acc["en"] == "") & (en | (guess & ~to_ru))
        return F.when(t == "", acc).when(to_ru, put(acc, "ru", t)).when(to_en, put(acc, "en", t)).otherwise(acc)

    def abstract_rule(acc: Column, e: Column) -> Column:
        t, none = e["text"], e["lang"] == ""
        cyr = has_cyrillic(t)
        to_ru = (acc["ru"] == "") & (e["lang"].startswith("ru") | (none & cyr))
        to_en = (acc["en"] == "") & (e["lang"].startswith("en") | (none & ~cyr))
        return F.when(t == "", acc).when(to_ru, put(acc, "ru", t)).when(to_en, put(acc, "en", t)).otherwise(acc)

    titles = fold(_elements(x, "article-title|trans-title"), title_rule)
    abstracts = fold(_elements(x, "abstract|trans-abstract"), abstract_rule)
    ref_list = F.regexp_extract(x, r"(?s)<(?:\w+:)?ref-list(?:\s[^>]*)?>.*?</(?:\w+:)?ref-list\s*>", 0)
    refs = F.regexp_extract_all(ref_list, F.lit(r"(?s)<(?:\w+:)?ref(?:\s[^>]*)?>.*?</(?:\w+:)?ref\s*>"), F.lit(0))

    def one(r: Column) -> Column:
        cites = F.filter(_elements(r, "mixed-citation|element-citation"), lambda e: e["text"] != "")

        def of(lang: str) -> Column:
            mixed = F.filter(cites, lambda e: (e["tag"] == "mixed-citation") & e["lang"].startswith(lang))
            return F.transform(mixed, lambda e: e["text"])

        return F.struct(
            of("ru").alias("ru"), of("en").alias("en"), F.coalesce(first(cites)["text"], _xml_text(r)).alias("any")
        )

    df = df.select(key, "error", titles.alias("t"), abstracts.alias("a"), F.transform(refs, one).alias("r"))
    ru = F.flatten(F.transform("r", lambda e: e["ru"]))
    en = F.flatten(F.transform("r", lambda e: e["en"]))
    anyway = F.filter(F.transform("r", lambda e: e["any"]), lambda t: t != "")
    return df.select(
        key,
        F.col("t.en").alias("title"),
        F.col("t.ru").alias("original_title"),
        F.when(F.col("a.en") != "", F.col("a.en")).otherwise(F.col("a.ru")).alias("abstract"),
        F.col("a.ru").alias("abstract_ru"),
        F.col("a.en").alias("abstract_en"),
        ru.alias("references_ru"),
        en.alias("references_en"),
        anyway.alias("__any"),
        "error",
    ).select(
        key, "title", "original_title", "abstract", "abstract_ru", "abstract_en",
        F.when(F.size("references_en") > 0, F.col("references_en"))
        .when(F.size("references_ru") > 0, F.col("references_ru"))
        .otherwise(F.col("__any")).alias("references"),
        "references_ru", "references_en", "error",
    )


# --- pages of the publication system ----------------------------------------------------------------------------

# Captions, labels and headings of the publication pages.
EN_CAPTION, RU_CAPTION = r"ENG|\AEN\z", r"РУС|RUS|\ARU\z"
FIRST_PAGE, LAST_PAGE = "Первая страница", "Последняя страница"
KEYWORD_LABEL = r"(?iuU)ключев(?:ые\s+слова|ое\s+слово)|keywords?|key\s+words|index\s+terms?"
REFERENCE_LABEL = r"(?iu)Список литературы|Литература|References"
DETAIL_HEADINGS = {
    "abstract_ru": ["Аннотация", "Аннотация (рус)", "Резюме"],
    "abstract_en": ["Abstract", "Аннотация (англ)", "Summary", "Аннотация на английском"],
    "references": ["Список литературы", "Литература", "References", "Библиографический список"],
    "keywords_ru": ["Ключевые слова", "Ключевые слова (рус)", "Ключевые слова (русский)", "Ключевые слова (RU)"],
    "keywords_en": ["Keywords", "Keyword", "Key words", "Ключевые слова (англ)", "Ключевые слова (английский)",
                    "Ключевые слова (EN)", "Index terms"],
}


def _captioned(nodes: Column, blocks: Column) -> Column:
    """``struct(lang, text)`` of language blocks: the caption tells the language and is cut off the text."""

    def one(b: Column) -> Column:
        cap = first_text(children(nodes, b, lambda n: has_class(n, "lang_caption")))

        def cut(x: Column) -> Column:
            whole, up = x["whole"], F.upper(nz(x["cap"]))
            lang = F.when(up.rlike(EN_CAPTION), F.lit("en")).when(up.rlike(RU_CAPTION), F.lit("ru"))
            text = F.when(F.upper(whole).startswith(up), strip(F.substr(whole, F.length(nz(x["cap"])) + 1, F.length(whole)))).otherwise(whole)
            return F.struct(F.when(x["cap"].isNotNull(), lang).alias("lang"), text.alias("text"))

        return let(F.struct(text_of(b).alias("whole"), cap.alias("cap")), cut)

    return F.filter(F.transform(blocks, one), lambda x: x["lang"].isNotNull() & (x["text"] != ""))


def _of(items: Column, lang: str) -> Column:
    return F.transform(F.filter(items, lambda x: x["lang"] == lang), lambda x: x["text"])


def detail_page_metadata(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Publication pages: titles and abstracts from language blocks, page numbers, keywords and references from
    labelled table rows, headings where those are missing."""
    df = with_headings(with_nodes(pages, html).select(key, "nodes", "texts"))
    n = F.col("nodes")
    df = df.withColumn("ml", _captioned(n, F.filter("nodes", lambda x: has_class(x, "multilang"))))

    def row(r: Column) -> Column:
        def body(kids: Column) -> Column:
            cells = F.filter(kids, lambda x: x["tag"] == "td")
            text = F.array_join(F.transform(F.filter(cells, has_text), text_of), " ")
            return F.struct(
                r["ord"].alias("ord"),
                nz(first_text(F.filter(kids, lambda x: x["tag"] == "th"))).alias("label"),
                text.alias("cell"),
                F.exists(cells, lambda x: has_class(x, "multilang")).alias("marked"),
                _captioned(n, F.filter(cells, lambda x: has_class(x, "multilang"))).alias("listed"),
            )

        return let(within(n, r), body)

    def table_of(test) -> Column:
        """Extent of the first table that passes."""
        hit = first(F.filter(n, lambda x: (x["tag"] == "table") & test(x)))
        return F.struct(hit["ord"].alias("ord"), hit["close"].alias("close"))

    def titled(x: Column) -> Column:
        return F.exists(within(n, x), lambda y: (y["tag"] == "th") & text_of(y).rlike(REFERENCE_LABEL))

    df = df.withColumns(
        {
            "rows": F.transform(F.filter(n, lambda x: x["tag"] == "tr"), row),
            "data": table_of(lambda x: attr(x, "id") == "dataTable_pubdata"),
            "named": table_of(lambda x: attr(x, "id") == "dataTable_refs"),
            "titled": table_of(titled),
        }
    )
    refs = F.when(F.col("named.ord").isNotNull(), F.col("named")).otherwise(F.col("titled"))

    def page_of(text: str) -> Column:
        def hit(r: Column) -> Column:
            return (r["ord"] > F.col("data.ord")) & (r["ord"] <= F.col("data.close")) & (r["label"] == text)

        return optional_positive_int(_last(F.filter("rows", hit))["cell"])

    def keyword_row(r: Column) -> Column:
        usable = ~r["cell"].isin("", "—", "–", "-") & ~r["marked"]
        cyr = has_cyrillic(r["cell"])
        return F.struct(
            F.coalesce(_last(_of(r["listed"], "ru")), F.when(usable & cyr, r["cell"]), F.lit("")).alias("ru"),
            F.coalesce(_last(_of(r["listed"], "en")), F.when(usable & ~cyr, r["cell"]), F.lit("")).alias("en"),
        )

    labelled = F.transform(F.filter("rows", lambda r: r["label"].rlike(KEYWORD_LABEL)), keyword_row)
    found = first(F.filter(labelled, lambda k: (k["ru"] != "") | (k["en"] != "")))
    df = df.withColumn("refs", refs)

    def of_references(r: Column) -> Column:
        fits = (r["label"] == "") | r["label"].rlike(REFERENCE_LABEL)
        return (r["ord"] > F.col("refs.ord")) & (r["ord"] <= F.col("refs.close")) & fits & (F.size(r["listed"]) > 0)

    df = df.withColumns(
        {
            "k": found,
            "f": page_of(FIRST_PAGE),
            "l": page_of(LAST_PAGE),
            "rr": first(F.filter("rows", of_references))["listed"],
        }
    )

    def pick(lang: str, i: int) -> Column:
        return nz(F.get(_of(F.col("ml"), lang), F.lit(i)))

    def else_heading(value: Column, name: str) -> Column:
        return F.when(value != "", value).otherwise(heading_block(DETAIL_HEADINGS[name]))

    references_ru = nz(_last(_of(F.col("rr"), "ru")))
    return df.select(
        key,
        pick("ru", 0).alias("title_ru"),
        pick("en", 0).alias("title_en"),
        else_heading(pick("ru", 1), "abstract_ru").alias("abstract_ru"),
        else_heading(pick("en", 1), "abstract_en").alias("abstract_en"),
        normalize_keywords(else_heading(nz("k.ru"), "keywords_ru")).alias("keywords_ru"),
        normalize_keywords(else_heading(nz("k.en"), "keywords_en")).alias("keywords_en"),
        F.when(references_ru != "", references_ru)
        .otherwise(heading_block(DETAIL_HEADINGS["references"], items=True))
        .alias("references_ru"),
        nz(_last(_of(F.col("rr"), "en"))).alias("references_en"),
        F.col("f").alias("first_page"),
        F.col("l").alias("last_page"),
        format_pages("f", "l").alias("pages"),
    )


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def publication_links(pages: DataFrame, base_url: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links to publications ``(key, pos, url, title)``: the styled ones, else any with an identifier, distinct."""
    df = with_nodes(pages, html).select(key, "nodes", "texts")
    links = F.filter("nodes", lambda x: (x["tag"] == "a") & (attr(x, "href") != ""))
    href = lambda x: attr(x, "href")
    styled = F.filter(
        links,
        lambda x: has_class(x, "text-primary")
        & has_class(x, "font-weight-bold")
        & href(x).contains("/publications/")
        & ~rstrip_chars(href(x), "/").endswith("/publications"),
    )
    any_id = F.filter(links, lambda x: href(x).rlike(r"(?i)/publications/[a-f0-9-]{36}"))

    def row(x: Column) -> Column:
        full = F.when(href(x).startswith("http"), href(x)).otherwise(F.concat(F.lit(base_url.rstrip("/")), href(x)))
        return F.struct(full.alias("url"), text_of(x).alias("title"))

    def distinct(rows: Column) -> Column:
        urls = F.transform(rows, lambda r: r["url"])
        return let(urls, lambda us: F.filter(rows, lambda r, i: F.array_position(us, r["url"]) == i + 1))

    chosen = F.when(F.size(styled) > 0, F.transform(styled, row)).otherwise(distinct(F.transform(any_id, row)))
    return df.select(key, F.posexplode(chosen).alias("pos", "l")).select(key, "pos", "l.url", "l.title")


# --- journal sites ----------------------------------------------------------------------------------------------


def section_text(pages: DataFrame, headings: list[str], sep: str = " ", key: str = "page_id", html: str = "html") -> DataFrame:
    """Section of every page under one of the headings; empty where there is none."""
    return with_headings(with_nodes(pages, html)).select(key, node_section(headings, sep).alias("text"))


# Meta names, section headings and classes of journal pages.
SITE_SECTIONS = {
    "abstract_ru": ["аннотация", "резюме"],
    "abstract_en": ["abstract", "summary"],
    "keywords_ru": ["ключевые слова", "ключевые слова и словосочетания"],
    "keywords_en": ["keywords", "key words"],
    "references_ru": ["список литературы", "литература", "библиография", "источники"],
    "references_en": ["references", "bibliography"],
}
TITLE_EN_CLASSES = ["title.*en", "article-title.*en", "trans-title", "title-translate"]
ABSTRACT_EN_CLASSES = ["abstract.*en", "article-abstract.*en", "trans-abstract"]


def _by_class(nodes: Column, patterns: list[str], lang: str) -> Column:
    """First text of an element whose class matches a pattern and whose declared language is not another one."""

    def one(nodes: Column, p: str) -> Column:
        def fits(n: Column) -> Column:
            own = F.lower(norm_space(F.when(attr(n, "lang") != "", attr(n, "lang")).otherwise(attr(n, "xml:lang"))))
            return attr(n, "class").rlike("(?i)" + p) & ((own == "") | own.startswith(lang))

        return first_text(F.filter(nodes, fits))

    # Every pattern has characters, so elements without a class are passed over once for all of them.
    classed = F.filter(nodes, lambda n: (attr(n, "class") != "") & has_text(n))
    return let(classed, lambda ns: F.coalesce(*[one(ns, p) for p in patterns], F.lit("")))


def page_authors(metas: Column, article: Column) -> Column:
    """Authors of a page: names zipped with affiliations and ORCIDs by position, else the embedded article's."""
    names = meta_values(metas, "citation_author", "dc.creator", "author")
    affs = meta_values(metas, "citation_author_institution", "citation_author_affiliation")
    orcids = meta_values(metas, "citation_author_orcid")

    def person(name: Column, family: Column, given: Column, aff: Column, orcid: Column) -> Column:
        return F.struct(
            family.alias("family"), given.alias("given"), name.alias("name"), nz(aff).alias("affiliation"), strip_orcid_url(orcid).alias("orcid")
        )

    def zipped(x: Column, i: Column) -> Column:
        p = split_person_name(x)
        return person(norm_space(x), p["family"], p["given"], F.get(affs, i), F.get(orcids, i))

    raw = F.get_json_object(article, "$.author")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))

    def embedded(a: Column) -> Column:
        def field(n: str) -> Column:
            return norm_space(F.get_json_object(a, f"$.{n}"))

        obj = a.startswith("{")
        name = F.when(obj, field("name")).otherwise(norm_space(a))
        guess = split_person_name(name)
        own = obj & (field("familyName") != "")
        family = F.when(own, field("familyName")).otherwise(guess["family"])
        given = F.when(own, field("givenName")).otherwise(guess["given"])
        aff = F.get_json_object(a, "$.affiliation")
        many = F.array_join(
            F.filter(
                F.transform(F.from_json(aff, "array<string>"), lambda v: norm_space(F.when(v.startswith("{"), F.get_json_object(v, "$.name")).otherwise(v))),
                lambda v: v != "",
            ),
            "; ",
        )
        text = F.when(aff.startswith("["), many).when(aff.startswith("{"), norm_space(F.get_json_object(aff, "$.name"))).otherwise(norm_space(aff))
        ident = F.when(field("identifier") != "", field("identifier")).otherwise(field("orcid"))
        full = F.when(name != "", name).otherwise(strip(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(family, F.lit("")))))
        return person(full, family, given, F.when(obj, text), F.when(obj, ident))

    from_meta = F.transform(names, zipped)
    from_data = F.filter(F.transform(listed, embedded), lambda a: a["name"].isNotNull())
    empty = F.array().cast("array<struct<family:string,given:string,name:string,affiliation:string,orcid:string>>")
    return F.when(F.size(names) > 0, from_meta).when(raw.isNotNull(), from_data).otherwise(empty)


def page_metadata(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Metadata of journal pages with the precedence of sources; the script decides which language a text is."""
    df = with_nodes(pages.select(key, url, html, embedded_article(html).alias("ld")), html).drop(html)
    df = with_headings(df).withColumn("metas", meta_pairs(F.col("nodes")))
    n, ld, m = F.col("nodes"), F.col("ld"), F.col("metas")

    def ld_text(name: str) -> Column:
        value = F.get_json_object(ld, f"$.{name}")
        listed = F.filter(F.transform(F.from_json(value, "array<string>"), norm_space), lambda x: x != "")
        return F.when(value.startswith("["), nz(first(listed))).otherwise(norm_space(value))

    def pick(*options: Column) -> Column:
        # Bound, because ``nullif`` would make a text once to look and once to give.
        return F.coalesce(*[let(norm_space(o), lambda t: F.when(t != "", t)) for o in options], F.lit(""))

    def tag_text(tag: str) -> Column:
        return nz(first_text(F.filter(n, lambda x: x["tag"] == tag)))

    bib = F.coalesce(
        first(F.filter(n, lambda x: attr(x, "id") == "articleBibliography")),
        first(F.filter(n, lambda x: has_class(x, "article-bibliography"))),
    )
    items = F.transform(children(n, bib, lambda x: (x["tag"] == "li") & has_text(x)), text_of)
    bib_head = F.lower(nz(first_text(children(n, bib, lambda x: x["tag"].isin("h1", "h2", "h3", "h4")))))
    en_page = F.lower(F.regexp_extract(nz(url), r"\?([^#]*)", 1)).contains("sl=en")
    raw_title = pick(
        meta_first(m, "citation_title"), ld_text("headline"), ld_text("name"), meta_first(m, "og:title", "twitter:title", "dc.title"), tag_text("title"), tag_text("h1")
    )
    df = df.withColumns(
        {
            "raw_title": strip(F.regexp_replace(raw_title, r"(?U)\s*[|¦]\s*[^|¦]+\z", "")),
            "raw_abstract": pick(meta_first(m, "citation_abstract", "description", "og:description", "dc.description"), ld_text("description")),
            "title_en_html": pick(meta_first(m, "citation_title_en"), _by_class(n, TITLE_EN_CLASSES, "en")),
            "abs_ru": node_section(SITE_SECTIONS["abstract_ru"]),
            "abs_en": pick(node_section(SITE_SECTIONS["abstract_en"]), _by_class(n, ABSTRACT_EN_CLASSES, "en")),
            "kw_meta": meta_first(m, "citation_keywords", "keywords", "news_keywords"),
            "kw_ru": node_section(SITE_SECTIONS["keywords_ru"]),
            "kw_en": node_section(SITE_SECTIONS["keywords_en"]),
            "bib": items,
            "bib_en": bib_head.contains("references") | en_page,
            "ref_ru": split_references(node_section(SITE_SECTIONS["references_ru"], "\n")),
            "ref_en": split_references(node_section(SITE_SECTIONS["references_en"], "\n")),
            "ref_meta": meta_values(m, "citation_reference"),
            "pages": parse_pages_meta(meta_first(m, "citation_firstpage"), meta_first(m, "citation_lastpage"), meta_first(m, "citation_pages")),
            "doi": pick(meta_first(m, "citation_doi"), meta_first(m, "dc.identifier"), ld_text("identifier")),
            "authors": page_authors(m, ld),
        }
    ).drop("nodes", "texts", "heads", "ld", "metas")
    c = F.col
    df = df.withColumn("raw_abstract", strip_tags("raw_abstract")).withColumn(
        "doi", strip(F.regexp_replace("doi", r"(?iU)\A(?:doi:\s*|https?://doi\.org/)", ""))
    )
    found_doi = F.regexp_extract("doi", r"(?iU)10\.\d{4,9}/\S+", 0)
    cyr = has_cyrillic("raw_abstract")
    empty = F.array().cast("array<string>")
    used = F.size("bib") > 0
    df = df.withColumns(
        {
            "abstract_ru": F.when(c("abs_ru") != "", c("abs_ru")).when(cyr, c("raw_abstract")).otherwise(""),
            "abstract_en": F.when(c("abs_en") != "", c("abs_en")).when(~cyr, c("raw_abstract")).otherwise(""),
            "references_ru": F.when(used, F.when(c("bib_en"), empty).otherwise(c("bib"))).otherwise(c("ref_ru")),
            "references_en": F.when(used, F.when(c("bib_en"), c("bib")).otherwise(empty)).otherwise(c("ref_en")),
            "kw_ru": F.when(c("kw_ru") != "", c("kw_ru")).when(has_cyrillic("kw_meta"), c("kw_meta")).otherwise(""),
            "kw_en": F.when(c("kw_en") != "", c("kw_en")).when(~has_cyrillic("kw_meta"), c("kw_meta")).otherwise(""),
        }
    )
    title_cyr = has_cyrillic("raw_title")
    title = F.when(~title_cyr, c("raw_title")).otherwise("")
    return df.select(
        key,
        F.when(found_doi != "", rstrip_chars(found_doi, ").,;")).otherwise(c("doi")).alias("doi"),
        F.when(title != "", title).otherwise(c("title_en_html")).alias("title"),
        F.when(title_cyr, c("raw_title")).otherwise("").alias("original_title"),
        F.coalesce(*[F.nullif(c(x), F.lit("")) for x in ("abstract_en", "abstract_ru", "raw_abstract")], F.lit("")).alias("abstract"),
        "abstract_ru",
        "abstract_en",
        split_keywords("kw_ru").alias("keywords"),
        split_keywords("kw_en").alias("keywords_en"),
        F.when(F.size("references_en") > 0, c("references_en"))
        .when(F.size("references_ru") > 0, c("references_ru"))
        .otherwise(F.filter(F.transform("ref_meta", lambda x: norm_space(F.regexp_replace(x, r"<[^>]+>", " "))), lambda x: x != ""))
        .alias("references"),
        "references_ru",
        "references_en",
        "pages",
        "authors",
        F.col(url).alias("source_url"),
    )


def jats_link(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Address of a page's article XML: a link that says so, else an alternate link, else a meta element."""
    links = F.filter("nodes", lambda x: (x["tag"] == "a") & F.map_contains_key(x["attrs"], "href"))
    direct = first(F.filter(links, lambda x: F.lower(attr(x, "href")).contains("jats") | F.lower(text_of(x)).contains("jats")))
    alternate = first(
        F.filter(
            "nodes",
            lambda x: (x["tag"] == "link") & (attr(x, "href") != "") & F.lower(attr(x, "type")).contains("xml") & F.lower(attr(x, "title")).contains("jats"),
        )
    )
    meta = first(F.filter("nodes", lambda x: (x["tag"] == "meta") & attr(x, "name").rlike("(?i)citation_xml_url") & (attr(x, "content") != "")))
    sources = [(direct, "href"), (alternate, "href"), (meta, "content")]
    href = F.coalesce(*[F.try_element_at(node["attrs"], F.lit(a)) for node, a in sources])
    # Through a generator, so the presence test is not pushed below and computed twice.
    found = F.explode(F.array_compact(F.array(href))).alias("href")
    return with_nodes(pages, html).select(key, url, found).select(key, resolve_url(url, "href").alias("jats_url"))


# Paths a site search may list that are no articles, and points for the title agreement.
SKIP_PATHS = ["/wp-content/", "/tag/", "/category/", "/author/", "/feed"]
LINK_POINTS = {"equal": 5, "inside": 4, "around": 2, "dated": 1}


def rank_search_links(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url", title: str = "title", k: int = 5) -> DataFrame:
    """Best links of a search page ``(key, rank, url, score)`` for a wanted title; ``k`` is the size of the report."""
    df = with_nodes(pages, html).select(key, base, F.lower(norm_space(title)).alias("__t"), "nodes", "texts")

    def host(c: Column | str) -> Column:
        return F.lower(F.regexp_extract(c, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))

    t = F.col("__t")

    def points(test: Column, name: str) -> Column:
        return F.when(test, F.lit(LINK_POINTS[name])).otherwise(F.lit(0))

    def scored(x: Column) -> Column:
        """Address and score of a link; score 0 for one that is not taken."""
        low = F.lower(x["anchor"])
        path = F.lower(F.regexp_extract(x["url"], r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
        skip = F.lit(False)
        for s in SKIP_PATHS:
            skip = skip | path.contains(s)
        score = (
            points((t != "") & (t == low), "equal")
            + points((t != "") & low.contains(t), "inside")
            + points((t != "") & t.contains(low) & (F.length(low) > 24), "around")
            + points(path.rlike(r"/20\d{2}/"), "dated")
        )
        taken = (host(x["url"]) == host(base)) & ~skip & (F.length(x["anchor"]) >= 12)
        return F.struct((-F.when(taken, score).otherwise(F.lit(0))).alias("s"), x["n"].alias("n"), x["url"].alias("url"))

    def usable(x: Column) -> Column:
        href = strip(attr(x, "href"))
        return (x["tag"] == "a") & (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:")

    def link(x: Column) -> Column:
        return F.struct(x["ord"].alias("n"), resolve_url(base, strip(attr(x, "href"))).alias("url"), norm_space(text_of(x)).alias("anchor"))

    good = F.filter(F.transform(F.transform(F.filter("nodes", usable), link), scored), lambda x: x["s"] < 0)

    def best(items: Column) -> Column:
        """First occurrence of an address, then the best ``k`` of the page."""
        urls = F.transform(items, lambda x: x["url"])
        return F.slice(F.array_sort(let(urls, lambda us: F.filter(items, lambda x, i: F.array_position(us, x["url"]) == i + 1))), 1, k)

    return df.select(key, F.posexplode(let(good, best)).alias("i", "l")).select(
        key, (F.col("i") + 1).alias("rank"), F.col("l.url").alias("url"), (-F.col("l.s")).alias("score")
    )
