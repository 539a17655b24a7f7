"""Line predicates as Column functions. Patterns carry Unicode flags because the content is bilingual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, let, norm_space, nz, strip, strip_chars, upper_ratio, word_count

I, U = "(?iuU)", "(?U)"

# Patterns that must accept what the metadata format accepts.
DOI_LABEL = r"DOI:\s*[0-9]+\.[0-9]+/[A-Z0-9\-]+"
_TYPES = (
    r"(?:Оригинальная\s+статья|Original\s+Article|Обзорная\s+статья|Review\s+Article|"
    r"Краткое\s+сообщение|Short\s+Message)"
)
ARTICLE_TYPE = rf"{_TYPES}(?:\s*/\s*{_TYPES})?"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"https?://[^\s]+"
ABSTRACT_HEAD = r"\b(?:Аннотация|Abstract)\.?\s*"
KEYWORDS_HEAD = r"\b(?:Ключевые\s+слова|Keywords)\s*[.:]?\s*"
CITATION_HEAD = r"(?:For\s+citation|Для\s+цитирования):\s*"
REFERENCES_HEAD = (
    r"\A(?:Источники|Литература|References|Список\s+литературы|Bibliography|Библиография)(?:\s*и\s+источники)?[.:]?\s*"
)
ANY_META = r"doi|https?://|@|©|\b\d{4}\s*г\."
SECTION_HEADER = (
    r"\A(?:Введение|Методы?|Результаты|Обсуждение|Заключение|Выводы|Introduction|Methods?|Results?|Discussion|"
    r"Conclusion|Background|Materials?\s+and\s+Methods?|Acknowledgements?)\.?\s*\z"
)
EDITORIAL_DATE = r"\A(?:Поступила|Поступил|После доработки|Принята к публикации|Received|Revised|Accepted)\b"
REF_HEADER = r"\A(?:СПИСОК\s+ЛИТЕРАТУРЫ|ЛИТЕРАТУРА|REFERENCES|BIBLIOGRAPHY|СПИСОК\s+ИСТОЧНИКОВ)\b"
REF_END = r"\A(?:Поступила|Рукопись|Received|Accepted|Информация\s+об\s+авторе|Information\s+about\s+the\s+author)\b"
REF_NUMBERED = r"\A\s*(?:\[\d{1,4}\]|\d{1,4}[.)])\s+"
RU_AUTHOR = r"\A\s*[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+){0,2}\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.\b"
EN_AUTHOR = r"\A\s*[A-Z][A-Za-z\-']+(?:\s+[A-Z][A-Za-z\-']+){0,2},?\s+(?:[A-Z]\.\s*){1,3}\b"
YEAR = r"\b(?:18|19|20)\d{2}\b"
DOI_MENTION = r"\bdoi\s*:\s*|https?://doi\.org/"
PAGES_MENTION = r"\b(?:pp?\.\s*\d+(?:[–-]\d+)?|с\.\s*\d+(?:[–-]\d+)?)\b"
VOLUME_MENTION = r"\b(?:т\.\s*\d+|vol\.\s*\d+|№\s*\d+|no\.\s*\d+|issue\s*\d+)\b"
FURNITURE_HINT = r"\b(?:19|20)\d{2}\b|№\s*\d+|\bpp?\.\b|\bс\.\b|Славяноведение|Slavic Studies"
BLOCK_NUMBERED = r"\A\s*(?:\[\d{1,3}\]|\d{1,3}[.)])\s*"

# Words of service lines, headings, end marks and affiliations.
SERVICE_WORDS = ["удк", "udc", "doi", "e-mail", "email", "@", "©", "copyright"]
HEADING_MARKERS = ["references", "литература", "список литературы", "библиографический список"]
END_MARKERS = [
    "информация об авторе",
    "информация об авторах",
    "information about the author",
    "information about the authors",
    "авторы сделали эквивалентный вклад в подготовку публикации и заявляют об отсутствии конфликта интересов",
    "the authors made equivalent contributions to the publication and declare no conflict of interest",
]
END_PREFIXES = ["информация об автор", "information about the author"]
AFFILIATION_STEMS = [
    "институт", "универс", "академ", "лаборатор", "центр", "музей", "факульт", "кафедр", "отдел", "department",
    "faculty", "institute", "university", "academy", "laborator", "centre", "center", "school", "museum", "research",
]
# Running headers; callers pass their own list where these do not apply.
HEADER_PREFIXES = ["2.5.4", "2.5.5", "2.5.6", "2.5.7"]
HEADER_PHRASES = ["роботы, мехатроника и робототехнические системы"]
HEADER_DATED = [("вестник мгту", ["2025", "2026"])]


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def contains_any(c: Column, items: Sequence[str]) -> Column:
    return any_of([c.contains(i) for i in items])


def is_service_line(c) -> Column:
    return let(F.lower(strip(nz(c))), lambda s: (F.length(s) < 3) | contains_any(s, SERVICE_WORDS))


def marker_text(c) -> Column:
    """Comparable form of a heading: entities decoded, lower case, ё as е, outer punctuation off."""
    s = F.replace(F.lower(decode_entities(nz(c))), F.lit("ё"), F.lit("е"))
    return strip_chars(norm_space(s), r" .:;\-–—")


def is_reference_heading(c) -> Column:
    return marker_text(c).isin(HEADING_MARKERS)


def is_reference_heading_prefix(c) -> Column:
    return norm_space(c).rlike(I + REF_HEADER)


def is_reference_end(c) -> Column:
    return let(marker_text(c), lambda m: m.isin(END_MARKERS) | any_of([m.startswith(p) for p in END_PREFIXES]))


def is_reference_end_prefix(c) -> Column:
    return norm_space(c).rlike(I + REF_END)


# The tests below that start with an underscore take text whose whitespace is already normalized.


def _starts_entry(s: Column) -> Column:
    return s.rlike(U + REF_NUMBERED) | s.rlike(U + RU_AUTHOR) | s.rlike(U + EN_AUTHOR)


def _reference_start(s: Column) -> Column:
    author = s.rlike(U + RU_AUTHOR) | s.rlike(U + EN_AUTHOR)
    detail = s.rlike(I + "|".join((YEAR, DOI_MENTION, VOLUME_MENTION, PAGES_MENTION)))
    return s.rlike(U + REF_NUMBERED) | (author & detail)


def _token(s: Column) -> Column:
    return s.rlike(I + "|".join((DOI_LABEL, EMAIL, URL)))


def _author_line(s: Column) -> Column:
    initials = F.regexp_count(s, F.lit(r"[A-ZА-ЯЁ]\."))
    surnames = F.regexp_count(s, F.lit(r"(?U)\b[A-ZА-ЯЁ][a-zа-яё-]{2,}\b"))
    separated = s.rlike(I + ",|;| и | and ")
    return (
        (initials >= 2)
        & (surnames >= 2)
        & (separated | (initials >= 4))
        & ~s.rlike(I + f"{EMAIL}|{URL}")
    )


def _affiliation(s: Column) -> Column:
    return (
        s.rlike(I + "|".join(AFFILIATION_STEMS))
        & (word_count(s) <= 28)
        & (s.rlike(U + r"\A[\d*#,\.\s]+") | s.contains(",") | ~s.rlike(I + ANY_META))
    )


def _editorial_date(s: Column) -> Column:
    return s.rlike(I + EDITORIAL_DATE)


def _standalone(s: Column) -> Column:
    return s.rlike(I + "|".join((DOI_LABEL, EMAIL, URL, ARTICLE_TYPE)))


def _front_matter(s: Column) -> Column:
    return (
        _standalone(s)
        | s.rlike(I + EDITORIAL_DATE + r"|\A\*?\s*e-?mail\s*[:\-]?\s*")
        | _author_line(s)
        | _affiliation(s)
    )


def _metadata_or_header(s: Column) -> Column:
    return (
        (F.length(s) < 10)
        | s.rlike(I + "|".join((ANY_META, ARTICLE_TYPE, CITATION_HEAD, REFERENCES_HEAD, SECTION_HEADER)))
        | ((F.length(s) >= 20) & (upper_ratio(s) >= 0.7))
    )


def _toc(s: Column) -> Column:
    return (F.length(s) < 5) | (s.rlike(r"(?U)\A\s*\S+.*\d+\s*\z") & (F.regexp_count(s, F.lit(r"(?U)\d+")) <= 2))


def _safe_header_footer(s: Column) -> Column:
    return (
        (s != "")
        & (F.length(s) <= 80)
        & ~_front_matter(s)
        & ~s.rlike(I + f"{REF_HEADER}|{REF_END}")
        & ~((word_count(s) >= 8) & (upper_ratio(s) < 0.55))
    )


def starts_entry(c) -> Column:
    """Numbered or author-like start, whatever follows."""
    return let(norm_space(c), _starts_entry)


def is_reference_start(c) -> Column:
    return let(norm_space(c), _reference_start)


def has_token(c) -> Column:
    return let(nz(c), _token)


def is_author_line(c) -> Column:
    return let(norm_space(c), _author_line)


def is_affiliation_line(c) -> Column:
    return let(norm_space(c), _affiliation)


def is_editorial_date_line(c) -> Column:
    return let(norm_space(c), _editorial_date)


def is_standalone_metadata(c) -> Column:
    return let(strip(nz(c)), _standalone)


def is_front_matter(c) -> Column:
    return let(norm_space(c), _front_matter)


def is_metadata_or_header(c) -> Column:
    return let(strip(nz(c)), _metadata_or_header)


def is_running_header(
    c,
    prefixes: Sequence[str] = HEADER_PREFIXES,
    phrases: Sequence[str] = HEADER_PHRASES,
    dated: Sequence[tuple[str, Sequence[str]]] = HEADER_DATED,
) -> Column:
    def body(m: Column) -> Column:
        return any_of(
            [m.startswith(p) for p in prefixes]
            + [m.contains(p) for p in phrases]
            + [m.startswith(p) & contains_any(m, years) for p, years in dated]
        )

    return let(marker_text(c), body)


def is_toc_line(c) -> Column:
    """Too short, or ends with a number and holds at most two."""
    return let(strip(nz(c)), _toc)


def is_safe_header_footer(c) -> Column:
    return let(norm_space(c), _safe_header_footer)


def looks_like_furniture(c) -> Column:
    return c.rlike(I + FURNITURE_HINT) & (F.length(c) < 120)


# List markers and style-name keywords, in priority order.
LIST_BULLET = r"\A\s*[•*\-–—]\s+"
LIST_NUMBER = r"\A\s*(?:\(?\d{1,3}[.)]|\[\d{1,3}\])\s+"
STYLE_GROUPS = [
    ("title", ["ЗАГОЛОВОК", "TITLE", "ТИТУЛЬНИК", "HEADING1", "H1"]),
    ("subtitle", ["ПОДЗАГОЛОВОК", "HEADING2", "H2", "SUBTITLE"]),
    ("heading3", ["HEADING3", "H3"]),
    ("authors", ["АВТОР", "AUTHOR", "AUTHORS"]),
    ("abstract", ["АННОТАЦ", "ABSTRACT", "SUMMARY", "РЕЗЮМЕ"]),
    ("keywords", ["КЛЮЧ", "KEYWORD", "KEYWORDS"]),
    ("references", ["ЛИТЕРАТУР", "REFERENCE", "BIBLIOGRAPHY", "БИБЛИОГРАФ", "ИСТОЧНИК"]),
    ("table-caption", ["ТАБЛИЦ", "TABLE"]),
    ("figure-caption", ["РИС", "FIGURE", "FIG", "ИЛЛЮСТРАЦ"]),
    ("list-ul", ["СПИСОК", "LIST", "BULLET", "МАРКИР"]),
    ("list-ol", ["НУМЕР", "NUMBER", "ORDERED"]),
]


def section_of_style(c) -> Column:
    """First keyword group found in the upper-cased style name; abstract and keywords split off English."""
    s = F.upper(nz(c))
    out = None
    for name, words in STYLE_GROUPS:
        value = F.lit(name)
        if name in ("abstract", "keywords"):
            value = F.when(s.contains("EN"), F.lit(f"{name}_en")).otherwise(value)
        test = contains_any(s, words)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit("body"))


def list_kind(text, numbering_level=None, css_class=None, list_type=None) -> Column:
    """``ol``, ``ul`` or null; an explicit list type wins and references are never lists."""
    plain = strip(decode_entities(F.regexp_replace(nz(text), r"<[^>]+>", "")))
    level = strip(nz(numbering_level)) if numbering_level is not None else F.lit("")
    given = F.nullif(nz(list_type), F.lit("")) if list_type is not None else F.lit(None).cast("string")
    refs = (nz(css_class) == "references") if css_class is not None else F.lit(False)
    return F.coalesce(
        given,
        F.when(
            ~refs,
            F.when(~level.isin("", "0", "None"), F.lit("ol"))
            .when(plain.rlike(U + LIST_BULLET), F.lit("ul"))
            .when(plain.rlike(U + LIST_NUMBER), F.lit("ol")),
        ),
    )


def strip_list_marker(text, kind: Column) -> Column:
    return (
        F.when(kind == "ul", strip(F.regexp_replace(nz(text), U + LIST_BULLET, "")))
        .when(kind == "ol", strip(F.regexp_replace(nz(text), U + LIST_NUMBER, "")))
        .otherwise(nz(text))
    )
