"""Dates, DOIs, ISSNs, page ranges, issue keys, names and URLs as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, norm_space, nz, rstrip_chars, strip, strip_chars, strip_invisible


def digits(c: Column | str, kind: str = "int") -> Column:
    """Digits to a number, anything else to null."""
    return F.when(col(c) != "", col(c)).try_cast(kind)


def normalize_date(c: Column | str) -> Column:
    """ISO text from day-first or year-first prefixes; ten characters with two hyphens pass through."""
    s = strip(nz(c))
    day_first = r"(?U)\A(\d{1,2})[./](\d{1,2})[./](\d{4})"
    year_first = r"(?U)\A(\d{4})[./](\d{1,2})[./](\d{1,2})"

    def iso(pattern: str, y: int, m: int, d: int) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(s, pattern, i)

        return F.concat_ws("-", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0"))

    hyphens = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    return (
        F.when((F.length(s) == 10) & (hyphens == 2), s)
        .when(s.rlike(day_first), iso(day_first, 3, 2, 1))
        .when(s.rlike(year_first), iso(year_first, 1, 2, 3))
        .otherwise(s)
    )


def normalize_doi(c: Column | str, mode: str = "record") -> Column:
    """``record``: invisible characters and spaces around ``/`` and ``-`` removed, URL or label prefix removed.
    ``site``: whitespace normalized, prefix removed, trailing punctuation removed."""
    if mode == "record":
        s = F.regexp_replace(strip_invisible(c), r"(?U)\s*([/-])\s*", "$1")
        return strip(F.regexp_replace(s, r"(?iU)\A(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    s = strip(F.regexp_replace(norm_space(c), r"(?iU)\A(?:doi:\s*|https?://doi\.org/)", ""))
    return rstrip_chars(s, ").,;")


# The DOI alphabet after the prefix and the separators inside it.
DOI_BASE = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_SEP = r"[-._;()/:]"


def extract_best_doi(c: Column | str) -> Column:
    """First DOI of a text, glued with following fragments that extraction split off.

    A fragment counts when it holds a digit and either a separator or the text so far ends with one; only the first
    fragment can rely on the latter because fragments end in letters or digits. One possessive pattern says all that,
    so no loop is needed.
    """
    s = F.regexp_replace(strip_invisible(c), r"(?U)\s*([/-])\s*", "$1")
    fragment = rf"{DOI_SEP}?[A-Za-z0-9]++(?:{DOI_SEP}[A-Za-z0-9]++)*+"
    digit = rf"(?={DOI_SEP}?(?:[A-Za-z]++{DOI_SEP})*+[A-Za-z]*+[0-9])"
    inner = rf"(?={DOI_SEP}[A-Za-z0-9]|[A-Za-z0-9]++{DOI_SEP}[A-Za-z0-9])"
    skip = r"[\s,.;:]*+"
    tail = rf"(?:(?<={DOI_SEP}){skip}{digit}{fragment})?+(?:{skip}{digit}{inner}{fragment})*+"
    whole = F.regexp_extract(s, rf"(?iU)({DOI_BASE}){tail}", 0)
    base = F.regexp_extract(s, rf"(?iU)({DOI_BASE}){tail}", 1)
    rest = F.substring(whole, F.length(base) + 1, F.length(whole))
    rest = F.regexp_replace(rest, r"(?U)[\s,.;:]*[\s,][\s,.;:]*|[.;:]{2,}|[.;:](?=[-_()/])", "")
    return rstrip_chars(F.concat(base, rest), "),.;:")


def normalize_issn(c: Column | str) -> Column:
    raw = F.upper(F.regexp_replace(nz(c), "[^0-9Xx]", ""))
    return F.when(F.length(raw) == 8, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 4))).otherwise("")


def normalize_keywords(c: Column | str) -> Column:
    """Semicolon list from semicolons and commas, no trailing dots."""
    parts = F.filter(F.transform(F.split(strip(nz(c)), "[;,]"), strip), lambda x: x != "")
    return F.regexp_replace(F.array_join(parts, "; "), r"(?U)[\s.]+\z", "")


def split_keywords(c: Column | str) -> Column:
    """Site variant: label removed, split on semicolon and comma; one part returns the text as is."""
    s = strip_chars(norm_space(c), " ,;.")
    s = F.regexp_replace(s, r"(?iuU)\A(?:keywords|key words|ключевые слова)\s*[:\-]\s*", "")

    def listed(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, "[;,]"), lambda x: strip_chars(x, " ,;.")), lambda x: x != "")
        return let(parts, lambda p: F.when(F.size(p) <= 1, text).otherwise(F.array_join(p, "; ")))

    return let(s, listed)


# Page range separators.
PAGE_SEPARATORS = "-–—,"


def parse_pages(c: Column | str) -> Column:
    """``struct(min_page, max_page)`` of the first range, a single number twice, or null."""
    s = F.replace(strip(nz(c)), F.lit(" "), F.lit(""))
    a = digits(F.regexp_extract(s, rf"\A(\d+)[{PAGE_SEPARATORS}](\d+)(?:[{PAGE_SEPARATORS}]|\z)", 1))
    b = digits(F.regexp_extract(s, rf"\A(\d+)[{PAGE_SEPARATORS}](\d+)(?:[{PAGE_SEPARATORS}]|\z)", 2))
    one = digits(F.regexp_extract(s, rf"\A(\d+)(?:[{PAGE_SEPARATORS}]|\z)", 1))
    ranged = a.isNotNull() & b.isNotNull()
    lo = F.when(ranged, F.least(a, b)).otherwise(one)
    hi = F.when(ranged, F.greatest(a, b)).otherwise(one)
    return F.when(lo.isNotNull(), F.struct(lo.alias("min_page"), hi.alias("max_page")))


def start_page_loose(c: Column | str) -> Column:
    """Leading digits of the listing view; knows no dash variants."""
    return digits(F.regexp_extract(strip(nz(c)), r"\A(\d+)", 1))


def format_pages(first: Column | str, last: Column | str) -> Column:
    f, l = col(first).cast("string"), col(last).cast("string")
    return F.when(f.isNotNull() & l.isNotNull() & (f != l), F.concat_ws("-", f, l)).otherwise(
        F.coalesce(f, l, F.lit(""))
    )


def parse_pages_meta(first: Column | str, last: Column | str, pages: Column | str) -> Column:
    f, l, p = norm_space(first), norm_space(last), norm_space(pages)
    rng = r"\b(\d+)\s*[-–—]\s*(\d+)\b"
    return (
        F.when((f != "") & (l != ""), F.concat_ws("-", f, l))
        .when(p.rlike(rng), F.concat_ws("-", F.regexp_extract(p, rng, 1), F.regexp_extract(p, rng, 2)))
        .when(p.rlike(r"\A\d+\z"), p)
        .otherwise("")
    )


def optional_positive_int(c: Column | str) -> Column:
    return let(strip(nz(c)), lambda s: F.when(s.rlike(r"\A\d+\z"), s)).try_cast("int")


ISSUE_KEY_ISSN = r"[0-9]{4}-[0-9]{3}X|[0-9]{4}-[0-9]{4}X?"


def parse_issue_key(c: Column | str) -> Column:
    """``ISSN_year_number`` or ``ISSN_year_volume_number`` to a struct, else null."""
    s = F.translate(nz(c), "–—−", "---")
    pattern = rf"\A({ISSUE_KEY_ISSN})_(\d{{4}})_(?:(\d+)_)?(\d+)\z"

    def part(i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    return F.when(
        s.rlike(pattern),
        F.struct(
            part(1).alias("issn"),
            part(2).alias("year"),
            F.nullif(part(3), F.lit("")).alias("volume"),
            part(4).alias("number"),
        ),
    )


def split_person_name(c: Column | str) -> Column:
    """``struct(family, given)``: ``Family, Given``, else the last word is the family name."""
    s = norm_space(c)
    parts = F.split(s, " ")
    n = F.size(parts)
    comma = F.instr(s, ",")
    family = F.when(comma > 0, strip(F.substring_index(s, ",", 1))).otherwise(F.element_at(parts, -1))
    given = F.when(comma > 0, strip(F.substring(s, comma + 1, F.length(s)))).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    )
    return F.struct(family.alias("family"), given.alias("given"))


def format_initials(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"([А-ЯЁA-Z])\.", "$1. "), r"(?U)\s+\z", "")


def with_lang_param(url: Column | str, lang: str = "en") -> Column:
    """Sets query parameter ``sl``; other parameters keep their separators."""
    u = nz(url)
    base = F.regexp_extract(u, r"\A([^?#]*)", 1)
    query = F.regexp_extract(u, r"\A[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(u, r"\A[^#]*(#.*)?\z", 1)
    new = (
        F.when(query.contains("sl="), F.regexp_replace(query, r"(\A|&)sl=[^&]*", f"$1sl={lang}"))
        .when(query != "", F.concat(query, F.lit(f"&sl={lang}")))
        .otherwise(F.lit(f"sl={lang}"))
    )
    return F.concat(base, F.lit("?"), new, fragment)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link: absolute, scheme-relative, rooted, query-only or relative to the base folder."""

    def body(b: Column, h: Column) -> Column:
        scheme = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
        host = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        folder = F.regexp_extract(b, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
        return (
            F.when(h == "", b)
            .when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(host, h))
            .when(h.startswith("?"), F.concat(F.regexp_extract(b, r"\A([^?#]*)", 1), h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"\A([^#]*)", 1), h))
            .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), h))
        )

    return let(F.struct(nz(base).alias("b"), strip(nz(href)).alias("h")), lambda x: body(x["b"], x["h"]))


def doi_url_candidates(journal_url: Column | str, doi: Column | str) -> Column:
    """Article addresses a journal site may derive from the DOI suffix, most likely first."""
    value = normalize_doi(doi, "site")
    token = F.lower(strip(F.regexp_extract(value, r"(?s)\A[^/]*/(.*)\z", 1)))
    root = F.concat(rstrip_chars(nz(journal_url), "/"), F.lit("/"))
    plain = F.concat(root, token, F.lit("/"))
    numbered = F.concat(root, token, F.lit("-1/"))
    empty = F.array().cast("array<string>")
    return (
        F.when((F.instr(value, "/") == 0) | (token == ""), empty)
        .when(token.rlike(r"-\d+\z"), F.array(plain))
        .otherwise(F.array_distinct(F.array(numbered, plain)))
    )


def strip_orcid_url(c: Column | str) -> Column:
    return F.regexp_replace(nz(c), r"(?i)\Ahttps?://orcid\.org/", "")
