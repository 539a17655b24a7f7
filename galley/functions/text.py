"""Text scalars as Column functions. All native: no Python on the row path."""

from __future__ import annotations

import html as _html
import json
import re as _re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Invisible characters that extraction leaves inside words.
INVISIBLE = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body) -> Column:
    """Binds a value to a name inside an expression: computed once however often ``body`` uses it, also in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Both ends, any Unicode whitespace (``trim`` only takes spaces)."""
    return F.regexp_replace(col(c), r"(?U)\A\s+|\s+\z", "")


def rstrip_chars(c: Column | str, chars: str) -> Column:
    return F.regexp_replace(col(c), f"[{chars}]+\\z", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.regexp_replace(col(c), f"\\A[{chars}]+|[{chars}]+\\z", "")


def clean_text(c: Column | str) -> Column:
    """Tabs and line breaks to spaces, runs of spaces collapsed, both ends stripped; null gives empty."""
    return strip(F.regexp_replace(F.translate(nz(c), "\t\n\r", "   "), " {2,}", " "))


def strip_invisible(c: Column | str) -> Column:
    return F.regexp_replace(nz(c), INVISIBLE, "")


def norm_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(nz(c), r"(?U)\s+", " "))


def has_text(c: Column | str) -> Column:
    """Any non-blank character. As a filter it costs one short scan, where a test on the cleaned text would be pushed
    down and clean twice."""
    return nz(c).rlike(r"(?U)\S")


def norm_empty(c: Column | str) -> Column:
    """Blank or dash-only placeholders become empty, anything else is stripped."""
    s = strip(nz(c))
    return F.when(s.rlike(r"(?U)\A[\s\-–—]+\z"), F.lit("")).otherwise(s)


def blank_to_null(c: Column | str) -> Column:
    s = norm_empty(c)
    return F.when(s != "", s)


def normalize_search_title(c: Column | str) -> Column:
    s = norm_space(strip_invisible(strip(nz(c))))
    return strip(F.translate(s, "“”‘’–—", "\"\"''--"))


# Where the standard's references stand in a text, and what they mean: names from the standard table; numbers below 160 that
# do not stand for the character of that number.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NAMES = json.dumps(html5, ensure_ascii=False)
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_LOW = json.dumps({str(n): _html.unescape(f"&#{n};") for n in range(160) if _html.unescape(f"&#{n};") != chr(n)})


def _referred(e: Column) -> Column:
    """One character reference to text; what is none stays as it is."""
    name = F.substr(e, F.lit(2), F.length(e))
    named = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), name)
    # A name without its semicolon may be the start of a longer word.
    start = F.regexp_extract(name, rf"\A(?:{_OPEN_NAMES})", 0)
    part = F.concat(F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), start), F.substr(name, F.length(start) + 1, F.length(name)))
    word = F.coalesce(named, F.when(start != "", part), e)

    digits = F.regexp_replace(F.regexp_extract(e, r"\A&#[xX]?([0-9a-fA-F]+)", 1), r"\A0+(?=.)", "")
    digits = F.when(F.length(digits) > 8, F.lit("99999999")).otherwise(digits)
    code = F.when(e.rlike(r"\A&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    low = F.try_element_at(F.from_json(F.lit(_LOW), "map<string,string>"), code.cast("string"))
    gap = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    number = (
        F.when(low.isNotNull(), low)
        .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(gap, F.lit(""))
        .when(code == 0xFEFF, F.lit("\ufeff"))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )
    return F.when(e.startswith("&#"), number).otherwise(word)


def decode_entities(c: Column | str) -> Column:
    """HTML character references to text; rows without ``&`` pass through."""

    def decoded(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(_REFERENCE), F.lit(0)), _referred)
        pairs = F.zip_with(F.split(s, _REFERENCE, -1), F.concat(found, F.array(F.lit(""))), lambda gap, e: F.concat(gap, e))
        return F.when(s.contains("&"), F.array_join(pairs, "")).otherwise(s)

    return let(col(c), decoded)


def escape_html(c: Column | str) -> Column:
    """Escapes the five markup characters."""
    s = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def strip_tags(c: Column | str, joiner: str = " ") -> Column:
    """Markup out, entities decoded. With a space joiner whitespace is normalized; with none only the ends."""
    s = decode_entities(F.regexp_replace(nz(c), r"<[^>]+>", joiner))
    return norm_space(s) if joiner else strip(s)


def annotation_to_text(c: Column | str) -> Column:
    """Abstract markup to plain text: breaks and closing blocks become newlines."""
    s = F.regexp_replace(nz(c), r"(?i)<br\s*/?>|</(?:div|p|li)>", "\n")
    s = decode_entities(F.regexp_replace(s, r"<[^>]+>", ""))
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


# Inline tags an abstract may keep.
ANNOTATION_TAGS = ["b", "i", "em", "strong", "sup", "sub", "br"]


def sanitize_annotation(c: Column | str) -> Column:
    """Keeps the allowed inline tags without attributes, drops other markup, escapes text, newline to ``<br>``.

    Allowed tags are parked as private-use characters while entities are decoded and text is escaped.
    """
    s = F.regexp_replace(nz(c), r"(?s)<!--.*?-->", "")
    names = "|".join(t for t in ANNOTATION_TAGS if t != "br")
    opened, closed, broken = "\ue000", "\ue001", "\ue002"
    s = F.regexp_replace(s, r"(?i)<br(?:\s[^>]*)?/?>", broken)
    for tag in ANNOTATION_TAGS[:-1]:
        s = F.regexp_replace(s, rf"(?i)<{tag}(?:\s[^>]*)?/?>", f"{opened}{tag}{closed}")
        s = F.regexp_replace(s, rf"(?i)</{tag}\s*>", f"{opened}/{tag}{closed}")
    s = F.regexp_replace(s, r"</?[A-Za-z!?][^>]*>", "")
    s = escape_html(decode_entities(s))
    s = F.regexp_replace(s, r"\r\n|\r|\n", broken)
    s = F.regexp_replace(s, f"{opened}(/?(?:{names})){closed}", "<$1>")
    s = F.replace(s, F.lit(broken), F.lit("<br>"))
    s = strip(F.regexp_replace(s, r"(?:<br>\s*){3,}", "<br><br>"))
    return strip(F.regexp_replace(s, r"\A(?:<br>\s*)+|(?:<br>\s*)+\z", ""))


def restore_missing_spaces(c: Column | str) -> Column:
    """Spaces lost in extraction: after punctuation, at lower-to-upper joins, footnote marks after quotes."""
    s = F.regexp_replace(nz(c), r"([,;:!?])([A-Za-zА-Яа-яЁё])", "$1 $2")
    s = F.regexp_replace(s, r"([a-zа-яё]{2,})([A-ZА-ЯЁ][a-zа-яё])", "$1 $2")
    s = F.regexp_replace(s, r"(?U)([»\"')\]])\s*(\d{1,2})(?=\s|\z)", "$1[$2]")
    return norm_space(s)


def dehyphenate(c: Column | str, mode: str = "prose") -> Column:
    """Joins words broken over a hyphen.

    ``prose``: at least four letters before the hyphen and no capital after it. ``field``: one letter, any dash, a
    lower-case letter.
    """
    if mode == "prose":
        letter, upper, lower = "[а-яА-Яa-zA-Z]", "[А-ЯA-Z]", "[а-яa-z]"
        word = letter + "{4,}+"

        def body(s: Column) -> Column:
            out = s
            for gap in (r"-\s+", r"-\n\s+"):
                out = F.regexp_replace(out, rf"(?U)({word}{gap}{upper})|({word}){gap}({lower})", "$1$2$3")
            # The cheap test starts at a literal hyphen, so texts without a broken word cost one scan.
            return F.when(s.rlike(rf"-(?<={letter}{{4}}-)\s"), out).otherwise(s)

        return let(nz(c), body)
    dash = "[-‑–—]"
    s = F.regexp_replace(nz(c), rf"(?U)([A-Za-zА-Яа-яЁё]){dash}\s*\n\s*([a-zа-яё])", "$1$2")
    return F.regexp_replace(s, rf"(?U)([A-Za-zА-Яа-яЁё]){dash}\s+([a-zа-яё])", "$1$2")


def split_merged_words(c: Column | str) -> Column:
    """``a.B`` to ``a. B``, only where some word is longer than 50 characters."""
    s = nz(c)
    fixed = F.regexp_replace(s, r"([а-яёa-z])\.([А-ЯЁA-Z])", "$1. $2")
    return F.when(s.rlike(r"(?U)\S{51,}"), strip(F.regexp_replace(fixed, " +", " "))).otherwise(s)


def fix_intra_word_breaks(c: Column | str) -> Column:
    """Joins short letter fragments to the next word. Over-joins ordinary prepositions, so callers opt in."""
    s = nz(c)
    for letters, most, tail in (
        ("А-Яа-яЁё", 4, r"\b"),
        ("A-Za-z", 3, r"\b"),
        ("A-Za-z", 3, "-"),
        ("А-Яа-яЁё", 4, "-"),
    ):
        guard = r"(?<!\.)" if tail == r"\b" else ""
        s = F.regexp_replace(
            s,
            rf"(?U){guard}\b([{letters}]{{1,{most}}})\s+([{letters}]{{2,}}){tail}",
            "$1$2" + ("-" if tail == "-" else ""),
        )
    return s


# Labels cut from the head of a field, and index words joined to their symbol.
FIELD_PREFIXES = {
    "annotation": "аннотация|abstract",
    "annotation_en": "аннотация|abstract",
    "keywords": "ключевые слова|keywords",
    "keywords_en": "ключевые слова|keywords",
}
LINE_FIELDS = ["references_ru", "references_en"]
INDEX_WORDS = "орг|общ|max|min|opt|eff|tot|org|obs|calc|exp|теор|эксп|ср|мин|макс"
INDEX_WORDS_SHORT = "орг|общ|org|tot"


def normalize_field_text(c: Column | str, field: Column | str) -> Column:
    """Clean-up of text taken from a marked area; ``field`` decides on label removal and line joining."""
    f = col(field)
    s = F.regexp_replace(nz(c), r"\r\n|\r", "\n")
    s = dehyphenate(split_merged_words(s), "field")
    for labels in sorted(set(FIELD_PREFIXES.values())):
        fields = [k for k, v in FIELD_PREFIXES.items() if v == labels]
        s = F.when(f.isin(fields), F.regexp_replace(s, rf"(?iuU)\A(?:{labels})\s*[:\-]\s*", "")).otherwise(s)
    joined = F.regexp_replace(s, r"[ \t]*\n[ \t]*", " ")
    s = F.when(f.isin(LINE_FIELDS), s).otherwise(joined)
    s = F.regexp_replace(s, rf"(?iuU)\b([A-ZА-ЯЁ])\s+({INDEX_WORDS})\b", "$1_$2")
    s = F.regexp_replace(s, rf"(?iuU)\b([CNPKС])\s*({INDEX_WORDS_SHORT})\b", "$1_$2")
    return strip(F.regexp_replace(s, r"[ \t]+", " "))


def letters_only(c: Column | str) -> Column:
    return F.regexp_replace(nz(c), r"[^\p{L}]", "")


def upper_ratio(c: Column | str) -> Column:
    """Share of capitals among letters; 0 without letters."""
    letters = F.length(letters_only(c))
    capitals = F.length(F.regexp_replace(nz(c), r"[^\p{Lu}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(capitals / letters)


def detect_script(c: Column | str) -> Column:
    """``ru``, ``en`` or ``unknown`` by letter counts below and inside U+0400-04FF; a tie is English."""
    cyr = F.length(F.regexp_replace(nz(c), "[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(nz(c), r"[^\p{L}]|[Ѐ-\x{10FFFF}]", ""))
    return (
        F.when((cyr == 0) & (lat == 0), F.lit("unknown"))
        .when(cyr > lat, F.lit("ru"))
        .otherwise(F.lit("en"))
    )


def has_cyrillic(c: Column | str) -> Column:
    return nz(c).rlike("[Ѐ-ӿ]")


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(nz(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(nz(c), F.lit(r"(?U)\S+"))


# Ideal mean word length by script code, and the accepted band.
IDEAL_WORD_LENGTH = {"ru": 6.5, "en": 5.5}
IDEAL_WORD_LENGTH_DEFAULT = 6.0
WORD_LENGTH_BAND = (3.0, 15.0)
NOT_FOUND_TEXT = "(Текст не найден)"


def average_word_length(c: Column | str) -> Column:
    """Letters per word without materializing the words: non-blank characters over token count."""
    n = word_count(c)
    chars = F.length(F.regexp_replace(nz(c), r"(?U)\s+", ""))
    return F.when(n == 0, F.lit(float("inf"))).otherwise(chars / n)


def text_quality(c: Column | str, lang: Column | str) -> Column:
    """Distance of the mean word length from the ideal, with penalties; smaller is better."""
    n = word_count(c)
    avg = average_word_length(c)
    lc = col(lang)
    ideal = F.when(lc == "ru", F.lit(6.5)).when(lc == "en", F.lit(5.5)).otherwise(F.lit(IDEAL_WORD_LENGTH_DEFAULT))
    base = F.abs(avg - ideal) + F.when(avg.between(*WORD_LENGTH_BAND), F.lit(0.0)).otherwise(F.lit(50.0))
    short = F.regexp_count(nz(c), F.lit(r"(?U)(?<!\S)\S{1,2}(?!\S)")) / n
    return F.when((n == 0) | (nz(c) == NOT_FOUND_TEXT), F.lit(float("inf"))).otherwise(
        base + F.when(short > 0.3, short * 20).otherwise(F.lit(0.0))
    )


# Fixed value: vowels of both languages.
VOWELS = "аеёиоуыэюяaeiouy"


def is_garbled(c: Column | str, lang: Column | str) -> Column:
    """True when word lengths, inner capitals or vowel shares do not look like prose.

    Three of the shares are token counts a regex can make in one scan; only the vowel share needs the words.
    """
    upper_vowels = VOWELS + VOWELS.upper()
    caps = rf"(?U)(?<!\S)(?=\S{{4}})\S\S*?\p{{Lu}}"
    bare = rf"(?U)(?<!\S)[^\s{upper_vowels}]+(?!\S)"

    def body(s: Column) -> Column:
        n = word_count(s)

        def few_vowels(w: Column) -> Column:
            return let(
                F.length(w) - F.length(F.translate(w, upper_vowels, "")), lambda v: (v > 0) & (F.length(w) > v * 5)
            )

        none = let(F.regexp_count(s, F.lit(bare)) / n, lambda r: (r > 0.3) | ((col(lang) == "ru") & (r > 0.25)))
        long_words = F.regexp_extract_all(s, F.lit(r"(?U)\S{6,}"), F.lit(0))
        return F.when(n == 0, F.lit(False)).otherwise(
            (average_word_length(s) > 15)
            | (F.regexp_count(s, F.lit(caps)) / n > 0.05)
            | none
            | (F.size(F.filter(long_words, few_vowels)) / n > 0.3)
        )

    return let(nz(c), body)


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is non-blank after whitespace normalization; empty when there is none."""
    filled = [F.when(norm_space(c) != "", norm_space(c)) for c in cols]
    return F.coalesce(*filled, F.lit(""))


def first_non_empty_item(items: Column | str) -> Column:
    """Same over the items of a list."""
    cleaned = F.filter(F.transform(col(items), norm_space), lambda x: x != "")
    return F.coalesce(F.try_element_at(cleaned, F.lit(1)), F.lit(""))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def safe_key(c: Column | str) -> Column:
    """Characters outside letters, digits, dot, underscore, hyphen become one underscore per run."""
    return F.regexp_replace(nz(c), r"[^A-Za-z0-9._-]+", "_")


def split_lines(c: Column | str) -> Column:
    return F.split(nz(c), "\n")


SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("text", T.StringType())
)


def pattern_spans(patterns: dict[str, str], flags: int = 0):
    """Arrow helper: every match of each named pattern as (kind, start, end, text), by start then longer first.

    Spark can list matches but not their offsets.
    """
    compiled = [(k, _re.compile(p, flags)) for k, p in patterns.items()]

    @F.pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        def one(v):
            found = [
                {"kind": k, "start": m.start(), "end": m.end(), "text": m.group(0)}
                for k, p in compiled
                for m in p.finditer(v or "")
            ]
            found.sort(key=lambda x: (x["start"], -x["end"]))
            return found

        return s.map(one)

    return spans
