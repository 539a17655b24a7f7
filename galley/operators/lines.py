"""Jobs on line tables ``(doc_id, [page], line_no, text)`` and their in-row forms for whole-document text cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import (
    col,
    dehyphenate,
    escape_html,
    has_text,
    let,
    norm_space,
    nz,
    split_lines,
    strip,
)
from ..plans.segments import first_per_key, island_text, row_numbers, running, with_totals

# Running headers that sit inside a line.
INLINE_HEADERS = [
    r"Вестник ВНИИДАД № \d+ \| \d{4}",
    r"Herald of VNIIDAD № \d+ \| \d{4}",
    r"Archival science and document science \d+",
    r"Архивоведение и документоведение \d+",
]


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to lines, one row each, zero-based ``line_no``. No shuffle."""
    return docs.select(key, F.posexplode(split_lines(text)).alias("line_no", "text"))


# --- repeated lines ---------------------------------------------------------------------------------------------


def tidy_document(c: Column, inline_headers: Sequence[str] = INLINE_HEADERS) -> Column:
    """What follows line removal: inline headers, broken words, blank runs, spaces, line ends."""
    s = F.regexp_replace(c, P.I + "|".join(inline_headers), "") if inline_headers else c
    s = F.regexp_replace(dehyphenate(s), r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, " +", " ")
    return strip(F.array_join(F.transform(F.split(s, "\n"), strip), "\n"))


def clean_document_text(
    c: Column | str, min_repeats: int = 3, patterns: Sequence[str] = (), inline_headers: Sequence[str] = INLINE_HEADERS
) -> Column:
    """In-row form of :func:`remove_repeated_lines` plus :func:`tidy_document`: no explode, no shuffle.

    After sorting the stripped lines, a line occurs ``n`` times exactly when it equals its neighbour ``n - 1`` places
    on, so counting needs no grouping.
    """
    def repeated_in(ranked: Column) -> Column:
        at = F.lit(min_repeats - 1)
        return F.array_distinct(F.filter(ranked, lambda x, i: F.coalesce(F.get(ranked, i + at) == x, F.lit(False))))

    def kept(lines: Column, repeated: Column) -> Column:
        def keep(x: Column) -> Column:
            def test(s: Column) -> Column:
                out = ~F.array_contains(repeated, s)
                for p in patterns:
                    out = out & ~s.rlike(f"(?iuU)\\A(?:{p})")
                return out

            return let(strip(x), test)

        return F.filter(lines, keep)

    def body(lines: Column) -> Column:
        ranked = F.array_sort(F.filter(F.transform(lines, strip), lambda x: F.length(x) >= 3))
        return let(let(ranked, repeated_in), lambda repeated: F.array_join(kept(lines, repeated), "\n"))

    return tidy_document(let(split_lines(c), body), inline_headers)


def line_frequency(lines: DataFrame, norm: Column, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Adds ``freq``: occurrences of the normalized line within the key."""
    df = lines.withColumn("__norm", norm)
    return with_totals(df, [*keys, "__norm"], "line_no", {"freq": ("count", F.lit(1))}, bounded=bounded).drop("__norm")


def remove_repeated_lines(
    lines: DataFrame,
    min_repeats: int = 3,
    patterns: Sequence[str] = (),
    keys: Sequence[str] = ("doc_id",),
    bounded: bool = False,
) -> DataFrame:
    """Table form: drops lines that occur ``min_repeats`` times in their document and have three characters or more."""
    s = strip(nz("text"))
    out = line_frequency(lines, s, keys, bounded)
    drop = (F.col("freq") >= min_repeats) & (F.length(s) >= 3)
    for p in patterns:
        drop = drop | ((s != "") & s.rlike(f"(?iuU)\\A(?:{p})"))
    return out.where(~drop).select(*lines.columns)


# Page-number forms and other furniture forms.
PAGE_NUMBER_FORMS = [r"\A\s*\d+\s*\z", r"\Aстр\.\s*\d+", r"\Apage\s+\d+", r"\A\d+\s*/\s*\d+"]
FURNITURE_FORMS = [r"\A№\s*\d+", r"\Ano\.\s*\d+", r"\A\d{4}\s*г\."]


def remove_page_furniture(lines: DataFrame, bounded: bool = False) -> DataFrame:
    """Running headers, footers and page numbers off a paged line table ``(doc_id, page, line_no, text)``.

    ``line_no`` is unique within the document. The first of the frequent page numbers stays.
    """
    norm = F.lower(norm_space("text"))
    df = lines.withColumn("__norm_line", norm)
    df = running(df, ["doc_id", "page"], "line_no", sums={"__idx": F.lit(1)}, bounded=bounded)
    df = with_totals(df, ["doc_id", "page"], "line_no", {"__size": ("count", F.lit(1))}, bounded=bounded)
    # A page has exactly one first line, so first lines count pages.
    first_line = F.when(F.col("__idx") == 1, F.lit(1))
    df = with_totals(df, ["doc_id"], "line_no", {"__pages": ("count", first_line)}, bounded=bounded)
    df = line_frequency(df, F.col("__norm_line"), ["doc_id"], bounded)

    n = F.col("__norm_line")
    numbered = P.any_of([n.rlike(P.I + p) for p in PAGE_NUMBER_FORMS])
    threshold = F.greatest(F.lit(3), F.floor((F.col("__pages") + 1) / 2))
    frequent = (F.col("freq") >= threshold) & (n != "")
    edge = (F.col("__idx") <= 2) | (F.col("__idx") > F.col("__size") - 2)
    safe = P.is_safe_header_footer(n)
    other = P.any_of([n.rlike(P.I + p) for p in FURNITURE_FORMS])
    df = df.withColumn("__number", numbered & frequent & (F.col("__pages") >= 2)).withColumn(
        "__drop", (F.col("__pages") >= 2) & (n != "") & ~numbered & safe & ((frequent & edge) | other)
    )
    kept = (
        first_per_key(df.where("__number").select("doc_id", "page", "line_no"), ["doc_id"], F.col("page"), F.col("line_no"))
        .select("doc_id", "line_no", F.lit(True).alias("__first"))
    )
    df = df.join(kept, ["doc_id", "line_no"], "left")
    return df.where(~F.col("__drop") & (~F.col("__number") | F.col("__first").isNotNull())).select(*lines.columns)


def filter_service_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    return blocks.where(~P.is_service_line(text))


# --- selection and numbering ------------------------------------------------------------------------------------


def select_pages(
    pages: DataFrame, first: int = 3, last: int = 3, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """First ``first`` and last ``last`` pages of a page table, without overlap, in order."""
    ranked = row_numbers(pages, keys, "page", "__rn", bounded)
    ranked = with_totals(ranked, keys, "page", {"__n": ("count", F.lit(1))}, bounded=bounded)
    rn, n = F.col("__rn"), F.col("__n")
    return ranked.where((rn <= first) | (rn > F.greatest(F.lit(first), n - last))).select(*pages.columns)


def renumber(
    df: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    ordinal: str = "line_no",
    out: str = "line_number",
    bounded: bool = False,
) -> DataFrame:
    """Ordinals 1..n after filtering and merging."""
    return row_numbers(df, keys, ordinal, out, bounded)


def chunk_lines(
    lines: DataFrame, n: int = 25, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Groups of ``n`` non-blank lines: ``(keys, chunk, text, lines)``."""
    kept = lines.where(has_text("text")).withColumn("text", strip(nz("text")))
    ranked = row_numbers(kept, keys, "line_no", "__rn", bounded).withColumn("chunk", F.floor((F.col("__rn") - 1) / n))
    return ranked.groupBy(*keys, "chunk").agg(
        island_text("line_no", "text", "\n").alias("text"),
        F.count(F.lit(1)).alias("lines"),
    )


def chunk_text(c: Column | str, max_chars: int = 8000) -> Column:
    """One long text to pieces: cut at the last full stop before the limit if it lies beyond 60 % of it.

    Each piece depends on where the previous one ended; a regex scan moves on exactly like that.
    """
    low = int(max_chars * 0.6)
    pattern = rf"(?sU)(.{{1,{max_chars}}}\z|.{{{low},{max_chars - 1}}}(?=\.)|.{{{max_chars}}})\s*"
    return F.transform(F.regexp_extract_all(strip(nz(c)), F.lit(pattern), F.lit(1)), strip)


def _regroup(text: Column, n: int) -> Column:
    """Non-blank lines of a text in groups of ``n``."""
    items = F.filter(F.transform(split_lines(text), strip), lambda x: x != "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0))), lambda i: i % n == 0)
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, F.lit(n)), "\n"))


def split_oversized(chunks: DataFrame, n: int = 25, max_chars: int = 20000, max_tokens: int = 15000) -> DataFrame:
    """Re-chunks what is too long: by characters first, then by estimated tokens (four characters each)."""
    c = F.col("text")
    once = F.when(F.length(c) > max_chars, _regroup(c, max(5, n // 2))).otherwise(F.array(c))
    twice = F.flatten(
        F.transform(
            once,
            lambda x: F.when(F.floor(F.length(x) / 4) > max_tokens, _regroup(x, max(3, n // 3))).otherwise(F.array(x)),
        )
    )
    rest = [x for x in chunks.columns if x != "text"]
    return chunks.select(*rest, F.posexplode(twice).alias("part", "text"))


# --- file and folder names --------------------------------------------------------------------------------------


def safe_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Drops blank names, the dot folders and anything with a slash; the rest is stripped."""
    c = nz(name)
    ok = ~c.contains("/") & ~c.contains("\\") & ~c.isin(".", "..")
    return df.where(ok & (strip(c) != "")).withColumn(name, strip(c))


def safe_members(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``status`` to archive member paths: ``ok``, ``ignored`` or ``rejected``."""
    p = F.replace(nz(path), F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    absolute = p.startswith("/") | p.rlike(r"\A[A-Za-z]:")
    ignored = (F.get(parts, F.lit(0)) == "__MACOSX") | (F.element_at(parts, -1) == ".DS_Store")
    return df.withColumn(
        "status",
        F.when(ignored, F.lit("ignored"))
        .when(absolute | F.array_contains(parts, ".."), F.lit("rejected"))
        .otherwise(F.lit("ok")),
    )


# --- html -------------------------------------------------------------------------------------------------------


def paragraphs_to_html(c: Column | str) -> Column:
    """Paragraph list to markup; an empty list gives an empty division."""
    kept = F.filter(F.transform(col(c), strip), lambda x: x != "")
    body = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))), "\n")
    return F.when(F.size(kept) == 0, F.lit("<div></div>")).otherwise(body)


def blocks_to_html(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), metadata: bool = False) -> DataFrame:
    """Word-file blocks to one markup text per document."""
    attrs = F.lit("")
    if metadata:
        for attr, c in (("source", "source"), ("block-type", "block_type"), ("order", "pos")):
            attrs = F.concat(attrs, F.lit(f' data-{attr}="'), escape_html(nz(F.col(c).cast("string"))), F.lit('"'))
    html = F.concat(F.lit("<p"), attrs, F.lit(">"), escape_html(nz("text")), F.lit("</p>"))
    marked = blocks.withColumn("__html", F.when(strip(nz("text")) != "", html))
    text = island_text("pos", "__html", "\n")
    return marked.groupBy(*keys).agg(F.when(text == "", F.lit("<div></div>")).otherwise(text).alias("html"))


def filter_words_by_script(
    words: DataFrame,
    target: str,
    keys: Sequence[str] = ("doc_id", "page"),
    ordinal: str = "ord",
    bounded: bool = False,
) -> DataFrame:
    """Keeps words of the target script and words without letters, unless the area already is in that script or
    nothing would remain."""
    t = nz("text")
    cyr = F.length(F.regexp_replace(t, "[^\\x{0400}-\\x{04FF}]", ""))
    lat = F.length(F.regexp_replace(t, r"[^\p{L}]|[\x{0400}-\x{10FFFF}]", ""))
    none = ~t.rlike(r"\p{L}")
    keep = none | ((cyr > 0) if target == "ru" else (lat > 0))
    totals = {"__cyr": ("sum", cyr), "__lat": ("sum", lat), "__kept": ("count", F.when(keep, 1))}
    df = with_totals(words, keys, ordinal, totals, bounded=bounded)
    detected = (
        F.when((F.col("__cyr") == 0) & (F.col("__lat") == 0), "unknown")
        .when(F.col("__cyr") > F.col("__lat"), "ru")
        .otherwise("en")
    )
    return df.where((detected == target) | (F.col("__kept") == 0) | keep).select(*words.columns)
