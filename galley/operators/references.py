"""Reference lists: assembling entries from lines, joining split addresses, de-duplication and quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import (
    col,
    decode_entities,
    fix_intra_word_breaks,
    has_text,
    let,
    norm_empty,
    norm_space,
    nz,
    split_lines,
    strip,
    strip_chars,
    strip_invisible,
    upper_ratio,
    word_count,
)
from ..plans.segments import cut, first_per_key, island_text, row_numbers, running, with_totals

_MARK = "\ue000"

# Line starts that continue the previous reference.
ADDRESS_START = r"(?:https?://|doi\.org/|doi:)"
ADDRESS_START_NARROW = r"http(?=.*doi\.org)"


# --- joining DOI and URL lines ----------------------------------------------------------------------------------


def is_address_line(c: Column, mode: str = "wide") -> Column:
    if mode == "wide":
        return c.rlike(rf"(?i)\A{ADDRESS_START}")
    return c.startswith("http") & F.lower(c).contains("doi.org")


def merge_doi_items(items: Column | str, mode: str = "wide") -> Column:
    """Array form: an item that begins with a DOI or URL joins the kept item before it. Linear, in the row."""
    kept = F.filter(F.transform(col(items), lambda x: strip(nz(x))), lambda x: x != "")
    glue = rf"(?i:{ADDRESS_START})" if mode == "wide" else rf"http(?=[^{_MARK}]*(?i:doi\.org))"
    joined = F.regexp_replace(F.array_join(kept, _MARK), rf"{_MARK}(?={glue})", " ")
    return F.filter(F.split(joined, _MARK), lambda x: x != "")


def merge_doi_lines(
    lines: DataFrame, mode: str = "wide", keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Table form: ``(keys, line_no, text)`` with the ordinal of the first line of each joined entry."""
    kept = lines.where(has_text("text")).withColumn("text", strip(nz("text")))
    start = F.when(is_address_line(F.col("text"), mode), 0).otherwise(1)
    df = running(kept, keys, "line_no", sums={"__isl": start}, bounded=bounded)
    # A leading address line has no entry to join and stands alone with those that follow it.
    return (
        df.groupBy(*keys, "__isl")
        .agg(F.min("line_no").alias("line_no"), island_text("line_no", "text").alias("text"))
        .select(*keys, "line_no", "text")
    )


def merge_doi_paragraphs(
    blocks: DataFrame, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Paragraph rows ``(keys, pos, html, adjacent)``: an address paragraph joins the adjacent one before it."""
    plain = strip(F.regexp_replace(nz("html"), r"<[^>]+>", ""))
    joins = is_address_line(plain, "narrow") & F.col("adjacent")
    df = running(blocks, keys, "pos", sums={"__isl": F.when(joins, 0).otherwise(1)}, bounded=bounded)
    return (
        df.groupBy(*keys, "__isl")
        .agg(F.min("pos").alias("pos"), island_text("pos", "html").alias("html"))
        .select(*keys, "pos", "html")
    )


# --- assembling entries from blocks -----------------------------------------------------------------------------


def assemble_references(
    blocks: DataFrame, keys: Sequence[str] = ("doc_id",), ordinal: str = "pos", bounded: bool = False
) -> DataFrame:
    """Blocks ``(keys, pos, block_type, text)`` to blocks with one row per reference inside the reference section.

    List items stand alone, numbered text starts an entry, other text continues it; running headers are dropped and
    break the entry; outside the section nothing changes.
    """
    keys = list(keys)
    df = blocks.withColumn("text", strip(nz("text")))
    df = df.withColumn("__m", P.marker_text("text"))
    m = F.col("__m")
    header = P.is_running_header("text")
    heading = m.isin(P.HEADING_MARKERS) & ~header
    end = (m.isin(P.END_MARKERS) | P.any_of([m.startswith(p) for p in P.END_PREFIXES])) & ~header
    event = F.when(heading, F.lit("open")).when(end, F.lit("end"))
    df = df.withColumn("__header", header).withColumn("__event", event)
    item = F.coalesce(F.col("block_type") == "li", F.lit(False))
    unmarked = F.col("__event").isNull() & ~F.col("__header") & ~item
    carries, lags = {"__state": F.col("__event")}, {"__after_unmarked": unmarked}
    df = running(df, keys, ordinal, carries=carries, lags=lags, bounded=bounded)
    # An end mark counts only inside a section; outside it is an ordinary line, which the carried state already says.
    inside = (F.coalesce(F.col("__state"), F.lit("end")) == "open") & F.col("__event").isNull()
    # A row without an event has the state of the row before, so the row before is inside as well.
    plain = inside & ~F.col("__header") & ~item
    continues = plain & F.coalesce(F.col("__after_unmarked"), F.lit(False)) & ~F.col("text").rlike(P.U + P.BLOCK_NUMBERED)
    df = running(df, keys, ordinal, sums={"__isl": F.when(continues, 0).otherwise(1)}, bounded=bounded)
    kept = df.where(~F.col("__header"))
    out = kept.groupBy(*keys, "__isl").agg(
        F.min(ordinal).alias(ordinal),
        F.min_by("block_type", ordinal).alias("block_type"),
        strip(island_text(ordinal, "text")).alias("text"),
    )
    return row_numbers(out.drop("__isl"), keys, ordinal, "line_number", bounded)


# --- gluing pairs -----------------------------------------------------------------------------------------------

# Halves that extraction splits over two lines.
URL_LABEL = r"\A\s*URL\s*:?\s*\z"
URL_WHOLE = r"\Ahttps?://\S*\z"
DOI_BROKEN = r"DOI:\s*\S+/\s*\z"
DOI_REST = r"\A[A-Z0-9][A-Z0-9\-./]+\z"


def glue_pairs(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Joins a label with its link, a DOI with its rest, a cut address with its tail. Pairs never overlap.

    Eligible rows that follow each other form a run; a left-to-right scan takes every second one, so the position in
    the run decides.
    """
    keys = list(keys)
    df = lines.withColumn("text", norm_space("text"))
    df = running(df, keys, "line_no", leads={"__next": F.col("text")}, sums={"__n": F.lit(1)}, bounded=bounded)
    cur, nxt = F.col("text"), nz("__next")
    label = cur.rlike(P.I + URL_LABEL) & nxt.rlike(P.I + URL_WHOLE)
    broken = cur.rlike(P.I + DOI_BROKEN) & nxt.rlike(r"(?i)" + DOI_REST)
    cut = (
        cur.rlike(P.I + URL_WHOLE)
        & (nxt != "")
        & ~F.lower(nxt).rlike(r"\Ahttps?://")
        & cur.rlike(r"[./-]\z")
    )
    kind = F.when(label, F.lit("space")).when(broken | cut, F.lit("none"))
    df = df.withColumn("__kind", kind)
    eligible = F.col("__kind").isNotNull()
    # Position inside the run: rows since the last row that cannot start a pair.
    df = running(df, keys, "line_no", carries={"__base": F.when(~eligible, F.col("__n"))}, bounded=bounded)
    odd = ((F.col("__n") - F.coalesce(F.col("__base"), F.lit(0))) % 2) == 1
    df = df.withColumn("__takes", eligible & odd)
    df = running(df, keys, "line_no", lags={"__taken": F.col("__takes")}, bounded=bounded)
    joined = F.when(
        F.col("__takes"),
        norm_space(F.concat(cur, F.when(F.col("__kind") == "space", F.lit(" ")).otherwise(F.lit("")), nxt)),
    ).otherwise(cur)
    return df.withColumn("text", joined).where(~F.coalesce(F.col("__taken"), F.lit(False))).select(*lines.columns)


# --- the reference block of an extracted text -------------------------------------------------------------------


def reference_block(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Lines between the first reference heading and the first end mark after it, whitespace normalized."""
    keys = list(keys)
    df = lines.where(has_text("text")).withColumn("text", norm_space("text"))
    head = F.col("text").rlike(P.I + P.REF_HEADER)
    df = df.withColumn("__h", F.when(head, 1).otherwise(0))
    df = running(df, keys, "line_no", sums={"__open": F.col("__h")}, bounded=bounded)
    # Only lines strictly after the first heading: it is the one row where the running count turns 1.
    after = (F.col("__open") >= 1) & ~((F.col("__open") == 1) & (F.col("__h") == 1))
    df = df.where(after).withColumn("__e", F.when(F.col("text").rlike(P.I + P.REF_END), 1).otherwise(0))
    df = running(df, keys, "line_no", sums={"__closed": F.col("__e")}, bounded=bounded)
    return df.where("__closed = 0").select(*lines.columns)


def filter_repeated_in_references(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), bounded: bool = False
) -> DataFrame:
    """Inside a block: repeated lines of eight characters or more that look like furniture go."""
    keys = list(keys)
    df = with_totals(lines, keys, "line_no", {"__size": ("count", F.lit(1))}, bounded=bounded)
    df = df.withColumn("__norm", F.lower(norm_space("text")))
    long = {"__freq": ("count", F.when(F.length("text") >= 8, F.lit(1)))}
    df = with_totals(df, [*keys, "__norm"], "line_no", long, bounded=bounded)
    least = F.when(F.col("__size") >= 40, 3).otherwise(2)
    return df.where(~((F.col("__freq") >= least) & P.looks_like_furniture(F.col("text")))).select(*lines.columns)


def tidy_entry(c: Column) -> Column:
    s = F.regexp_replace(norm_space(c), r"(?iU)\bURL\s*:\s*", "URL: ")
    s = F.regexp_replace(s, r"(?U)\s+([,.;:])", "$1")
    s = F.regexp_replace(s, r"(?U)([(/])\s+", "$1")
    return F.regexp_replace(s, r"(?U)\s+([)])", "$1")


def normalize_references(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), parity: bool = False, bounded: bool = False
) -> DataFrame:
    """Reference block of an extracted text to one row per entry: ``(keys, line_no, text)``.

    ``parity`` also drops short continuation lines that merely hold a year or a number sign and joins letter
    fragments over spaces, which loses text; by default both stay out.
    """
    keys = list(keys)
    block = filter_repeated_in_references(reference_block(lines, keys, bounded), keys, bounded)
    df = glue_pairs(block, keys, bounded)
    if parity:
        df = df.withColumn("text", norm_space(fix_intra_word_breaks("text")))
    df = df.where("text <> ''").withColumn("__start", P.starts_entry("text"))
    if parity:
        df = df.where(~(P.looks_like_furniture(F.col("text")) & ~F.col("__start")))
        df = df.withColumn("text", fix_intra_word_breaks("text")).withColumn("__start", P.starts_entry("text"))
    df = running(df, keys, "line_no", sums={"__isl": F.col("__start").cast("int")}, bounded=bounded).where("__isl > 0")
    out = df.groupBy(*keys, "__isl").agg(
        F.min("line_no").alias("line_no"), island_text("line_no", "text").alias("text")
    )
    text = fix_intra_word_breaks("text") if parity else F.col("text")
    return out.select(*keys, "line_no", tidy_entry(text).alias("text")).where("text <> ''")


def reference_quality(entries: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Score 0..1 per document: years, pages or DOIs, few short entries, few broken addresses."""
    t = F.col("text")

    def share(test: Column) -> Column:
        return F.avg(F.when(test, 1.0).otherwise(0.0))

    score = (
        share(t.rlike(P.U + P.YEAR)) * 0.45
        + share(t.rlike(P.I + P.PAGES_MENTION) | t.rlike(P.I + P.DOI_MENTION)) * 0.35
        + (F.lit(1.0) - share(F.length(strip(t)) < 20)) * 0.10
        + (F.lit(1.0) - share(t.rlike(r"(?U)https?://\S*\s+\S+"))) * 0.10
    )
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")
    )


# Starts of numbered entries and of "Surname year -" entries.
NUMBERED_START = r"(?:\[\d{1,3}\]|\d{1,3}[.)])\s+"
SURNAME_YEAR = r"[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё'’.-]+\s+(?:18|19|20)\d{2}\s*[—–-]\s*"


def estimate_reference_count(c: Column | str) -> Column:
    return F.greatest(
        F.regexp_count(nz(c), F.lit(rf"(?U)(?:\A|\n)\s*{NUMBERED_START}")),
        F.regexp_count(nz(c), F.lit(rf"(?U)\b{SURNAME_YEAR}")),
    )


def fallback_references(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), heading: str = "References", bounded: bool = False
) -> DataFrame:
    """Entries of a bare reference text: the block rules first, else plain starts; then de-duplicated.

    A document for which the block rules find nothing falls back to: a line starts an entry when it is numbered or
    begins "Surname year -", unless it is an address or the entry so far ends with an address label.
    """
    keys = list(keys)
    base = lines.where(has_text("text")).withColumn("text", strip(nz("text")))
    first = base.groupBy(*keys).agg((F.min("line_no") - 1).alias("line_no")).withColumn("text", F.lit(heading))
    headed = base.select(*keys, "line_no", "text").unionByName(first.select(*keys, "line_no", "text"))
    # Written once: three readers would make the entries anew.
    strict = cut(normalize_references(headed, keys, False, bounded))
    have = strict.select(*keys).distinct()

    df = running(base, keys, "line_no", lags={"__prev": F.col("text")}, bounded=bounded)
    address = F.col("text").rlike(r"(?iU)\A(?:doi\s*:|https?://|doi\.org/|10\.\d{4,9}/)")
    labelled = nz("__prev").rlike(r"(?iU)(?:doi\s*:|url\s*:)\s*\z")
    new = F.col("text").rlike(rf"(?U)\A{NUMBERED_START}") | F.col("text").rlike(rf"(?U)\A{SURNAME_YEAR}")
    df = df.withColumn("__new", (new & ~address & ~labelled).cast("int"))
    df = running(df, keys, "line_no", sums={"__isl": F.col("__new")}, bounded=bounded)
    loose = (
        df.groupBy(*keys, "__isl")
        .agg(F.min("line_no").alias("line_no"), island_text("line_no", "text").alias("text"))
        .select(*keys, "line_no", "text")
    )
    keyed = cut(_with_reference_key(strict.unionByName(loose.join(have, keys, "left_anti"))))
    return first_per_key(keyed, [*keys, "__key"], F.col("line_no")).select(*strict.columns)


def reference_key(c: Column | str) -> Column:
    """Identity of a reference: its DOI, else its address, else its words."""

    def body(s: Column) -> Column:
        glued = F.regexp_replace(strip_invisible(s), r"(?U)\s*([/-])\s*", "$1")
        doi = F.regexp_extract(glued, r"(?iU)\b(?:doi:\s*)?(10\.\d{4,9}/[^\s,;]+)", 1)
        url = F.regexp_extract(s, r"(?iU)\bhttps?://[^\s)]+", 0)
        words = strip(F.regexp_replace(F.lower(s), r"(?U)[^\w]+", " "))
        return (
            F.when(doi != "", F.concat(F.lit("doi:"), F.lower(doi)))
            .when(url != "", F.concat(F.lit("url:"), F.lower(url)))
            .otherwise(F.concat(F.lit("txt:"), words))
        )

    return let(norm_space(c), body)


def _with_reference_key(refs: DataFrame) -> DataFrame:
    return refs.where(has_text("text")).withColumn("text", norm_space("text")).withColumn("__key", reference_key("text"))


def dedupe_references(refs: DataFrame, keys: Sequence[str] = ("doc_id",), ordinal: str = "line_no") -> DataFrame:
    """First of every reference by key, order kept. An aggregate with map-side combine, so copies cost little."""
    df = _with_reference_key(refs)
    return first_per_key(df, [*keys, "__key"], F.col(ordinal)).select(*refs.columns)


# --- sections ---------------------------------------------------------------------------------------------------

# Section markers, closing markers and body headings.
SECTION_MARKERS = {
    "abstract": ["аннотация", "резюме", "summary"],
    "abstract_en": ["abstract"],
    "keywords": ["ключевые слова", "ключевые слова и словосочетания"],
    "keywords_en": ["keywords", "key words"],
    "references": ["литература", "список литературы", "библиографический список", "references", "bibliography"],
}
CITATION_MARKERS = ["для цитирования", "for citation", "how to cite"]
AUTHOR_INFO_MARKERS = ["информация об автор", "information about the author", "information about authors", "об авторах"]
BODY_HEADINGS = [
    "введение", "заключение", "выводы", "основная часть", "обсуждение", "результаты", "материалы и методы",
    "introduction", "conclusion", "results", "discussion", "materials and methods",
]
HEADER_STYLES = ["колонтитул", "рубрика"]


def carry_sections(
    paras: DataFrame, keys: Sequence[str] = ("doc_id",), ordinal: str = "line_no", bounded: bool = False
) -> DataFrame:
    """Adds ``section`` and ``content`` to styled paragraphs ``(keys, line_no, style, text)``.

    A marker alone opens a section, ``marker: text`` opens it with text, a tagged style opens its own; body text
    continues abstracts and references always and keywords while it looks like a list. Citation, author and body
    headings, running headers and other styles close. Rows that carry no section text have a null ``section``.
    """
    keys = list(keys)
    plain = strip(decode_entities(F.regexp_replace(F.regexp_replace(nz("text"), r"<br/?>", "\n"), r"<[^>]+>", "")))
    df = paras.withColumn("__plain", plain)
    df = df.withColumn(
        "__m", strip_chars(norm_space(F.replace(F.lower(F.col("__plain")), F.lit("ё"), F.lit("е"))), r" .:;\-–—")
    )
    m = F.col("__m")
    style = nz("style")
    header = P.contains_any(F.replace(F.lower(style), F.lit("ё"), F.lit("е")), HEADER_STYLES) | P.any_of(
        [m.startswith(p) for p in P.HEADER_PREFIXES]
        + [m.contains(p) for p in P.HEADER_PHRASES]
        + [m.startswith(p) & P.contains_any(F.concat(F.lit(" "), m, F.lit(" ")), [f" {y} " for y in ys]) for p, ys in P.HEADER_DATED]
    )
    citation = P.any_of([m.startswith(x) for x in CITATION_MARKERS])
    author = P.contains_any(m, AUTHOR_INFO_MARKERS)
    heading = m.isin(BODY_HEADINGS)
    tagged = P.section_of_style("style")
    alone, inline = None, None
    for section, words in SECTION_MARKERS.items():
        hit = m.isin(words)
        alone = F.when(hit, F.lit(section)) if alone is None else alone.when(hit, F.lit(section))
        pattern = rf"(?iuU)\A\s*(?:{'|'.join(words)})\s*[:.\-—–]\s*(.+?)\s*\z"
        test = F.col("__plain").rlike(pattern)
        inline = F.when(test, F.lit(section)) if inline is None else inline.when(test, F.lit(section))
    everything = "|".join(w for ws in SECTION_MARKERS.values() for w in sorted(ws, key=len, reverse=True))
    after = F.regexp_extract("__plain", rf"(?iuU)\A\s*(?:{everything})\s*[:.\-—–]\s*(.+?)\s*\z", 1)
    closes = header | citation | heading
    df = (
        df.withColumn("__closes", closes)
        .withColumn("__author", author & ~closes)
        .withColumn("__alone", F.when(~closes & (m != ""), alone))
        .withColumn("__tag", tagged)
    )
    df = df.withColumn("__inline", F.when(~F.col("__closes") & (m != "") & F.col("__alone").isNull(), inline))
    df = df.withColumn("__after", after)
    opens = F.coalesce(
        F.col("__alone"), F.col("__inline"), F.when(F.col("__tag").isin(list(SECTION_MARKERS)), F.col("__tag"))
    )
    body = F.col("__tag") == "body"
    # Body text closes when it cannot continue: always when blank, and for keywords when it is long without
    # separators. The latter depends on the open section, so it is encoded as its own closing event.
    listlike = (word_count(m) <= 25) | m.contains(",") | m.contains(";")
    df = df.withColumn("__opens", F.when(~F.col("__closes"), opens))
    event = (
        F.when(F.col("__closes"), F.lit("-"))
        .when(F.col("__opens").isNotNull(), F.col("__opens"))
        .when(F.col("__author") | ~body | (m == ""), F.lit("-"))
    )
    df = df.withColumn("__event", event).withColumn("__stop_kw", F.col("__event").isNull() & ~listlike)
    spans = {"__ev": F.col("__event").isNotNull().cast("int")}
    df = running(df, keys, ordinal, carries={"__open": F.col("__event")}, sums=spans, bounded=bounded)
    # Inside one event span of a keyword section the first long line stops the rest of the span.
    df = running(df, [*keys, "__ev"], ordinal, sums={"__stops": F.col("__stop_kw").cast("int")}, bounded=bounded)
    state = F.when(F.col("__open").isin("keywords", "keywords_en") & (F.col("__stops") > 0), F.lit("-")).otherwise(
        F.col("__open")
    )
    silent = F.col("__closes") | F.col("__alone").isNotNull()
    section = F.when(~silent & (F.coalesce(state, F.lit("-")) != "-"), state)
    content = F.when(F.col("__inline").isNotNull(), F.col("__after")).otherwise(F.col("__plain"))
    return df.select(*paras.columns, section.alias("section"), F.when(section.isNotNull(), content).alias("content"))


# Fixed value: where a numbered entry begins.
ENTRY_NUMBER = r"(?:\A|\n)\s*\d{1,3}\s*[).:\]]|\[\d{1,3}\]"


def numbered_references(c: Column | str) -> Column:
    """Section text to entries cut before each number; without numbers every line is one."""

    def body(t: Column) -> Column:
        cuts = F.split(t, "(?U)" + ENTRY_NUMBER, -1)
        pieces = let(cuts, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))
        entries = F.transform(pieces, lambda x: strip(F.regexp_replace(x, r"(?U)\s*\n\s*", " ")))
        lines = F.transform(F.split(t, "\n"), norm_space)
        return F.filter(F.when(t.rlike("(?U)" + ENTRY_NUMBER), entries).otherwise(lines), lambda x: x != "")

    cleaned = F.regexp_replace(nz(c), r"<br/?>", "\n")
    kept = F.filter(F.transform(F.split(cleaned, "\n"), strip), lambda x: x != "")
    return let(F.array_join(kept, "\n"), body)


def split_references(c: Column | str) -> Column:
    """Lines of a reference text; one line alone is split before its numbers; numbers are stripped."""

    def body(lines: Column) -> Column:
        one = F.transform(F.split(F.get(lines, F.lit(0)), r"(?U)\s(?=\[\d+\]|\d+\.)"), norm_space)
        items = F.when(F.size(lines) == 1, one).otherwise(lines)
        bare = F.transform(items, lambda x: strip(F.regexp_replace(x, r"(?U)\A\s*(?:\[\d+\]|\d+\.)\s*", "")))
        return F.filter(bare, lambda x: x != "")

    lines = F.transform(F.split(F.translate(nz(c), "\r", "\n"), "\n"), norm_space)
    return let(F.filter(lines, lambda x: x != ""), body)


# Section headings that say which language list a reference belongs to.
RU_HEADING = r"(?miuU)^\s*(?:список\s+литературы|литература|библиография|источники)\s*[:.]?\s*$"
EN_HEADING = r"(?miuU)^\s*references\s*[:.]?\s*$"


def allocate_references(rus: Column | str, eng: Column | str, text: Column | str) -> Column:
    """``struct(RUS, ENG)``: lists placed by the headings present in the text, not by the entries' language."""

    def clean(x) -> Column:
        empty = F.array().cast("array<string>")
        return F.filter(F.transform(F.coalesce(col(x), empty), lambda v: strip(nz(v))), lambda v: v != "")

    ru, en, all_ = clean(rus), clean(eng), F.concat(clean(rus), clean(eng))
    has_ru, has_en = nz(text).rlike(RU_HEADING), nz(text).rlike(EN_HEADING)
    none = F.array().cast("array<string>")
    both, only_en = has_ru & has_en, has_en & ~has_ru
    return F.struct(
        F.when(both, ru).when(only_en, none).otherwise(all_).alias("RUS"),
        F.when(both, en).when(only_en, all_).otherwise(none).alias("ENG"),
    )


def reference_lines(c: Column | str) -> Column:
    """Text or list of a form to cleaned items: placeholders out, address lines joined."""
    kept = F.filter(F.transform(split_lines(c), norm_empty), lambda x: x != "")
    return merge_doi_items(kept)


# --- inline tokens, metadata lines, paragraphs ------------------------------------------------------------------
# All of it is expressions on one text cell: a scan, no exchange.

# What counts as a token inside a line, in order of preference at one place, and what opens a part.
INLINE = {"url": P.URL, "email": P.EMAIL, "doi": P.DOI_LABEL, "type": P.ARTICLE_TYPE}
PART_HEADS = [p.replace(r"\A", "^") for p in (P.ABSTRACT_HEAD, P.KEYWORDS_HEAD, P.CITATION_HEAD, P.REFERENCES_HEAD)]
_ANY_TOKEN = P.I + "|".join(f"(?:{p})" for p in INLINE.values())


def inline_tokens(c: Column | str) -> Column:
    """Emails, URLs, DOIs and article-type labels: ``struct(start, end, text, kind)``, leftmost first, without overlaps.

    The text between tokens gives their places: one pass adds up gaps and tokens.
    """

    def tokens(s: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(_ANY_TOKEN), F.lit(0))
        pairs = F.zip_with(found, F.slice(F.split(s, _ANY_TOKEN, -1), F.lit(1), F.size(found)), lambda t, gap: F.struct(t.alias("t"), F.length(gap).alias("gap")))
        kinds = "array<struct<start:int,end:int,text:string,kind:string>>"
        none = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("done"))

        def step(acc: Column, x: Column) -> Column:
            t, start = x["t"], acc["at"] + x["gap"]
            kind = F.coalesce(*[F.when(t.rlike(rf"{P.I}\A(?:{p})\z"), F.lit(k)) for k, p in INLINE.items()])
            token = F.struct(start.alias("start"), (start + F.length(t)).alias("end"), strip(t).alias("text"), kind.alias("kind"))
            return F.struct((start + F.length(t)).alias("at"), F.concat(acc["done"], F.array(token)).alias("done"))

        return F.aggregate(pairs, none, step, lambda acc: acc["done"])

    return let(nz(c), tokens)


def split_metadata_line(c: Column | str) -> Column:
    """A line to its parts: in front of section heads, and around the tokens of what stands before the first head."""

    def around_tokens(s: Column) -> Column:
        found = F.concat(F.regexp_extract_all(s, F.lit(_ANY_TOKEN), F.lit(0)), F.array(F.lit("")))
        return F.flatten(F.zip_with(F.split(s, _ANY_TOKEN, -1), found, lambda gap, t: F.array(gap, t)))

    def cut(state: Column, head: str) -> Column:
        def by(x: Column) -> Column:
            at = F.regexp_instr(x["left"], F.lit(P.I + head))
            rest = F.concat(F.array(F.substr(x["left"], at, F.length(x["left"]))), x["tail"])
            split = F.struct(strip(F.substr(x["left"], F.lit(1), at - 1)).alias("left"), rest.alias("tail"))
            return F.when(at > 0, split).otherwise(x)

        return let(state, by)

    state = F.struct(strip(nz(c)).alias("left"), F.array().cast("array<string>").alias("tail"))
    for head in PART_HEADS:
        state = cut(state, head)
    parts = let(state, lambda x: F.concat(around_tokens(x["left"]), x["tail"]))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


# Lines that always continue a paragraph, and whether case counts for them.
CONTINUES = [
    (r"\A\([^)]+\)\.?\s*\z", False),
    (r"\A\s*\d+/\d+\.\s*\d{4}\.", True),
    (r"\A\s*\d{4}\.\s*[Ss]\.\s*\d+", True),
    (r"\A\s*[SsCcPp]+\.?\s*\d+[–-]\d+\.?\s*\z", False),
    (r"\A\s*[SsCcPp]+\.?\s*\d+\.?\s*\z", False),
    (r"\A\s*\d+\s*[PpСс]+\.?\s*\z", False),
    (r"\A\s*\d+[–-]\d+\.?\s*\z", True),
    (r"\A\s*\d+/\d+\.", True),
    (r"\A\s*(?:Vol\.|Т\.|№)\s*\d+", False),
]
# Sizes in characters and words at which a line continues a paragraph or begins one.
FEW_WORDS = 2
SHORT_LINE, SHORT_AFTER_COMMA, SHORT_AFTER_STOP = 40, 50, 30
FULL_SENTENCE, LONG_PARAGRAPH, TOO_LONG_PARAGRAPH = 20, 150, 500
# Length of a title line, and its share of capitals.
TITLE_LENGTH, TITLE_CAPITALS = (8, 140), 0.75
# A line and the next that are one, joined by a blank or by nothing.
JOINED_BY_BLANK = [(r"Ссылка", r"для\s+цитирования\s*:"), (r"URL\s*:", r"https?://")]
JOINED_TIGHT = (r"\bDOI:\s*[0-9]+\.[0-9]+/\s*", r"[A-Z0-9\-]+")


def _rejoined(text: Column) -> Column:
    """Lines that an extractor cut in two, put together in the text itself."""
    for head, tail in JOINED_BY_BLANK:
        text = F.regexp_replace(text, rf"(?imuU)^(\h*{head})\h*\n\h*(?={tail})", "$1 ")
    head, tail = JOINED_TIGHT
    return F.regexp_replace(text, rf"(?mU)(?i:({head}))$\n\h*(?={tail}\h*$)", "$1")


def _part_facts(part: Column) -> Column:
    """What the rules ask of a part by itself, told once; of a blank part nothing else is asked.

    The normalized text is bound to a name, since an expression inside a lambda is computed at every use.
    """
    ends = lambda *marks: P.any_of([F.endswith(part, F.lit(m)) for m in marks])

    def of(s: Column) -> Column:
        some = lambda c: (s != "") & c
        return F.struct(
            part.alias("part"), s.alias("flat"), (s == "").alias("blank"),
            some(s.rlike(P.I + P.REF_HEADER)).alias("opens_list"), some(s.rlike(P.I + P.REF_END)).alias("ends_list"),
            some(P._reference_start(s)).alias("entry"), some(P._front_matter(s)).alias("alone"),
            (ends("-") & (F.length(part) > 1)).alias("hyphen"),
            (part.rlike(P.I + PART_HEADS[0]) | part.rlike(P.I + PART_HEADS[1])).alias("section"),
            P.is_metadata_or_header(part).alias("header"),
            part.rlike(r"\A\p{Lu}").alias("capital"), part.rlike(r"\A\p{Ll}").alias("small"),
            P.any_of([part.rlike((P.U if cased else P.I) + p) for p, cased in CONTINUES]).alias("same"),
            F.when(ends("-"), norm_space(F.substr(part, F.lit(1), F.length(part) - 1))).otherwise("").alias("cut"), _caps(s).alias("title"),
            word_count(part).alias("words"), F.length(part).alias("size"),
        )

    return let(norm_space(part), of)


def _caps(s: Column) -> Column:
    stop = P.any_of([F.endswith(s, F.lit(m)) for m in (".", "!", "?", ";", ":")])
    low, high = TITLE_LENGTH
    return (F.length(s) >= low) & (F.length(s) <= high) & ~stop & (upper_ratio(s) >= TITLE_CAPITALS)


# Parts that one inner fold goes through.
CHUNK = 512
# What a part is to the paragraphs: nothing, a further part, a first part; the same without its trailing hyphen.
_NONE, _ON, _FIRST, _ON_CUT, _FIRST_CUT = range(5)


def paragraphs(c: Column | str) -> Column:
    """Extracted text of a document, one line per row of type, to its paragraphs.

    A fold over the parts of the text says of each part whether it begins a paragraph or goes on. Its state has a constant
    size: the length of the open paragraph, its text while it is short enough for a title, the last part, and whether
    the reference list is open. The paragraphs are cut out by these marks at the end. Blank lines end a paragraph;
    headings and front matter stand alone; a trailing hyphen is cut; the rest depends on the part before and the length.
    """
    lines = F.split(_rejoined(nz(c)), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.when(strip(x) == "", F.array(F.lit(""))).otherwise(split_metadata_line(x))))

    def state(size: Column, text: Column, last: Column, refs: Column) -> Column:
        return F.struct(size.alias("size"), text.alias("text"), last.alias("last"), refs.alias("refs"))

    no, zero = F.lit(""), F.lit(0)

    def rule(was: Column, p: Column) -> Column:
        """State behind a part, and the part's mark."""

        def within(st: Column) -> Column:
            prev, open_ = F.regexp_replace(st["last"], r"(?U)\s+\z", ""), st["size"] > 0

            def told(mark, next_: Column) -> Column:
                return F.struct((F.lit(mark) if isinstance(mark, int) else mark).alias("mark"), next_.alias("next"))

            def after(*marks: str) -> Column:
                return P.any_of([F.endswith(prev, F.lit(m)) for m in marks])

            def add(flat: Column, last: Column, on: int, first: int) -> Column:
                size = F.when(flat == "", st["size"]).when(open_, st["size"] + 1 + F.length(flat)).otherwise(F.length(flat))
                text = F.when(size > TITLE_LENGTH[1], no).when(open_, F.concat_ws(" ", st["text"], flat)).otherwise(flat)
                return told(F.when(open_, F.lit(on)).otherwise(F.lit(first)), state(size, text, last, st["refs"]))

            short = F.when(F.length(p["flat"]) <= TITLE_LENGTH[1], p["flat"]).otherwise(no)
            fresh = told(_FIRST, state(F.length(p["flat"]), short, p["part"], st["refs"]))
            go_on = add(p["flat"], p["part"], _ON, _FIRST)
            heading = F.when(_caps(st["text"]) & p["title"], told(_ON, state(zero, no, no, st["refs"]))).otherwise(fresh)
            begins = p["capital"] & (
                (st["size"] > TOO_LONG_PARAGRAPH) | ((st["size"] > LONG_PARAGRAPH) & (p["size"] > FULL_SENTENCE) & after(".", "!", "?"))
            )
            goes_on = p["same"] | (
                (p["small"] & (p["words"] <= FEW_WORDS))
                | (~after(".", "!", "?", ":", ";") & ((p["size"] < SHORT_LINE) | p["small"]))
                | (after(",", ":", ";") & ((p["size"] < SHORT_AFTER_COMMA) | p["small"]))
                | (after(".") & p["small"] & (p["size"] < SHORT_AFTER_STOP))
            )
            return (
                F.when(p["blank"], told(_NONE, state(zero, no, no, st["refs"])))
                .when(p["opens_list"], told(_FIRST, state(zero, no, no, F.lit(True))))
                .when(st["refs"], F.when(p["entry"], fresh).otherwise(go_on))
                .when(p["alone"], told(_FIRST, state(zero, no, no, st["refs"])))
                .when(p["hyphen"], add(p["cut"], strip(F.substr(p["part"], F.lit(1), p["size"] - 1)), _ON_CUT, _FIRST_CUT))
                .when(p["section"] | ~open_, fresh)
                .when(p["header"], heading)
                .when(~begins & goes_on, go_on)
                .otherwise(fresh)
            )

        # The end of the list closes what is open before the part is looked at.
        ended = was["refs"] & p["ends_list"] & ~p["opens_list"]
        return let(F.when(ended, state(zero, no, no, F.lit(False))).otherwise(was), within)

    marks = F.array().cast("array<int>")

    def inner(acc: Column, p: Column) -> Column:
        return let(rule(acc["st"], p), lambda r: F.struct(r["next"].alias("st"), F.concat(acc["marks"], F.array(r["mark"])).alias("marks")))

    def outer(acc: Column, chunk: Column) -> Column:
        """A chunk's marks are appended at once, so that a long text is not copied at every part."""
        start = F.struct(acc["st"].alias("st"), marks.alias("marks"))
        return let(F.aggregate(chunk, start, inner), lambda r: F.struct(r["st"].alias("st"), F.concat(acc["marks"], F.array(r["marks"])).alias("marks")))

    def cut_out(facts: Column) -> Column:
        n = F.size(facts)
        chunks = F.transform(F.sequence(zero, F.floor((n - 1) / F.lit(CHUNK)).cast("int")), lambda i: F.slice(facts, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(state(zero, no, no, F.lit(False)).alias("st"), F.array().cast("array<array<int>>").alias("marks"))
        return let(F.aggregate(chunks, start, outer, lambda acc: F.flatten(acc["marks"])), lambda ms: cut_by(facts, ms))

    def cut_by(facts: Column, ms: Column) -> Column:
        texts = F.zip_with(facts, ms, lambda p, m: F.when(m == _NONE, no).when(m >= _ON_CUT, p["cut"]).otherwise(p["flat"]))
        firsts = F.filter(F.transform(ms, lambda m, i: F.when(m.isin(_FIRST, _FIRST_CUT), i)), lambda i: i.isNotNull())

        def whole(ts: Column, at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ts)))
            return F.zip_with(at, ends, lambda a, b: F.array_join(F.filter(F.slice(ts, a + 1, b - a), lambda t: t != ""), " "))

        return let(texts, lambda ts: let(firsts, lambda at: whole(ts, at)))

    return F.filter(let(F.transform(parts, _part_facts), cut_out), lambda t: t != "")
