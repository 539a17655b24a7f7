"""Positioned words and characters: columns, lines, headers, gaps, rectangles and field templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, let, nz, norm_space, restore_missing_spaces, strip
from ..plans.segments import positions, running

PAGE = ["doc_id", "page"]
# Rows of a page are cut into bands of this height when pages are not known to be bounded.
BAND = 20.0


def _band(c: str) -> Column:
    return F.floor(F.col(c) / F.lit(BAND))


# --- columns and lines ------------------------------------------------------------------------------------------


def detect_columns(words: DataFrame, min_words: int = 10, gutter: float = 0.1, simple: bool = False) -> DataFrame:
    """One or two text columns per page, from counts left and right of the gutter.

    The full variant says one column when more than 15 % of the words start in the gutter, and asks for fewer words
    on sparse pages.
    """
    counts = words.groupBy(*PAGE).agg(*[c.alias(n) for n, c in _column_counts(gutter).items()])
    return counts.select(*PAGE, _columns(min_words, simple).alias("columns"))


def _column_counts(gutter: float = 0.1, here: Column | None = None) -> dict[str, Column]:
    """What ``_columns`` asks of a page, as aggregates of its words, or of those ``here``."""
    g = max(0.0, min(0.4, gutter))
    center = F.col("page_width") / 2.0
    left, right = center * (1.0 - g), center * (1.0 + g)
    here = F.lit(True) if here is None else here
    return {
        "n": F.count_if(here),
        "mid": F.count_if(here & (left < F.col("x0")) & (F.col("x0") < right)),
        "l": F.count_if(here & (F.col("x1") <= left)),
        "r": F.count_if(here & (F.col("x0") >= right)),
        "w": F.max(F.when(here, F.col("page_width"))),
    }


def _columns(min_words: int = 10, simple: bool = False, pre: str = "") -> Column:
    n, mid, l, r, w = (F.col(pre + c) for c in ("n", "mid", "l", "r", "w"))
    if simple:
        need, crowded = F.lit(min_words), F.lit(False)
    else:
        need = F.when(n < 2 * min_words, F.greatest(F.lit(3), F.floor(n / 4))).otherwise(min_words)
        crowded = mid > n * 0.15
    two = ~crowded & (w > 0) & (l >= need) & (r >= need)
    return F.when(two, F.lit(2)).otherwise(F.lit(1))


def _anchors(tops: Column, tolerance: float) -> Column:
    """First top of every line among sorted tops."""
    return F.aggregate(
        tops,
        F.array().cast("array<double>"),
        lambda acc, t: F.when(
            (F.size(acc) == 0) | (t - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(t))
        ).otherwise(acc),
    )


def _runs_of_small_pages(words: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Adds ``__run``: words of a page without a gap above the tolerance between their tops; one sort of the page."""
    in_order = Window.partitionBy(*keys).orderBy("top")
    gap = F.col("top") - F.lag("top").over(in_order)
    df = words.withColumn("__fresh", (F.coalesce(gap, F.lit(tolerance + 1)) > tolerance).cast("int"))
    # Equal tops share a frame, so they also share a run.
    return df.withColumn("__run", F.sum("__fresh").over(in_order.rangeBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def _lines_of_small_pages(words: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Lines by windows on the page: one exchange, which the grouping into lines then shares."""
    df = _runs_of_small_pages(words, tolerance, keys)
    run = Window.partitionBy(*keys, "__run")
    low, high, tops = F.min("top").over(run), F.max("top").over(run), F.collect_set("top").over(run)
    df = df.withColumns({"__low": low, "__high": high, "__tops": tops})
    upto = F.filter(_anchors(F.sort_array("__tops"), tolerance), lambda a: a <= F.col("top"))
    line = F.when(F.col("__high") - F.col("__low") <= tolerance, F.col("__low")).otherwise(F.array_max(upto))
    return df.withColumn("line_top", line).drop("__run", "__low", "__high", "__tops")


def _text_of_small_pages(words: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """The lines of ``lines_from_words``: a run's words meet once, and only a run that spans more is cut at its anchors."""
    runs = _runs_of_small_pages(words, tolerance, keys).groupBy(*keys, "__run").agg(
        F.collect_list(F.struct("x0", "top", "ord", "text", "x1", "bottom")).alias("__ws"),
        F.min("top").alias("__low"),
        F.max("top").alias("__high"),
    )
    anchors = _anchors(F.sort_array(F.array_distinct(F.transform("__ws", lambda w: w["top"]))), tolerance)

    def lines(tops: Column) -> Column:
        """Words between an anchor and the next; tops that are missing are a line of their own."""
        ends = F.concat(F.slice(tops, 2, F.size(tops)), F.array(F.lit(None).cast("double")))
        of = lambda a, b: F.filter("__ws", lambda w: (w["top"] >= a) & (b.isNull() | (w["top"] < b)))
        return F.zip_with(tops, ends, lambda a, b: F.struct(a.alias("line_top"), of(a, b).alias("ws")))

    whole = F.array(F.struct(F.col("__low").alias("line_top"), F.col("__ws").alias("ws")))
    cut = F.when(F.col("__high") - F.col("__low") > tolerance, let(anchors, lines)).otherwise(whole)
    # Inside the array each step is computed once; a filter on exploded lines would be pushed down and sort them again.
    told = F.transform(cut, lambda l: F.struct(l["line_top"].alias("line_top"), F.sort_array(F.filter(l["ws"], lambda w: has_text(w["text"]))).alias("ws")))
    df = runs.select(*keys, F.explode(F.filter(told, lambda l: F.size(l["ws"]) > 0)).alias("l"))
    # One look at a line tells whether any of its words needs its ends cut.
    ends = lambda t: t.rlike(r"(?U)[\s&&[^ ]]|  |\A | \z")
    cleaned = lambda t: F.when(ends(t), F.array_join(F.transform("l.ws", lambda w: strip(w["text"])), " ")).otherwise(t)
    return df.select(
        *keys,
        F.col("l.line_top").alias("line_top"),
        let(F.array_join(F.transform("l.ws", lambda w: w["text"]), " "), cleaned).alias("text"),
        F.array_min(F.transform("l.ws", lambda w: w["x0"])).alias("x0"),
        F.array_max(F.transform("l.ws", lambda w: w["x1"])).alias("x1"),
        F.array_max(F.transform("l.ws", lambda w: w["bottom"])).alias("bottom"),
    )


def assign_lines(
    words: DataFrame, tolerance: float = 2.0, keys: list[str] | None = None, bounded: bool = False
) -> DataFrame:
    """Adds ``line``: words sorted by top belong together while within the tolerance of the line's first word.

    A gap above the tolerance always starts a line, so words are first cut there. Inside such a run the anchor moves
    along with a fold over the few distinct tops of the run; most runs span no more than the tolerance and are a line.
    """
    keys = list(keys or PAGE)
    if bounded:
        return _lines_of_small_pages(words, tolerance, keys)
    # Only the distinct tops of a page take part.
    tops = words.select(*keys, "top").distinct()
    band = _band("top")
    tops = running(tops, keys, "top", order=["top"], band=band, lags={"__prev": F.col("top")}, bounded=bounded)
    fresh = F.col("__prev").isNull() | (F.col("top") - F.col("__prev") > tolerance)
    tops = running(tops, keys, "top", order=["top"], band=band, sums={"__run": fresh.cast("int")}, bounded=bounded)
    runs = tops.groupBy(*keys, "__run").agg(F.sort_array(F.collect_list("top")).alias("__tops"))
    runs = runs.withColumn("__anchors", _anchors(F.col("__tops"), tolerance))
    line = F.explode("__tops").alias("top")
    placed = runs.select(*keys, "__run", "__anchors", line)
    anchor = F.array_max(F.filter("__anchors", lambda a: a <= F.col("top")))
    placed = placed.select(*keys, "top", anchor.alias("line_top"))
    return words.join(placed, [*keys, "top"])


def lines_from_words(
    words: DataFrame, tolerance: float = 2.0, keys: list[str] | None = None, bounded: bool = False
) -> DataFrame:
    """Text lines of a page, top to bottom: ``(keys, line_top, bottom, x0, x1, text)`` with lost spaces restored."""
    keys = list(keys or PAGE)
    if bounded:
        return _text_of_small_pages(words, tolerance, keys).withColumn("text", restore_missing_spaces("text"))
    placed = assign_lines(words, tolerance, keys).where(has_text("text"))
    items = F.sort_array(F.collect_list(F.struct("x0", "top", "ord", "text")))
    out = placed.groupBy(*keys, "line_top").agg(
        F.array_join(F.transform(items, lambda w: strip(w["text"])), " ").alias("text"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.max("bottom").alias("bottom"),
    )
    return out.withColumn("text", restore_missing_spaces("text"))


def header_boundary(words: DataFrame, bounded: bool = False) -> DataFrame:
    """Where the page header ends: above the largest vertical gap in the top half, else a fifth of the page."""
    tops = words.select(*PAGE, "page_height", F.bround("top", 1).alias("top")).distinct()
    df = running(tops, PAGE, "top", order=["top"], band=_band("top"), lags={"__prev": F.col("top")}, bounded=bounded)
    best = _header_gap(F.col("top"), F.col("__prev"), F.col("page_height"))
    out = df.groupBy(*PAGE).agg(best.alias("b"), F.max("page_height").alias("h"), F.count(F.lit(1)).alias("n"))
    return out.select(*PAGE, _header_cut(F.col("b"), F.col("h"), F.col("n")).alias("boundary"))


def _header_gap(top: Column, prev: Column, h: Column) -> Column:
    """Aggregate: the largest gap in the top half, the upper one of equals, with what stands above it."""
    gap = top - prev
    ok = (top <= h * 0.5) & (gap >= F.greatest(F.lit(6.0), h * 0.01))
    return F.max(F.when(ok, F.struct(gap.alias("g"), (-top).alias("t"), prev.alias("prev"))))


def _header_cut(best: Column, h: Column, n: Column) -> Column:
    cut = F.coalesce(best["prev"], h * 0.2)
    return F.when(n < 2, F.greatest(F.lit(0.0), h * 0.2)).otherwise(F.greatest(F.lit(0.0), F.least(h * 0.45, cut)))


def reading_order_lines(words: DataFrame, tolerance: float = 2.0, bounded: bool = False) -> DataFrame:
    """Lines in reading order: on two-column pages the header, then the left, then the right column."""
    if bounded:
        return lines_from_words(_zones_of_small_pages(words, tolerance), tolerance, [*PAGE, "zone"], bounded)
    bounds = header_boundary(words, bounded)
    df = words.join(bounds, PAGE)
    body = F.col("top") > F.least(F.col("page_height"), F.col("boundary") + tolerance)
    cols = detect_columns(df.where(body))
    df = df.join(cols, PAGE, "left").withColumn("columns", F.coalesce("columns", F.lit(1)))
    return lines_from_words(df.withColumn("zone", _zone(F.col("columns"))), tolerance, [*PAGE, "zone"], bounded)


def _zone(columns: Column) -> Column:
    """Header or single column, left, right."""
    return (
        F.when(columns == 1, F.lit(0))
        .when(F.col("top") <= F.col("boundary"), F.lit(0))
        .when(F.col("x0") < F.col("page_width") / 2.0, F.lit(1))
        .otherwise(F.lit(2))
    )


def _zones_of_small_pages(words: DataFrame, tolerance: float) -> DataFrame:
    """Header boundary, columns and zone of every word in one sort of its page, without a join."""
    df = words.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull()).withColumn("__t", F.bround("top", 1))
    page = Window.partitionBy(*PAGE)
    before = page.orderBy("__t", "page_height")
    all_ = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h, t = F.col("page_height"), F.col("__t")
    prev = F.lag(F.struct("__t", h.alias("h"), F.lit(1).alias("any"))).over(before)
    df = df.withColumn("__p", prev).withColumn("__new", ~(F.col("__p.any").isNotNull() & t.eqNullSafe(F.col("__p.__t")) & h.eqNullSafe(F.col("__p.h"))))
    best, n = _header_gap(t, F.col("__p.__t"), h), F.count_if("__new")
    df = df.withColumns({"__b": best.over(all_), "__h": F.max(h).over(all_), "__n": n.over(all_)})
    df = df.withColumn("boundary", _header_cut(F.col("__b"), F.col("__h"), F.col("__n")))
    body = F.col("top") > F.least(h, F.col("boundary") + tolerance)
    df = df.withColumns({f"__c_{k}": c.over(all_) for k, c in _column_counts(here=body).items()})
    df = df.withColumn("zone", _zone(_columns(pre="__c_")))
    return df.select(*words.columns, "zone")


def bbox_lines(words: DataFrame) -> DataFrame:
    """Words grouped by rounded top, text by x, with the rectangle of the line; top-down."""
    df = words.withColumn("y", F.bround("top", 1))
    items = F.sort_array(F.collect_list(F.struct("x0", "ord", "text", "top", "bottom")))
    out = df.groupBy(*PAGE, "y").agg(items.alias("w"), F.max("x1").alias("x1"))
    text = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    first = F.get("w", F.lit(0))
    return out.select(
        *PAGE, "y", strip(text).alias("text"), first["x0"].alias("x0"), first["top"].alias("top"), "x1", first["bottom"].alias("bottom")
    ).where("text <> ''")


def char_gap_stats(chars: DataFrame, keys: list[str] | None = None, bounded: bool = False) -> DataFrame:
    """Gaps between neighbouring characters of a line: median, p75, p90 by index, and the word-gap threshold.

    Percentiles by index come from a histogram of the gaps, so no page's gaps are collected.
    """
    keys = list(keys or PAGE)
    order = ["top", "x0", "ord"]
    df = running(
        chars, keys, "ord", order=order, band=_band("top"), lags={"__p": F.struct("top", "x1")}, bounded=bounded
    )
    gap = F.col("x0") - F.col("__p.x1")
    near = F.abs(F.col("top") - F.col("__p.top")) < 5
    gaps = df.where(near & (gap > 0) & (gap < 50)).select(*keys, gap.alias("gap"))
    hist = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumn("n", F.sum("c").over(w))
    hist = hist.withColumn("cum", F.sum("c").over(w.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("cum") > F.floor(F.col("n") * share), F.col("gap")))

    hist = hist.withColumn("__median", F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col("gap"))).over(w))
    big = F.col("gap") > F.col("__median") * 2.5
    out = hist.groupBy(*keys).agg(
        F.max("n").alias("gaps"),
        F.max("__median").alias("median"),
        at(0.75).alias("p75"),
        at(0.90).alias("p90"),
        F.coalesce(F.sum(F.when(big, F.col("c"))), F.lit(0)).alias("large"),
        F.max(F.when(~big, F.col("gap"))).alias("letter"),
        F.min(F.when(big, F.col("gap"))).alias("word"),
    )
    enough = F.col("large") >= 3
    threshold = (F.col("letter") + F.col("word")) / 2
    tolerance = F.when(
        enough, F.greatest(F.lit(0.5), F.least(threshold * 0.8, F.col("word") * 0.5))
    ).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("median") * 1.5)))
    return out.select(
        *keys, "gaps", "median", "p75", "p90", tolerance.alias("x_tolerance"), F.when(enough, threshold).alias("space_threshold")
    )


def order_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    return words.orderBy("doc_id", "page", F.bround(F.col("top") / tolerance, 0), "x0")


# --- rectangles -------------------------------------------------------------------------------------------------

_CELL = 50.0


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / _CELL).cast("int"), F.floor(high / _CELL).cast("int"))


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs of a box ``(doc_id, page, box_id, x1, y1, x2, y2)`` and the words of its page that touch it.

    Both sides are cut into horizontal bands, so the join is an equality on (document, page, band); a pair is kept
    only in the first band both share.
    """
    w = words.withColumn("__wb", F.floor(F.col("top") / _CELL).cast("int"))
    w = w.withColumn("__band", F.explode(_bands(F.col("top"), F.greatest("top", "bottom"))))
    b = boxes.select(*PAGE, "box_id", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    b = b.where((F.col("bx1") < F.col("bx2")) & (F.col("by1") < F.col("by2")))
    b = b.withColumn("__bb", F.floor(F.col("by1") / _CELL).cast("int"))
    b = b.withColumn("__band", F.explode(_bands(F.col("by1"), F.col("by2"))))
    c = F.col
    touches = (c("x0") < c("bx2")) & (c("x1") > c("bx1")) & (c("top") < c("by2")) & (c("bottom") > c("by1"))
    pairs = w.join(b, [*PAGE, "__band"]).where(touches & (c("__band") == F.greatest("__wb", "__bb")))
    return pairs.drop("__wb", "__bb", "__band")


def text_in_boxes(words: DataFrame, boxes: DataFrame, tolerance: float = 5.0, bounded: bool = False) -> DataFrame:
    """Text of every box, its lines top to bottom."""
    inside = words_in_boxes(words, boxes)
    lines = lines_from_words(inside, tolerance, [*PAGE, "box_id"], bounded)
    pairs = F.sort_array(F.collect_list(F.struct("line_top", "text")))
    return lines.groupBy(*PAGE, "box_id").agg(F.array_join(F.transform(pairs, lambda x: x["text"]), "\n").alias("text"))


def snap_to_line(boxes: DataFrame, lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """The text line nearest to a selection: within three tolerances of its centre, most overlap, then nearest.

    The reach of three tolerances is the band height, so a line meets the boxes of its own and the two next bands.
    """
    reach = max(1.0, tolerance) * 3
    c = F.col
    b = boxes.withColumn("__cy", (c("y1") + c("y2")) / 2).withColumn("__band", F.floor(c("__cy") / reach))
    ln = lines.select(
        *PAGE, c("line_top").alias("ltop"), c("bottom").alias("lbottom"), c("x0").alias("lx0"), c("x1").alias("lx1")
    ).withColumn("__lc", (c("ltop") + c("lbottom")) / 2)
    here = F.floor(c("__lc") / reach)
    ln = ln.withColumn("__band", F.explode(F.array(here - 1, here, here + 1)))
    pairs = b.join(ln, [*PAGE, "__band"]).where(F.abs(c("__lc") - c("__cy")) <= reach)
    overlap = F.greatest(F.lit(0.0), F.least("lbottom", "y2") - F.greatest("ltop", "y1"))
    best = F.min_by(F.struct("lx0", "ltop", "lx1", "lbottom"), F.struct((-overlap).alias("o"), F.abs(c("__lc") - c("__cy")).alias("d"), "ltop"))
    return pairs.groupBy(*PAGE, "box_id").agg(best.alias("b")).select(
        *PAGE, "box_id", c("b.lx0").alias("x1"), c("b.ltop").alias("y1"), c("b.lx1").alias("x2"), c("b.lbottom").alias("y2")
    )


# Fixed value: placeholder of an empty selection.
EMPTY_SELECTION = "(Текст не найден)"


def merge_fields(extracted: DataFrame) -> DataFrame:
    """One text per (document, field) in page order, placeholders dropped."""
    kept = extracted.where((nz("field_id") != "") & (nz("text") != "") & (F.col("text") != EMPTY_SELECTION))
    items = F.sort_array(F.collect_list(F.struct("page", "seq", "text")))
    text = F.array_join(F.transform(items, lambda x: x["text"]), "\n")
    return kept.groupBy("doc_id", "field_id").agg(strip(text).alias("text"))


# Headings that open and close an abstract on a page.
SPAN_MARKS = {
    "ru": (r"\bаннотация\b", r"\bключев\w*\s*слов\w*\b"),
    "en": (r"\babstract\b", r"\bkeywords?\b|\bkey\s*words?\b|\bindex\s*terms?\b"),
}


def annotation_span(lines: DataFrame, lang: str = "en", min_ratio: float = 0.12, max_ratio: float = 0.6) -> DataFrame:
    """Vertical span of the abstract per page, from its heading to the keyword line, a footer number or a share of
    the page; pages without one are absent. Lines: ``(doc_id, page, line_top, bottom, page_height, text)``."""
    opens, closes = SPAN_MARKS[lang]
    simple = norm_space(F.regexp_replace(F.lower(norm_space("text")), r"(?U)[^\w\s]", " "))
    df = lines.withColumn("__t", simple)
    t, h = F.col("__t"), F.col("page_height")
    heads = df.where(t.rlike("(?U)" + opens)).groupBy(*PAGE).agg(
        F.min_by(F.struct(F.col("line_top").alias("at"), (F.col("bottom") + 2).alias("start")), "line_top").alias("h")
    )
    after = df.join(heads, PAGE).where(F.col("line_top") > F.col("h.at"))
    number = t.rlike(r"\A\d{1,4}\z") | t.rlike(r"(?U)\bpage\b|\bстр\b")
    ends = after.groupBy(*PAGE).agg(
        F.min(F.when(t.rlike("(?U)" + closes), F.col("line_top"))).alias("kw"),
        F.max(F.when(number & (F.col("line_top") >= h * 0.85), F.col("line_top"))).alias("foot"),
    )
    heights = df.groupBy(*PAGE).agg(F.max("page_height").alias("ph"))
    out = heads.join(heights, PAGE).join(ends, PAGE, "left")
    start, ph = F.col("h.start"), F.col("ph")
    kw = F.when((F.col("kw") - 1 - start) >= ph * min_ratio, F.col("kw") - 1)
    end = F.coalesce(kw, F.col("foot") - 1, F.least(ph, start + ph * max_ratio))
    return out.select(*PAGE, start.alias("start_top"), end.alias("end_bottom")).where("end_bottom > start_top")


# --- field templates --------------------------------------------------------------------------------------------

FIELD = ["issn", "field_id"]
CORNERS = ["x1", "y1", "x2", "y2"]


def normalize_samples(samples: DataFrame) -> DataFrame:
    """Absolute rectangles to page-relative ones."""
    w, h = F.col("page_width"), F.col("page_height")
    return samples.withColumns(
        {"x1": F.col("x1") / w, "y1": F.col("y1") / h, "x2": F.col("x2") / w, "y2": F.col("y2") / h}
    )


def latest_samples(samples: DataFrame, keep: int = 20) -> DataFrame:
    """The last samples per (journal, field).

    A template holds few samples, but a raw table may hold very many for one field, so each block of rows first gives
    up all but its own last ones; what is left per field is ranked.
    """
    rest = [c for c in samples.columns if c not in FIELD]
    block = samples.withColumn("__p", F.pmod(F.hash("seq"), F.lit(64)))
    local = Window.partitionBy(*FIELD, "__p").orderBy(F.desc("seq"))
    few = block.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= keep).drop("__r", "__p")
    last = Window.partitionBy(*FIELD).orderBy(F.desc("seq"))
    return few.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= keep).select(*FIELD, *rest)


def average_bbox(samples: DataFrame) -> DataFrame:
    """Mean rectangle on the most frequent page of a field; the page seen first wins ties."""
    pages = samples.groupBy(*FIELD, "page").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), *[F.avg(c).alias(c) for c in CORNERS]
    )
    pick = F.max_by(F.struct("page", "n", *CORNERS), F.struct("n", (-F.col("first")).alias("f")))
    return pages.groupBy(*FIELD).agg(pick.alias("b")).select(*FIELD, "b.page", *[f"b.{c}" for c in CORNERS])


def bbox_confidence(samples: DataFrame) -> DataFrame:
    """0..1 from the number of samples and the spread of their corners."""
    spread = (F.stddev_samp("x1") + F.stddev_samp("y1") + F.stddev_samp("x2") + F.stddev_samp("y2")) / 4
    n = F.count(F.lit(1))
    value = F.least(n / 5, F.lit(1.0)) * F.greatest(F.lit(0.0), F.lit(1.0) - spread * 10)
    return samples.groupBy(*FIELD).agg(
        n.alias("samples"), F.when(n < 2, F.lit(0.0)).otherwise(value).alias("confidence")
    )


def bbox_suggestions(samples: DataFrame, width: float, height: float, min_confidence: float = 0.3) -> DataFrame:
    """Average rectangles of the fields that are certain enough, scaled to a page."""
    kept = bbox_confidence(samples).where(F.col("confidence") >= min_confidence)
    scaled = {"x1": width, "y1": height, "x2": width, "y2": height}
    return (
        average_bbox(samples)
        .join(kept, FIELD)
        .select(*FIELD, "page", *[(F.col(c) * s).alias(c) for c, s in scaled.items()], F.bround("confidence", 2).alias("confidence"), "samples")
    )


def template_summary(samples: DataFrame, processed: DataFrame) -> DataFrame:
    """Journals with their processed articles and the number of known fields; ``pos`` ranks them, busiest first."""
    fields = samples.select(*FIELD).distinct().groupBy("issn").agg(F.count(F.lit(1)).alias("fields"))
    counts = processed.groupBy("issn").agg(F.count(F.lit(1)).alias("processed"))
    met = fields.join(counts, "issn", "left").select("issn", F.coalesce("processed", F.lit(0)).alias("processed"), "fields")
    return positions(met, [], [F.desc("processed"), F.col("issn")])
