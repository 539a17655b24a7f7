"""Joins: journals, source files, requests, cached results, terms, and the choice of the best candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.codes import normalize_issn, parse_issue_key
from ..functions.text import (
    blank_to_null,
    content_hash,
    is_garbled,
    let,
    norm_space,
    normalize_search_title,
    nz,
    strip,
    text_quality,
    word_count,
)
from ..plans.members import Members, gram_key, written
from ..plans.segments import cut, first_per_key, packed

# --- journals ---------------------------------------------------------------------------------------------------


def issue_config(issues: DataFrame, journals: DataFrame) -> DataFrame:
    """Issues ``(issue)`` with a known journal: key parts, titles and an empty volume where there is none."""
    first = first_per_key(
        journals.select(F.upper("ISSN").alias("__issn"), "ord", "Title", "TitleEn"), ["__issn"], F.col("ord")
    )
    keyed = issues.select("issue", parse_issue_key("issue").alias("k")).where("k IS NOT NULL")
    joined = keyed.withColumn("__issn", F.upper("k.issn")).join(first, "__issn")
    return joined.select(
        "issue",
        F.lit(0).alias("titleid"),
        F.col("k.issn").alias("issn"),
        F.col("Title").alias("title_ru"),
        F.coalesce(blank_to_null("TitleEn"), F.col("Title")).alias("title_en"),
        F.col("k.year").alias("year"),
        nz("k.volume").alias("volume"),
        F.col("k.number").alias("number"),
    )


def journal_by_any_issn(df: DataFrame, journals: DataFrame, issn: str = "issn") -> DataFrame:
    """Left join on any of a journal's three numbers; the first journal in list order wins. ``usable`` says that the
    journal takes part in the academy programme and has an address."""
    codes = F.array_distinct(F.array(*[normalize_issn(c) for c in ("ISSN", "ISSN_Print", "ISSN_Online")]))
    long = journals.select("ord", "Title", "Url", "RAS", F.explode(codes).alias("__issn")).where("__issn <> ''")
    first = first_per_key(long, ["__issn"], F.col("ord"))
    usable = (F.upper(strip(nz("RAS"))) == "Y") & (strip(nz("Url")) != "")
    return (
        df.withColumn("__issn", normalize_issn(issn))
        .join(first.withColumn("usable", usable), "__issn", "left")
        .withColumn("usable", F.coalesce("usable", F.lit(False)))
        .drop("__issn")
    )


# --- source files -----------------------------------------------------------------------------------------------

# Names of files that hold a whole issue, and extensions in order of preference.
FULL_ISSUE = "full_issue"
COMMON_NAMES = ["issue", "выпуск", "release", "journal"]
TEXT_EXTENSIONS = [".docx", ".rtf", ".pdf"]
EXTENSIONS = [".idml", ".html", ".docx", ".rtf", ".tex", ".pdf"]


def _first_path(ext: str, test: Column | None = None) -> Column:
    hit = F.col("ext") == ext
    return F.min(F.when(hit if test is None else hit & test, F.col("path")))


def match_source_files(articles: DataFrame, files: DataFrame) -> DataFrame:
    """The file to show for every article ``(issue, stem)`` and the PDF that goes with it.

    Own files join on (issue, stem); files of the whole issue are one row per issue. Priority is a ``coalesce``.
    """
    own = files.groupBy("issue", "stem").agg(*[_first_path(e).alias("own" + e[1:]) for e in EXTENSIONS])
    full = F.col("stem") == FULL_ISSUE
    whole = files.groupBy("issue").agg(
        *[_first_path(e, full).alias("all" + e[1:]) for e in EXTENSIONS if e != ".idml"],
        _first_path(".pdf").alias("anypdf"),
    )
    c = F.col
    own_word, all_word = F.coalesce(c("owndocx"), c("ownrtf")), F.coalesce(c("alldocx"), c("allrtf"))
    early = F.coalesce(c("ownidml"), c("allhtml"), all_word, c("alltex"))
    late = F.coalesce(c("ownhtml"), own_word, c("owntex"))
    pdf = F.coalesce(c("ownpdf"), c("allpdf"))
    any_pdf = F.coalesce(pdf, c("anypdf"))
    return (
        articles.select("issue", "stem")
        .join(own, ["issue", "stem"], "left")
        .join(whole, "issue", "left")
        .select(
            "issue",
            "stem",
            F.coalesce(early, late, any_pdf).alias("file"),
            F.when(early.isNotNull(), pdf).otherwise(any_pdf).alias("pdf"),
        )
    )


def match_issue_file(articles: DataFrame, files: DataFrame) -> DataFrame:
    """Text file of an article: its own, else a file named like a whole issue, else the only file of the folder."""
    texts = files.where(F.col("ext").isin(TEXT_EXTENSIONS))
    own = texts.groupBy("issue", "stem").agg(*[_first_path(e).alias("own" + e[1:]) for e in TEXT_EXTENSIONS])
    named = []
    for i, name in enumerate([F.col("issue"), *map(F.lit, COMMON_NAMES)]):
        named += [_first_path(e, F.col("stem") == name).alias(f"n{i}{e[1:]}") for e in TEXT_EXTENSIONS]
    whole = texts.groupBy("issue").agg(*named, F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    common = F.coalesce(*[F.col(f"n{i}{e[1:]}") for i in range(len(COMMON_NAMES) + 1) for e in TEXT_EXTENSIONS])
    return (
        articles.select("issue", "stem")
        .join(own, ["issue", "stem"], "left")
        .join(whole, "issue", "left")
        .select(
            "issue",
            "stem",
            F.coalesce(
                *[F.col("own" + e[1:]) for e in TEXT_EXTENSIONS], common, F.when(F.col("n") == 1, F.col("only"))
            ).alias("file"),
        )
    )


def pending_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without an output of the same stem."""
    return files.join(done.select("issue", "stem").distinct(), ["issue", "stem"], "left_anti")


# --- locating an article in the text of its issue ---------------------------------------------------------------

# Words of a contents list, and the lines skipped with and without one.
CONTENTS = r"(?iu)содержание|оглавление|contents"
SKIP_AFTER_CONTENTS, SKIP_WITHOUT = 30, 50
_GRAM = 10


# Words of a run that phrase and line must share; a run of three is rare where a word is not.
_RUN = 3


# Runs of a phrase that may become its key.
_ASKED = 4


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words with their issue: a key that moves as one number."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.col("issue"), F.lit(n), *[F.get(words, i + k) for k in range(-1, n - 1)]))


def _with_runs(phrases: DataFrame) -> DataFrame:
    """Phrases of three words and more with ``__p``, which stands for the text, and ``__runs``: of the runs of their inner words
    those with most characters, which are rare as a rule."""
    inner = F.split("phrase", " ")
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))

    def longest(n: int) -> Column:
        def keyed(words: Column) -> Column:
            sizes = F.transform(words, F.length)
            places = F.sequence(F.lit(0), F.size(words) - n)
            chars = let(sizes, lambda s: F.transform(places, lambda i: sum((F.get(s, i + k) for k in range(1, n)), F.get(s, i))))
            runs = F.zip_with(chars, _runs(words, n), lambda c, k: F.struct(c.alias("n"), k.alias("key")))
            return F.transform(F.slice(F.sort_array(F.array_distinct(runs), asc=False), 1, _ASKED), lambda r: r["key"])

        return let(inner, keyed)

    size = F.least(word_count("phrase") - 2, F.lit(_RUN))
    runs = F.coalesce(*[F.when(size == n, longest(n)) for n in range(1, _RUN + 1)])
    return phrases.where(word_count("phrase") >= 3).select("issue", "phrase", F.unhex(F.md5("phrase")).alias("__p"), size.alias("__n"), runs.alias("__runs"))


def _containing(phrases: DataFrame, lines: DataFrame) -> DataFrame:
    """First line that contains each phrase ``(issue, phrase)``, met by equality on a run of words and not by comparing all with all.

    The first and the last word of a phrase may be parts of longer words of the line, but the words between them stand
    there whole and side by side. Of some runs of ``_RUN`` words of theirs (of all of them, when they are fewer) the one rarest in
    the issue is the join key, and a phrase with a run the issue lacks is out. Phrases and lines may bring their ``__runs``.
    """
    long = phrases if "__runs" in phrases.columns else _with_runs(phrases)
    if "__runs" not in lines.columns:
        lines = lines.withColumn("__runs", F.concat(*[_runs(F.split("norm", " "), n) for n in range(1, _RUN + 1)]))
    asked = long.select("issue", "__p", F.explode("__runs").alias("__w"))
    runs = lines.select("line_no", F.explode(F.array_distinct("__runs")).alias("__w"))
    runs = runs.join(asked.select("__w").distinct(), "__w", "left_semi")
    frequency = runs.groupBy("__w").agg(F.count(F.lit(1)).alias("__f"))
    # A phrase with a run that no line has keeps a null here and is out.
    weighed = asked.join(frequency, "__w", "left").groupBy("issue", "__p")
    keyed = weighed.agg(
        F.min_by("__w", F.struct("__f", "__w")).alias("__w"), F.count_if(F.col("__f").isNull()).alias("__lost")
    ).where("__lost = 0").drop("__lost")
    # Hashes that collide are told apart here, where phrase and line meet.
    pairs = keyed.join(runs, "__w").join(long.select("issue", "__p", "phrase"), ["issue", "__p"]).select("issue", "phrase", "line_no")
    hits = pairs.join(lines.select("issue", "line_no", "norm"), ["issue", "line_no"]).where(F.col("norm").contains(F.col("phrase")))
    return hits.groupBy("issue", "phrase").agg(F.min("line_no").alias("line_no"))


def _containing_short(phrases: DataFrame, lines: DataFrame) -> DataFrame:
    """The same for one or two words, met on the first ten characters; only issues with such phrases are cut up."""
    short = phrases.where((word_count("phrase") < 3) & (F.length("phrase") >= _GRAM))
    short = short.withColumn("__g", F.substring("phrase", 1, _GRAM))
    wanted = lines.join(short.select("issue").distinct(), "issue", "left_semi").where(F.length("norm") >= _GRAM)
    starts = F.sequence(F.lit(1), F.length("norm") - _GRAM + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("norm", i, F.lit(_GRAM))))
    right = wanted.select("issue", "line_no", F.explode(grams).alias("__g"))
    right = right.join(short.select("issue", "__g").distinct(), ["issue", "__g"], "left_semi")
    pairs = short.join(right, ["issue", "__g"]).select("issue", "phrase", "line_no")
    hits = pairs.join(lines, ["issue", "line_no"]).where(F.col("norm").contains(F.col("phrase")))
    return hits.groupBy("issue", "phrase").agg(F.min("line_no").alias("line_no"))


# Width of a line's number inside its part; what stands above it is the part, 0 for a line that has its number in the issue.
_PLACE = 1 << 40


def _place(part: Column, line_no: Column) -> Column:
    """One number that grows with part and line, so the first line is a hash aggregate."""
    above = F.coalesce(part.cast("decimal(20,0)") + F.lit(str((1 << 63) + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    above = (above.cast("decimal(20,0)") * F.lit(str(_PLACE)).cast("decimal(13,0)")).cast("decimal(38,0)")
    return (above + line_no.cast("decimal(13,0)")).cast("decimal(38,0)")


def _part_of(place: Column) -> tuple[Column, Column]:
    """The part of a place, null for a line that has its number in the issue, and the number."""
    width = F.lit(str(_PLACE)).cast("decimal(13,0)")
    line = place % width
    part = ((place - line).cast("decimal(38,0)") / width).cast("decimal(20,0)") - F.lit(str((1 << 63) + 1)).cast("decimal(20,0)")
    return F.when(place >= width, part.cast("bigint")), line.cast("bigint")


def _after_contents(marked: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Lines behind the contents list, or behind the first lines where there is none.

    Where a list ends is one row per issue or, of parts, one per part that begins before it: a table of known size.
    """
    marks = marked.where(F.col("norm").rlike(CONTENTS))
    begin = F.coalesce(F.col("__first") + SKIP_AFTER_CONTENTS, F.lit(SKIP_WITHOUT))
    if starts is None:
        firsts = written(marks.groupBy("issue").agg(F.min("line_no").alias("__first")), "marks")
        return marked.join(firsts, "issue", "left").where(F.col("line_no") >= begin).drop("__first")
    first = marks.groupBy("issue", "part").agg(F.min("line_no").alias("line_no")).join(starts, ["issue", "part"])
    first = first.groupBy("issue").agg(F.min(F.col("start") + F.col("line_no")).alias("__first"))
    early = starts.join(first, "issue", "left").withColumn("__begin", begin)
    early = early.join(early.where("start < __begin").select("issue", "part").distinct(), ["issue", "part"], "left_semi")
    early = written(early.select("issue", "part", "start", "__begin"), "marks")
    marked = marked.where("part IS NOT NULL")
    # Lines of a part that lies behind it whole keep their number in the part.
    met = marked.join(early, ["issue", "part"], "left").where("start IS NULL OR start + line_no >= __begin")
    place = _place(F.when(F.col("start").isNull(), F.col("part")), F.coalesce("start", F.lit(0)) + F.col("line_no"))
    return met.withColumn("line_no", place).drop("part", "start", "__begin")


def _hashes(words: Column, kind: int) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.col("issue"), F.lit(kind), w))


# Kinds of keys of a line beside its runs of one to three words.
_WHOLE, _WORD, _CHARS, _NAME = 4, 5, 6, 7


def _words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def _asked_lines(usable: DataFrame, long: DataFrame, short: DataFrame, names: DataFrame) -> DataFrame:
    """The lines that may have a phrase, with the keys that they share with phrases; an issue's lines are cut only in the ways
    that it asks for. ``long``: phrases of three words and more with their runs; ``short``: the others; ``names``: by first word."""
    whole, chars = short.where(F.length("phrase") < _GRAM), short.where(F.length("phrase") >= _GRAM)
    keys = [
        long.select("issue", F.col("__n").alias("kind"), F.explode("__runs").alias("key")),
        whole.select("issue", F.lit(_WHOLE).alias("kind"), F.xxhash64(F.col("issue"), F.lit(_WHOLE), F.col("phrase")).alias("key")),
        names.select("issue", F.lit(_NAME).alias("kind"), F.xxhash64(F.col("issue"), F.lit(_NAME), F.col("__w")).alias("key")),
        chars.select("issue", F.lit(_CHARS).alias("kind"), gram_key(F.col("phrase")).alias("key")),
    ]
    asked = written(reduce(DataFrame.unionByName, keys).where("issue IS NOT NULL"), "asked")
    wanted = written(asked.groupBy("issue").agg(F.sort_array(F.collect_set("kind")).alias("__kinds")), "kinds")
    # Words are a column: a Python function takes no expression with a lambda inside a lambda.
    cuts = {n: _runs(F.col("__words"), n) for n in range(1, _RUN + 1)}
    cuts |= {_WHOLE: _hashes(F.array("norm"), _WHOLE), _NAME: _hashes(_words("norm"), _NAME)}
    none = F.array().cast("array<bigint>")
    keys = F.concat(*[F.when(F.array_contains("__kinds", k), cut).otherwise(none) for k, cut in cuts.items()])
    met = usable.join(wanted, "issue").withColumn("__words", F.split("norm", " ")).withColumn("__keys", keys)
    text = F.when(F.array_contains("__kinds", _CHARS), F.col("norm"))
    met = met.withColumns({"__at": Members(asked.where(F.col("kind") != _CHARS)).asked(F.col("__keys")), "__short": Members(asked.where(F.col("kind") == _CHARS)).any_gram(text)})
    met = met.where((F.size("__at") > 0) | F.col("__short"))
    return met.select("issue", "line_no", "norm", F.transform("__at", lambda i: F.get("__keys", i)).alias("__runs"), "__short")


def locate_article(articles: DataFrame, lines: DataFrame, bounded: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """Start line (1-based) of every article ``(issue, name, surname, title)`` in the lines of its issue
    ``(issue, line_no, text)``, null when it is not found.

    After the contents list: the author's surname as a word, then the title, then its first words; earliest line.
    Lines may also be numbered inside the parts of their issue: ``(issue, part, line_no, text)`` with ``starts``
    ``(issue, part, start)``, the lines before each part; parts stand in the order of their numbers, and no text moves to number it.
    Lines stay where they are but for those that have a key of a phrase (:mod:`galley.plans.members`), which are written to the
    checkpoint folder; with ``bounded`` the lines are few enough to be taken all and made anew for each rule. Lines and
    phrases that repeat inside an issue are met once, by their first line.
    """
    asking = articles.select("issue", "name", F.lower(norm_space("surname")).alias("surname"), F.lower(norm_space("title")).alias("title"))
    if not bounded:
        asking = written(asking, "articles")
    if starts is not None and not bounded:
        starts = written(starts.select("issue", "part", F.col("start").cast("bigint").alias("start")), "starts")
    marked = lines.withColumn("norm", F.lower(norm_space("text")))
    usable = _after_contents(marked, starts).where(~P.is_toc_line("text")).select("issue", "line_no", "norm")

    who = asking.select("issue", "name", F.col("surname").alias("phrase")).where(F.length("phrase") >= 2)
    simple = F.col("phrase").rlike(r"(?U)\A\w+\z")
    compound = who.where(~simple).select("issue", "phrase").distinct().withColumn("__w", F.regexp_extract("phrase", r"(?U)\A\W*(\w+)", 1))
    titles = asking.select("issue", "name", F.col("title").alias("phrase")).where("phrase <> ''")
    first_words = F.array_join(F.slice(F.split("phrase", " "), 1, 5), " ")
    asked = titles.where(F.length("phrase") >= _GRAM).withColumn("rank", F.lit(1))
    heads = titles.where(word_count("phrase") >= 3).withColumn("phrase", first_words).withColumn("rank", F.lit(2))
    # Titles and their first words share one pass, and articles of one issue share a phrase: its first line is found once.
    wanted = asked.unionByName(heads)
    phrases = wanted.select("issue", "phrase").distinct()

    # A surname is a whole word, so words are the join key. Of a frequent word only the first line matters: the earliest
    # place is found before anything is joined. A compound surname is met on its first word and looked up in the line.
    words = _words("norm")
    if not bounded:
        surnames = who.where(simple).select("issue", F.xxhash64(F.col("issue"), F.lit(_WORD), F.col("phrase")).alias("key")).where("issue IS NOT NULL")
        asked_words = Members(surnames.select("key").distinct()).asked(_hashes(F.col("__words"), _WORD))
        in_issue = usable.join(written(surnames.select("issue").distinct(), "issues"), "issue", "left_semi")
        told = in_issue.select("issue", "line_no", words.alias("__words")).withColumn("__at", asked_words)
        word_rows = told.select("issue", "line_no", F.explode(F.transform("__at", lambda i: F.get("__words", i))).alias("phrase"))
    else:
        word_rows = usable.select("issue", "line_no", F.explode(words).alias("phrase"))
    earliest = word_rows.groupBy("issue", "phrase").agg(F.min("line_no").alias("line_no"))
    by_word = who.where(simple).join(earliest, ["issue", "phrase"])

    short = asked.where(word_count("phrase") < 3).select("issue", "phrase").distinct()
    if not bounded:
        phrases = written(_with_runs(phrases), "phrases")
        whole = titles.where(F.length("phrase") < _GRAM).select("issue", "phrase").distinct()
        usable = _asked_lines(usable, phrases, short.unionByName(whole), compound)
        usable = written(usable.groupBy("issue", "norm", "__runs", "__short").agg(F.min("line_no").alias("line_no")), "lines")
        usable_short = usable.where("__short")
    else:
        usable = usable_short = usable.groupBy("issue", "norm").agg(F.min("line_no").alias("line_no"))
    padded = F.concat(F.lit(" "), F.regexp_replace("norm", r"(?U)[^\w]", " "), F.lit(" "))
    needle = F.concat(F.lit(" "), F.regexp_replace("phrase", r"(?U)[^\w]", " "), F.lit(" "))
    named = compound.select("issue").distinct()
    told = usable.join(named if bounded else written(named, "names"), "issue", "left_semi")
    told = told.select("issue", "line_no", F.explode(F.array_distinct(_words("norm"))).alias("__w"))
    told = told.join(compound.select("issue", "__w").distinct(), ["issue", "__w"], "left_semi")
    in_line = (
        compound.join(told, ["issue", "__w"])
        .join(usable, ["issue", "line_no"])
        .where(F.col("norm").contains(F.col("phrase")) & padded.contains(needle))
        .groupBy("issue", "phrase")
        .agg(F.min("line_no").alias("line_no"))
    )
    by_name = who.where(~simple).join(in_line, ["issue", "phrase"])
    author = ["issue", "name", "line_no", F.lit(0).alias("rank")]
    by_author = by_word.select(*author).unionByName(by_name.select(*author))
    # A longer title that is a line stands in that line, too.
    brief = usable.where(F.length("norm") < _GRAM).select("issue", F.col("norm").alias("phrase"), "line_no")
    equal = titles.where(F.length("phrase") < _GRAM).join(brief, ["issue", "phrase"])
    places = _containing(phrases, usable).unionByName(_containing_short(short, usable_short))
    cols = ["issue", "name", "line_no", "rank"]
    found = (
        by_author.unionByName(equal.select("issue", "name", "line_no", F.lit(1).alias("rank")))
        .unionByName(wanted.join(places, ["issue", "phrase"]).select(*cols))
    )
    best = found.groupBy("issue", "name").agg(F.min(F.struct("rank", "line_no")).alias("b")).select("issue", "name", F.col("b.line_no").alias("line_no"))
    if starts is not None:
        part, line = _part_of(F.col("line_no"))
        begins = starts.groupBy("issue", "part").agg(F.min("start").alias("start"))
        best = best.select("issue", "name", part.alias("part"), line.alias("line_no")).join(begins, ["issue", "part"], "left")
        best = best.select("issue", "name", (F.coalesce("start", F.lit(0)) + F.col("line_no")).alias("line_no"))
    return asking.select("issue", "name").join(best, ["issue", "name"], "left").select(
        "issue", "name", (F.col("line_no") + 1).alias("start_line")
    )


# --- requests ---------------------------------------------------------------------------------------------------


# Words that a cut title must have, so that a common beginning is not taken for one.
CUT_WORDS = 3


def match_requests(requests: DataFrame, publications: DataFrame) -> DataFrame:
    """Publication of every request ``(request_id, doi, title)`` from ``(url, doi, title, ord)``.

    Passes in order: DOI and title, DOI, title, a cut title, first twelve words, first seventy characters. A request of
    ``CUT_WORDS`` words or more that begins a publication's title at a word border is a cut title. Each pass is an equi join:
    a publication is listed under every beginning of its title, and of each beginning the first publication is kept
    before anything meets, so a frequent one is a single row. The short-title passes compare the same cut of both titles.
    The first hit of the first pass wins.
    """
    doi, title = F.lower(strip(nz("doi"))), F.lower(normalize_search_title("title"))

    def shorter(t: Column) -> tuple[Column, Column]:
        return F.array_join(F.slice(F.split(t, " "), 1, 12), " "), strip(F.substring(t, 1, 70))

    q = requests.select("request_id", doi.alias("d"), title.alias("t"))
    # A publication's place is one number, so the first of a key is a hash aggregate that sorts and moves no text but the key.
    listed = publications.select("url", "ord")
    p = publications.select(packed(listed, [F.col("ord")]).alias("place"), doi.alias("d"), title.alias("t"))
    q12, q70 = shorter(F.col("t"))
    q = q.withColumn("t12", F.when((F.length(q12) > 20) & (q12 != F.col("t")), q12))
    q = q.withColumn("t70", F.when((F.length(q70) > 25) & (q70 != F.col("t")), q70))
    p = p.withColumn("t12", shorter(F.col("t"))[0]).withColumn("t70", shorter(F.col("t"))[1])
    # The beginnings of a title, word by word, without the whole; of a request only itself.
    words = F.split(F.col("t"), " ")
    sizes = F.sequence(F.lit(CUT_WORDS), F.greatest(F.size(words) - 1, F.lit(CUT_WORDS)))
    begins = F.when(F.size(words) > CUT_WORDS, F.transform(sizes, lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")))
    p = p.withColumn("cuts", F.coalesce(begins, F.array().cast("array<string>")))
    q = q.withColumn("cuts", F.when(F.size(words) >= CUT_WORDS, F.array("t")).otherwise(F.array().cast("array<string>")))

    # Candidates meet on one key column, so all passes cost one join: key = kind of cut plus its value.
    def keys() -> Column:
        d, t = F.col("d"), F.col("t")
        parts = [
            F.when((d != "") & (t != ""), F.concat(F.lit("1|"), d, F.lit("|"), t)),
            F.when(d != "", F.concat(F.lit("2|"), d)),
            F.when(t != "", F.concat(F.lit("3|"), t)),
            F.when(F.col("t12").isNotNull() & (t != ""), F.concat(F.lit("5|"), F.col("t12"))),
            F.when(F.col("t70").isNotNull() & (t != ""), F.concat(F.lit("6|"), F.col("t70"))),
        ]
        cuts = F.transform("cuts", lambda c: F.concat(F.lit("4|"), c))
        return F.explode(F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()), cuts))

    # A digest stands for a key: keys are long and alike, so what packs to little would fill a task's memory.
    digest = F.unhex(F.sha2("k", 256)).alias("k")
    first = p.select("place", keys().alias("k")).select("place", digest).groupBy("k").agg(F.min("place").alias("place"))
    asked = q.select("request_id", keys().alias("k")).select("request_id", F.substring("k", 1, 1).cast("int").alias("n"), digest)
    hits = asked.join(first, "k").select("request_id", "n", "place")
    passes = range(1, 7)
    best = hits.groupBy("request_id").agg(F.min("n").alias("pass_no"), *[F.min(F.when(F.col("n") == n, F.col("place"))).alias(f"__{n}") for n in passes])
    best = best.select("request_id", "pass_no", F.coalesce(*[F.col(f"__{n}") for n in passes]).alias("place"))
    urls = listed.select(packed(listed, [F.col("ord")]).alias("place"), "url").join(best.select("place").distinct(), "place", "left_semi").distinct()
    met = best.join(urls, "place", "left")
    return requests.select("request_id").join(met, "request_id", "left").select("request_id", "pass_no", "url")


def merge_language_pages(ru: DataFrame, en: DataFrame, key: str = "url") -> DataFrame:
    """The English page fills what is blank: title, English abstract, abstract, English references."""
    names = ["title", "abstract_en", "references_en"]
    right = en.select(key, *[F.col(c).alias(f"__en_{c}") for c in names])

    def fill(own: str, other: str) -> Column:
        have = norm_space(own)
        return F.when(have != "", F.col(own)).otherwise(
            F.coalesce(F.when(norm_space(f"__en_{other}") != "", F.col(f"__en_{other}")), F.col(own))
        )

    merged = ru.join(right, key, "left")
    out = {
        "title": fill("title", "title"),
        "abstract_en": fill("abstract_en", "abstract_en"),
        "abstract": fill("abstract", "abstract_en"),
        "references_en": fill("references_en", "references_en"),
    }
    return merged.select(*[out[c].alias(c) if c in out else F.col(c) for c in ru.columns])


def cached_results(requests: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` by content hash."""
    hashed = requests.withColumn("hash", content_hash(text))
    known = cache.select("hash", "result")
    return hashed.join(known, "hash"), hashed.join(known, "hash", "left_anti")


# --- candidates -------------------------------------------------------------------------------------------------

# Score of each agreement, the bonus of article XML and the score at which later stages are skipped.
SCORES = {"doi": 10, "title": 8, "title_inside": 5, "abstract": 2, "references": 2, "pages": 1}
JATS_BONUS = 3
GOOD_ENOUGH = 10


def score_candidate(df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the agreement of a candidate with the request (``req_doi``, ``req_title``)."""
    want_title, want_doi = F.lower(norm_space("req_title")), F.lower(norm_space("req_doi"))
    title = F.lower(F.when(nz("title") != "", norm_space("title")).otherwise(norm_space("original_title")))
    doi = F.lower(norm_space("doi"))

    def points(test: Column, key: str) -> Column:
        return F.when(test, F.lit(SCORES[key])).otherwise(F.lit(0))

    def any_filled(*names: str) -> Column:
        return P.any_of([nz(n) != "" for n in names])

    score = (
        points((want_doi != "") & (doi == want_doi), "doi")
        + points((want_title != "") & (title == want_title), "title")
        + points((want_title != "") & title.contains(want_title), "title_inside")
        + points(any_filled("abstract", "abstract_ru", "abstract_en"), "abstract")
        + points(any_filled("references", "references_ru", "references_en"), "references")
        + points(any_filled("pages"), "pages")
        + F.when(F.col("source") == "jats", F.lit(JATS_BONUS)).otherwise(F.lit(0))
    )
    return df.withColumn(out, score)


def best_candidate(cands: DataFrame, key: str = "request_id") -> DataFrame:
    """Highest score per request; the first evaluated wins ties. A later stage counts only while the best of the
    earlier ones is below the good-enough score.

    Per (request, stage) only the best row survives the map-side combine, so at most one row per stage meets again.
    """
    rest = [c for c in cands.columns if c != key]
    ranked = F.struct(F.col("score").alias("s"), (-F.col("stage")).alias("g"), (-F.col("ord")).alias("o"))
    staged = cands.groupBy(key, "stage").agg(
        F.max_by(F.struct(*rest), ranked).alias("row"), F.max("score").alias("top"), F.max(ranked).alias("rank")
    )
    folded = staged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stage", "top", "rank", "row"))).alias("st"))
    first = F.element_at("st", 1)
    best = F.aggregate(
        F.slice("st", F.lit(2), F.greatest(F.size("st") - 1, F.lit(0))),
        first,
        lambda acc, x: F.when((acc["top"] < GOOD_ENOUGH) & (x["top"] > acc["top"]), x).otherwise(acc),
    )
    return folded.select(key, best["row"].alias("r")).select(key, "r.*")


def best_extraction(cands: DataFrame, key: str = "area_id", lang: str = "lang") -> DataFrame:
    """Candidate text with the lowest quality distance; a garbled one pays a penalty; first wins ties.

    Every text is read for its score once: the scores are written without the texts, and the best find their rows.
    """
    score = text_quality("text", lang) + F.when(is_garbled("text", lang), F.lit(100.0)).otherwise(F.lit(0.0))
    rest = [c for c in cands.columns if c != "score"]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    scored = cut(cands.select(F.col(key).alias("__key"), "ord", row.alias("__row"), score.alias("score")))
    best = first_per_key(scored, ["__key"], F.col("score"), F.col("ord")).withColumnRenamed("ord", "__ord")
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("ord").eqNullSafe(F.col("__ord")) & (row == F.col("__row"))
    # A row that is there several times is taken once.
    return cands.select(*[F.col(f"`{c}`") for c in rest]).join(best, same).select(*[F.col(f"`{c}`") for c in rest], "score").distinct()


def find_terms(words: DataFrame, terms: Sequence[str], expand=(0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """First word of every page that contains a term, with its clamped, expanded rectangle.

    ``terms`` is an argument list, so matching is an expression and not a join.
    """
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    exploded = words.select("doc_id", "page", "ord", "text", "x0", "top", "x1", "bottom", "page_width", "page_height", F.explode(hits).alias("term"))
    first = first_per_key(exploded, ["doc_id", "page", "term"], F.col("ord"))
    left, up, right, down = (F.lit(float(v)) for v in expand)
    zero = F.lit(0.0)
    return first.select(
        "doc_id", "page", "term", "ord", "text", "x0", "top", "x1", "bottom",
        F.greatest(zero, F.col("x0") - left).alias("ex0"),
        F.greatest(zero, F.col("top") - up).alias("etop"),
        F.least(F.col("page_width"), F.col("x1") + right).alias("ex1"),
        F.least(F.col("page_height"), F.col("bottom") + down).alias("ebottom"),
    )


