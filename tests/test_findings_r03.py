"""Findings of the third review: each would have failed before its change."""

import os
import random
import re

from pyspark.sql import functions as F

from galley.catalog import article_jobs, layout_jobs, page_jobs
from galley.catalog.issue_jobs import JOURNALS
from galley.functions import nodes as N
from galley.functions.schema_rules import joint_paths
from galley.operators import issues as K
from galley.operators import layout as Y
from galley.operators import matching as M
from galley.operators import references as R
from galley.operators import warehouse
from galley.plans import segments
from galley.sources import issue_files


def test_section_under_a_heading_without_vowels(spark, tmp_path):
    """the section under the first heading, whatever letters the heading has."""
    page = "<html><body><article><h1>Nd, Nd, </h1><p><b>Nd <br><p>Erreth was.</p></article></body></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in page_jobs.section_text(spark, str(tmp_path)).collect()] == [(1, "Nd Erreth was.")]


def test_copies_in_an_issue_meet_once(spark):
    """a phrase that many articles share meets the first of many equal lines, and only lines with a run of its words."""
    lines = spark.createDataFrame([("i", 7, "xon the origin of bright speciesy"), ("i", 8, "origin of the bright")], "issue string, line_no long, norm string")
    phrases = spark.createDataFrame([("i", "on the origin of bright species"), ("i", "of origin the bright"), ("j", "on the origin of")], "issue string, phrase string")
    assert [tuple(r) for r in M._containing(phrases, lines).collect()] == [("i", "on the origin of bright species", 7)]
    text = [("i", n, "On the origin of bright species") for n in range(200)]
    found = M.locate_article(
        spark.createDataFrame([("i", f"a{k}", "", "On the origin of bright species again") for k in range(200)], "issue string, name string, surname string, title string"),
        spark.createDataFrame(text, "issue string, line_no long, text string"),
    )
    assert {r["start_line"] for r in found.collect()} == {51} and found.count() == 200


ODD = ["<p>a &amp b</p>", "text alone &amp", "a<b>c</i>d", "<P>Up</P>", "<p class=x>y", "<br/><img src=\"a\" />", "<!-- c --><p>z</p>", "<a href=\"x>y\">q</a>", "<script>var t=\"</p>\";</script >tail",
       "<style>p{}</STYLE><p>v", "<script>open", "<p a=\"1\" a=\"2\">w</p>", "</p>stray", "<title>A &lt; B</title>", "<meta name=\"n\" content=\"R&amp;D\">", "<template><p>in</p></template>out",
       "<p\n>n</p>", "a < b", "<>", "<p a=\"1\"b=\"2\">x</p>", "&", "<p>\u00a0x\u2003y</p>", "<?pi?>", "<!doctype html><h1>h</h1>", "</p class=\"x\">", "<textarea><p>t</textarea>", "<p>cut &am"]


def _library(page):
    lister = N._Lister()
    lister.feed(page)
    return lister.finish()


def test_usual_pages_are_read_as_the_library_reads_them():
    """the short way gives the library's elements and texts, also where pieces of odd pages stand together."""
    rng, plain = random.Random(3), 0
    for k in range(4000):
        page = "".join(rng.choices(ODD, k=rng.randint(1, 5))) if k >= len(ODD) else ODD[k]
        want, got = _library(page), N._list_page(page)
        assert (got.nodes, got.texts) == (want.nodes, want.texts), page
        plain += N._list_plain(page) is not None
    assert plain > 200


def test_issues_that_a_task_has_whole_are_written_once(spark, tmp_path):
    """only the first and the last issue of a task pass through pieces."""
    rows = [(f"issue {k:02d}", i, f"<a>{i} й</a>") for k in range(60) for i in range(5)]
    parts = spark.createDataFrame(rows, "issue string, place int, xml string").repartition(7)
    made = issue_files.write_issue_files(spark, parts, ["place"], str(tmp_path / "out"), str(tmp_path / "work")).collect()
    assert sorted((r.issue, r.file) for r in made) == [(f"issue {k:02d}", f"issue {k:02d}.xml") for k in range(60)]
    text = issue_files.DECLARATION + "".join(f"<a>{i} й</a>\n" for i in range(5))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(r.file for r in made)
    for r in made:
        assert (tmp_path / "out" / r.file).read_bytes() == text.encode() and r.bytes == len(text.encode())
    pieces = sum(p.stat().st_size for p in next((tmp_path / "work").iterdir()).glob("*.xml"))
    assert 0 < pieces < sum(r.bytes for r in made) / 2


def test_an_attempt_that_fails_leaves_no_half_file(tmp_path, monkeypatch):
    """an attempt that is lost in the middle of an issue leaves no part of it where the issues are."""

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 1

    monkeypatch.setattr(issue_files, "TaskContext", Context)
    writer = issue_files.PieceWriter(str(tmp_path / "pieces"), str(tmp_path / "out"))

    def broken():
        yield from ({"issue": i, "xml": x} for i, x in (("a", "<a/>"), ("b", "<b/>"), ("c", "<c>")))
        raise RuntimeError("lost")

    try:
        writer.write(broken())
    except RuntimeError:
        pass
    assert os.listdir(tmp_path / "out") == ["b.xml"]


def test_texts_of_articles_are_not_sent_to_the_driver(spark):
    """the issues that are written meet the articles' texts over a shuffle, however small Spark takes the texts for."""
    sf = "/root/testdata/sf0.001"
    plan = K.issue_xml_parts(article_jobs.records(spark, sf), JOURNALS.df(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def _exchanges(df):
    """Exchanges in the plan as it is before it runs."""
    return re.findall(r"\bExchange (\w+)\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def _documents(spark, path):
    rows = [(d, " ".join(f"w{d}, {i} Aa" for i in range(400)), "en", "s", 1) for d in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_words_and_characters_stay_with_their_document(spark, tmp_path):
    """texts are dealt by document before they are set out; no word, character or line is shuffled."""
    sf = _documents(spark, tmp_path)
    for job in (layout_jobs.reading_order_lines, layout_jobs.char_gap_stats, layout_jobs.bbox_lines, layout_jobs.lines_from_words):
        made = job(spark, sf)
        dealt = _exchanges(made)
        assert len(dealt) == 1 and dealt[0][0] == "hashpartitioning" and dealt[0][1].startswith("doc_id"), job.__name__
        assert made.select("doc_id").distinct().count() == 8


def test_small_pages_are_zoned_as_by_joins(spark):
    """header, columns and lines of a page by windows are those by joins; blank, missing and spaced words too."""
    rng = random.Random(4)
    rows = []
    for page in range(6):
        for i in range(60):
            text = rng.choice(["a", "b c", " d ", " e", "", None, "  ", "f,G", "x "])
            top = rng.choice([0.0, 1.0, 2.5, 4.0, 100.0, 101.5, 140.0 + i, 300.0 + 3 * (i // 4)])
            x0 = rng.choice([10.0, 20.0, 290.0, 400.0, 420.0]) if page % 2 else rng.choice([10.0, 400.0])
            rows.append((1, page, i, text, x0, x0 + rng.choice([5.0, 30.0]), top, top + 9, 600.0, 800.0))
    words = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    for job in (Y.reading_order_lines, Y.lines_from_words):
        assert sorted(map(str, job(words, bounded=True).collect())) == sorted(map(str, job(words).collect()))
    assert not re.search(r"\w+Join", Y.reading_order_lines(words, bounded=True)._jdf.queryExecution().executedPlan().toString())


def test_requests_meet_places_and_no_texts(spark):
    """the first publication of a key is a hash aggregate over numbers; equal places are told apart by their address."""
    pubs = spark.createDataFrame([("u1", "10.1/a", "One two three four", 5), ("u2", "", "Quite another title here", 5), ("u3", "10.1/A", "One two three five", 2)], "url string, doi string, title string, ord bigint")
    asked = [(1, "10.1/a", "one two three four"), (2, "10.1/a", ""), (3, "", "one two three"), (4, "", "quite another title"), (5, "", "nothing"), (6, None, "quite another title here")]
    out = M.match_requests(spark.createDataFrame(asked, "request_id bigint, doi string, title string"), pubs)
    assert [tuple(r) for r in out.orderBy("request_id").collect()] == [(1, 1, "u1"), (2, 2, "u3"), (3, 4, "u3"), (4, 4, "u2"), (5, None, None), (6, 3, "u2")]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_part_facts_normalize_a_part_once(spark):
    """facts of a part are told from its normalized text, which is computed once and not at every use."""
    plan = spark.createDataFrame([("x",)], "text string").select(R._part_facts(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"\s+,  ") <= 3
    text = "REFERENCES\n1. Smith J. Paper-\n   \nlower. 1999\n\nReceived 1 May\nТекст"
    got = spark.createDataFrame([(text,)], "text string").select(F.explode(R.paragraphs("text")).alias("t")).collect()
    assert [r["t"] for r in got] == ["REFERENCES", "1. Smith J. Paper-", "lower. 1999", "Received 1 May", "Текст"]


def test_f23_rules_share_expressions_within_the_engines_limit(spark):
    """Forty rules, one expression each before, and documents that break several of them."""
    names = [f"e{k}" for k in range(40)]
    paths = joint_paths([f"boolean(/j[not({n})])" for n in names])
    assert len(paths) < 10
    lacking = [set(), {0}, {3, 7, 39}, set(range(40))]
    rows = [(i, f"<j>{''.join(f'<{n}/>' for k, n in enumerate(names) if k not in gone)}</j>") for i, gone in enumerate(lacking)]
    docs = spark.createDataFrame(rows, "i int, x string")
    told = docs.select("i", F.concat(*[F.xpath_string("x", F.lit(p)) for p in paths]).alias("codes")).collect()
    assert {r.i: r.codes for r in told} == {i: "".join(f"{k:04d}" for k in sorted(gone)) for i, gone in enumerate(lacking)}


def test_f19_f21_the_order_is_made_once_a_row(spark, monkeypatch):
    """Start pages are columns before rows are sorted."""
    articles = spark.createDataFrame([("i", f"n{k}", f"{97 * k % 50}-60") for k in range(50)], "issue string, name string, pages string")
    orders = []
    monkeypatch.setattr(warehouse, "positions", lambda df, keys, order: orders.append((df, order)) or df)
    warehouse.order_articles(articles)
    warehouse.order_listing(articles)
    for df, order in orders:
        plan = df.sort(*order)._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert plan.startswith("Sort") and "regexp" not in plan and "CASE" not in plan
    monkeypatch.undo()
    got = {r.name: r.pos for r in warehouse.order_articles(articles).collect()}
    ranked = sorted(range(50), key=lambda k: (97 * k % 50, f"n{k}"))
    assert got == {f"n{k}": place for place, k in enumerate(ranked, 1)}


def test_f22_texts_are_read_for_their_score_once(spark, monkeypatch):
    """No text comes to the choice of the first; ties, rows that repeat and a missing ordinal as before."""
    cands = spark.createDataFrame([(1, 2, "bbb bbb", "en"), (1, 1, "bbb bbb", "en"), (1, 1, "bbb bbb", "en"), (2, None, "x", "en")], "area_id int, ord int, text string, lang string")
    seen = []
    monkeypatch.setattr(M, "first_per_key", lambda df, *rest: seen.append(df.columns) or segments.first_per_key(df, *rest))
    assert sorted((r.area_id, r.ord) for r in M.best_extraction(cands).collect()) == [(1, 1), (2, None)]
    assert seen and all("text" not in columns for columns in seen)


def test_f18_tags_and_texts_are_told_apart_without_marking_every_tag(spark):
    """Empty elements are closed and each ``>`` of a text is escaped, also several in a row and beside a tag."""
    cases = {
        "<a><b></b></a>": "<a><b/></a>",
        '<a><abc lang="RUS"></abc></a>': '<a><abc lang="RUS"/></a>',
        "<a>1 > 2 >> 3></a>": "<a>1 &gt; 2 &gt;&gt; 3&gt;</a>",
        "<a>></a>": "<a>&gt;</a>",
        "<ab><abc>x &lt;5></abc></ab>": "<ab><abc>x &lt;5&gt;</abc></ab>",
        "<a>\n    <b>t</b>\n</a>": "<a>\n    <b>t</b>\n</a>",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert [r for r in df.select("want", K._closed(F.col("raw")).alias("got")).collect() if r.want != r.got] == []


def test_f16_entries_are_made_once(spark):
    """What is left to do for a reader starts from written entries: no window and no rule of a block is run again."""
    lines = [(d, n, t) for d in (1, 2) for n, t in enumerate(["[1] Smith J. A study. 1999.", "[2] Jones K. More. 2001."])]
    out = R.fallback_references(spark.createDataFrame(lines, "doc_id long, line_no int, text string"), bounded=True)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(d, t) for d in (1, 2) for t in ("[1] Smith J. A study. 1999.", "[2] Jones K. More. 2001.")]


def test_assembling_references_writes_its_lines_twice(spark, monkeypatch):
    """the state and the row before come from one pass; lines are cut for it and for the running sum, entries for their numbers."""
    calls, cut = [], segments.cut
    monkeypatch.setattr(segments, "cut", lambda df: calls.append(1) or cut(df))
    texts = ["Intro", "References", "1. A", "more", "Header", "rest", "2. B", "x", "Appendix", "y", "References", "z", "w"]
    kinds = ["p", "p", "p", "p", "p", "p", "p", "li", "p", "p", "p", "p", None]
    blocks = spark.createDataFrame([("s", i, k, t) for i, (k, t) in enumerate(zip(kinds, texts))], "doc_id string, pos long, block_type string, text string")
    plain = R.assemble_references(blocks, bounded=True)
    assert not calls
    got = R.assemble_references(blocks)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and len(calls) == 3
