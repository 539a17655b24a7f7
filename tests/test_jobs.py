"""Table jobs on worked fixtures, and both paths of the ordered helpers against each other."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from galley.operators import articles as A, issues as K, layout as Y, lines as L, matching as M, pages as G, references as R, warehouse as H
from galley.plans import segments
from galley.sources import files as S
from galley.streaming import ingest as I


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of three rows: everything crosses block borders."""
    monkeypatch.setattr(segments, "BLOCK", 3)


def lines_df(spark):
    body = ["intro", "References", "1. Smith J. A. Paper. 1999", "cont of one", "https://doi.org/10.1/x", "2. Other B. C. Book", "pp. 3-4 2001",
            "URL:", "http://a.b/c", "Information about the author", "tail", "page 1", "tail", "page 1", "tail"]
    rows = [(d, i, f"{t}") for d in (1, 2) for i, t in enumerate(body)]
    return spark.createDataFrame(rows, "doc_id bigint, line_no int, text string")


JOBS = [
    lambda x, b: L.remove_repeated_lines(x, 3, bounded=b),
    lambda x, b: L.renumber(x, bounded=b),
    lambda x, b: L.chunk_lines(x, 4, bounded=b),
    lambda x, b: R.merge_doi_lines(x, bounded=b),
    lambda x, b: R.glue_pairs(x, bounded=b),
    lambda x, b: R.reference_block(x, bounded=b),
    lambda x, b: R.normalize_references(x, bounded=b),
    lambda x, b: R.fallback_references(x, bounded=b),
    lambda x, b: R.assemble_references(x.withColumnRenamed("line_no", "pos").withColumn("block_type", F.lit("p")), bounded=b),
    lambda x, b: R.carry_sections(x.withColumn("style", F.lit("Body")), bounded=b),
    lambda x, b: L.remove_page_furniture(x.withColumn("page", F.floor(F.col("line_no") / 4).cast("int") + 1), bounded=b),
]


@pytest.mark.parametrize("i", range(len(JOBS)))
def test_blocked_equals_plain(spark, tiny_blocks, i):
    df = lines_df(spark)
    plain = sorted(map(str, JOBS[i](df, True).collect()))
    blocked = sorted(map(str, JOBS[i](df, False).collect()))
    assert plain and plain == blocked


def test_blocked_layout(spark, tiny_blocks):
    rows = [(1, 1, i, f"w{i}", 10.0 * (i % 5), 10.0 * (i % 5) + 8.0, 20.0 * (i // 5) + 0.5 * (i % 2), 20.0 * (i // 5) + 10.0, 600.0, 800.0) for i in range(40)]
    w = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    for job in (Y.lines_from_words, Y.header_boundary, Y.char_gap_stats, Y.reading_order_lines):
        assert sorted(map(str, job(w, bounded=True).collect())) == sorted(map(str, job(w).collect()))


def test_normalize_references_entries(spark):
    got = R.normalize_references(lines_df(spark), bounded=True).where("doc_id = 1").orderBy("line_no").collect()
    assert [r["text"] for r in got] == [
        "1. Smith J. A. Paper. 1999 cont of one https://doi.org/10.1/x",
        "2. Other B. C. Book pp. 3-4 2001 URL: http://a.b/c",
    ]
    parity = R.normalize_references(lines_df(spark), parity=True, bounded=True).where("doc_id = 1")
    assert all("2001" not in r["text"] for r in parity.collect())


def test_glue_pairs_never_overlap(spark):
    texts = ["https://a.", "https://b.", "b/", "c", "URL:", "http://x.y", "DOI: 10.7868/", "S29-4"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, line_no int, text string")
    got = [r["text"] for r in R.glue_pairs(df, bounded=True).orderBy("line_no").collect()]
    assert got == ["https://a.", "https://b.b/", "c", "URL: http://x.y", "DOI: 10.7868/S29-4"]


def test_dedupe_by_doi_url_text(spark):
    texts = ["A. doi: 10.1234/Ab", "See https://doi.org/10.1234/ab, x", "Один. Два", "один два!", "http://q.w/E", "again HTTP://q.w/e"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, line_no int, text string")
    got = R.dedupe_references(df)
    assert sorted(r["line_no"] for r in got.collect()) == [0, 2, 4]
    assert sorted(r["line_no"] for r in R.dedupe_references(got).collect()) == [0, 2, 4]


def test_carry_sections(spark):
    texts = ["Аннотация", "текст аннотации", "Ключевые слова: один, два", "три, четыре", "Для цитирования: x", "Введение", "тело", "Литература", "1. A", "Информация об авторе", "имя"]
    df = spark.createDataFrame([(1, i, "Body", t) for i, t in enumerate(texts)], "doc_id bigint, line_no int, style string, text string")
    got = [(r["section"], r["content"]) for r in R.carry_sections(df, bounded=True).orderBy("line_no").collect()]
    assert got == [
        (None, None), ("abstract", "текст аннотации"), ("keywords", "один, два"), ("keywords", "три, четыре"), (None, None), (None, None), (None, None),
        (None, None), ("references", "1. A"), (None, None), (None, None),
    ]


def test_templates(spark):
    rows = [("j", "t", i, p, 0.1, 0.1, 0.2, 0.2) for i, p in enumerate([2, 1, 1, 2])] + [("j", "u", 0, 5, 0.1, 0.1, 0.3, 0.3)]
    s = spark.createDataFrame(rows, "issn string, field_id string, seq int, page int, x1 double, y1 double, x2 double, y2 double")
    assert {r["field_id"]: r["page"] for r in Y.average_bbox(s).collect()} == {"t": 2, "u": 5}
    assert {r["field_id"]: r["confidence"] for r in Y.bbox_confidence(s).collect()} == {"t": pytest.approx(0.8), "u": 0.0}


def test_best_candidate_ties_and_stages(spark):
    rows = [(1, 0, 0, 5), (1, 0, 1, 5), (1, 1, 2, 12), (1, 2, 3, 99), (2, 0, 0, 11), (2, 1, 1, 50), (3, 0, 7, 4), (3, 2, 8, 4)]
    c = spark.createDataFrame(rows, "request_id int, stage int, ord int, score int")
    assert {r["request_id"]: (r["ord"], r["score"]) for r in M.best_candidate(c).collect()} == {1: (2, 12), 2: (0, 11), 3: (7, 4)}


def test_locate_article(spark):
    lines = ["Contents"] + ["toc"] * 30 + ["About nothing at all here", "Bell Ann writes", "On the origin of bright species and more", "Misbell x y z"]
    df = spark.createDataFrame([("i", n, t) for n, t in enumerate(lines)], "issue string, line_no int, text string")
    arts = spark.createDataFrame(
        [("i", "a", "Bell", ""), ("i", "b", "", "On the origin of bright species"), ("i", "c", "", "on the origin of bright things"), ("i", "d", "Zed", "nothing"), ("i", "e", "", "writesnot")],
        "issue string, name string, surname string, title string")
    got = {r["name"]: r["start_line"] for r in M.locate_article(arts, df).collect()}
    assert got == {"a": 33, "b": 34, "c": 34, "d": None, "e": None}


RECORD = {
    "pages": "5-9", "artType": "RAR", "PublLang": "RUS", "artTitles": {"RUS": "Т", "ENG": "T"}, "abstracts": {"RUS": "А", "ENG": ""},
    "keywords": {"RUS": ["к"], "ENG": []}, "references": {"RUS": ["r1"], "ENG": []}, "codes": {"doi": "10.1/x"}, "dates": {}, "fundings": {},
    "authors": [{"num": "1", "correspondence": True, "individInfo": {"RUS": {"surname": "И", "authorCodes": {"orcid": " "}}, "ENG": {"surname": "I", "authorCodes": {"spin": "77"}}}}],
    "extra_key": 1, "_processed_via_web": True,
}


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "in"
    for issue, name, content in [("1234-5678_2024_1", "a.json", json.dumps(RECORD, ensure_ascii=False)), ("1234-5678_2024_1", "b.json", "{broken"), ("1234-5678_2024_2", "c.json", json.dumps({"pages": "1"}))]:
        folder = root / issue / "json"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(content, encoding="utf-8")
    (root / "stray.json").write_text("{}")
    raw = root / "1234-5678_2024_1" / "raw"
    raw.mkdir()
    for n in ("a.pdf", "full_issue.docx", "x.txt"):
        (raw / n).write_bytes(b"x")
    (root / "top.pdf").write_bytes(b"x")
    return str(root)


def test_scan_and_write(spark, archive, tmp_path):
    scanned = S.scan_articles(spark, archive)
    rows = {r["name"]: r for r in scanned.collect()}
    assert set(rows) == {"a.json", "b.json", "c.json"} and rows["a.json"]["processed"] and rows["a.json"]["start_page"] == 5
    assert rows["a.json"]["issue"] == "1234-5678_2024_1" and rows["b.json"]["record"] is None or rows["b.json"]["pages"] == ""
    bad = H.invalid_records(scanned.select("issue", "name", "content")).collect()
    assert [(r["name"], r["error"]) for r in bad] == [("b.json", "malformed")]
    files = {r["path"]: r["ext"] for r in S.scan_source_files(spark, archive).collect()}
    assert files == {"1234-5678_2024_1/raw/a.pdf": ".pdf", "1234-5678_2024_1/raw/full_issue.docx": ".docx"}
    good = S.article_records(scanned.where("name <> 'b.json'"))
    S.write_articles(good, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    journals = spark.createDataFrame([(0, "1234-5678", "", "", "Журнал", "", "u", "Y")], "ord int, ISSN string, ISSN_Print string, ISSN_Online string, Title string, TitleEn string, Url string, RAS string")
    made = S.write_issue_xml(good, journals, str(tmp_path / "xml"), str(tmp_path / "work")).collect()
    assert sorted((r["issue"], r["file"]) for r in made) == [(i, f"{i}.xml") for i in ("1234-5678_2024_1", "1234-5678_2024_2")]
    assert sorted(os.listdir(tmp_path / "xml")) == ["1234-5678_2024_1.xml", "1234-5678_2024_2.xml"]
    xml = (tmp_path / "xml" / "1234-5678_2024_1.xml").read_text(encoding="utf-8")
    assert ElementTree.fromstring(xml.encode()).tag == "journal" and "<spin>77</spin>" in xml and "Журнал" in xml
    whole = K.issue_xml(good, journals).where("issue = '1234-5678_2024_1'")
    assert K.issue_structure_errors(whole).count() == 0


def test_records_and_journals_over_many_lines(spark, tmp_path):
    folder = tmp_path / "1234-5678_2024_1"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"pages": "5-9", "codes": {"doi": "10.1/x"}}, indent=2), encoding="utf-8")
    (tmp_path / "journals.txt").write_text(json.dumps([{"ISSN": "1234-5678", "Title": "J"}], indent=2), encoding="utf-8")
    rows = S.scan_articles(spark, str(tmp_path)).collect()
    assert [(r["name"], r["pages"], r["record"]["codes"]["doi"]) for r in rows] == [("a.json", "5-9", "10.1/x")]
    assert [r["ISSN"] for r in S.scan_journals(spark, str(tmp_path / "journals.txt")).collect()] == ["1234-5678"]


def test_unknown_keys_make_a_round_trip(spark, tmp_path):
    record = {
        "pages": "5-9", "myExtra": {"a": [1, 2.5, None, "й"]}, "flag": True, "extras": "own", "codes": {"doi": "10.1/x", "isbn": "7"},
        "authors": [{"num": "1"}, {"num": "2", "role": "ed", "individInfo": {"RUS": {"surname": "Ж", "rank": 3}}}],
    }
    folder = tmp_path / "in" / "1234-5678_2024_1" / "json"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    (folder / "b.json").write_text('{"pages": "1"}', encoding="utf-8")
    table = S.article_records(S.scan_articles(spark, str(tmp_path / "in")))
    S.write_articles(table, str(tmp_path / "table"))
    kept = spark.read.parquet(str(tmp_path / "table"))
    assert {r["name"]: r["extras"] is None for r in kept.collect()} == {"a.json": False, "b.json": True}
    forms = spark.createDataFrame([("1234-5678_2024_1", "a.json", "New")], "issue string, name string, title string")
    S.write_articles(A.apply_form(kept, forms), str(tmp_path / "json"), "json")
    back = {r["name"]: r for r in (json.loads(t.value) for t in spark.read.text(str(tmp_path / "json")).collect())}
    assert back["a.json"]["artTitles"]["RUS"] == "New"
    # The form fills the other codes with empty text.
    assert back["a.json"]["codes"].items() >= record["codes"].items()
    for key in ("myExtra", "flag", "extras", "authors"):
        assert back["a.json"][key] == record[key]
    assert "extras" not in back["b.json"]


def test_unknown_keys_stay_with_their_author(spark):
    text = json.dumps({"authors": [{"num": "1", "role": "ed"}, {"num": "2", "rank": 3}, {"num": "3"}]})
    row = spark.createDataFrame([(text,)], "value string").select(A.article_from_json("value").alias("r"))
    moved = row.withColumn("r", F.col("r").withField("authors", F.slice(F.reverse("r.authors"), 1, 2)))
    back = json.loads(moved.select(A.article_to_json(F.col("r").dropFields("extras"), F.col("r.extras")).alias("t")).first()["t"])
    assert [(a["num"], a.get("role"), a.get("rank")) for a in back["authors"]] == [("3", None, None), ("2", None, 3)]


def test_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Название,DOI\nA,10.1/x\n,\nB,\n", encoding="utf-8")
    assert [tuple(r) for r in S.scan_requests(spark, str(tmp_path / "r.csv")).collect()] == [("10.1/x", "A"), ("", "B")]
    (tmp_path / "j.json").write_text('[{"ISSN":"1","Title":"T","x":1},{"ISSN":"2"}]', encoding="utf-8")
    (tmp_path / "k.json").write_text('{"ISSN":"1"}', encoding="utf-8")
    assert [(r["ord"], r["ISSN"]) for r in S.scan_journals(spark, str(tmp_path / "j.json")).collect()] == [(0, "1"), (1, "2")]
    assert S.scan_journals(spark, str(tmp_path / "k.json")).count() == 0


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("Привет", "utf-8"),), (bytearray("Привет", "cp1251"),)], "content binary")
    assert [r["text"] for r in S.decode_text(df).collect()] == ["Привет", "Привет"]


def test_exports(spark, tmp_path):
    found = spark.createDataFrame([("10.1/x", "a;b", "u", "р", ""), ("10.2/y", "t", "", "", "")], "doi string, title string, url string, title_ru string, error string")
    S.write_enrichment_csv(found.coalesce(1), str(tmp_path / "csv"))
    part = next(f for f in os.listdir(tmp_path / "csv") if f.startswith("part"))
    text = (tmp_path / "csv" / part).read_text(encoding="utf-8").splitlines()
    assert text[0].startswith("DOI (запрос);Название (запрос)") and '10.1/x;"a;b";u;р' in text[1] and "не найдено" in text[2]
    raw = spark.createDataFrame([("crossref", "10.1/x", '{"a":1}')], "source string, key string, raw string")
    S.append_snapshots(raw, str(tmp_path / "snap"), F.lit(5))
    S.append_snapshots(raw, str(tmp_path / "snap"), F.lit(6))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2


def test_ingest_stream(spark, archive, tmp_path):
    out, err, ck = (str(tmp_path / x) for x in ("good", "bad", "ck"))
    I.ingest_stream(spark, archive, out, err, ck, max_files=1).awaitTermination()
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(err).select("name").collect()[0][0] == "b.json"
    I.ingest_stream(spark, archive, out, err, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_overlay_identity(spark, archive):
    records = S.article_records(S.scan_articles(spark, archive)).where("name = 'a.json'").drop("stem")
    forms = spark.createDataFrame([("1234-5678_2024_1", "a.json", None)], "issue string, name string, title string")
    same = A.apply_form(records, forms)
    assert same.select("artTitles.RUS", "pages", "keywords.RUS").collect() == records.select("artTitles.RUS", "pages", "keywords.RUS").collect()
    no_author = records.withColumn("authors", F.col("authors").cast(records.schema["authors"].dataType)).withColumn("authors", F.slice("authors", 1, 0))
    assert "author" in [r["rule"] for r in K.article_errors(no_author).collect()]


def test_html_blocks_order(spark):
    html = "<p>a</p><table><tr><td>x</td><td>y</td></tr></table><ul><li><p>b</p></li></ul><div>c</div>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r["pos"], r["block_type"], r["text"]) for r in G.html_blocks(df).orderBy("pos").collect()]
    assert got == [(1, "p", "a"), (2, "table-row", "x | y"), (3, "li", "b"), (4, "p", "b"), (5, "div", "c")]


def test_hot_key_is_not_collected(spark):
    """A key with most rows: the de-duplication plan aggregates before it shuffles."""
    df = spark.range(0, 50000).selectExpr("1L AS doc_id", "cast(id AS int) AS line_no", "concat('line ', id % 100) AS text")
    out = R.dedupe_references(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min_by" in plan
    assert out.count() == 100


def test_anchor_moves_along_a_dense_run(spark):
    """Tops closer than the tolerance to each other but not to the first: lines are cut at the moving anchor."""
    tops = [0.0, 1.5, 3.0, 4.5, 6.0, 6.5, 20.0]
    rows = [(1, 1, i, f"w{i}", float(i), i + 1.0, t, t + 1, 600.0, 800.0) for i, t in enumerate(tops)]
    w = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    want = [("w0 w1", 0.0), ("w2 w3", 3.0), ("w4 w5", 6.0), ("w6", 20.0)]
    for bounded in (True, False):
        got = Y.lines_from_words(w, 2.0, bounded=bounded).orderBy("line_top").collect()
        assert [(r["text"], r["line_top"]) for r in got] == want


def test_page_probes(spark):
    def pages(*html):
        return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")

    metas = G.meta_tags(pages("""<meta name="a" content="a > b"><!-- <meta name='x' content="ghost"> --><meta property=og:t content=v>"""))
    assert [(r["name"], r["value"]) for r in metas.orderBy("n").collect()] == [("a", "a > b"), ("og:t", "v")]
    node = {"@type": "Article", "name": "z"}
    for _ in range(6):
        node = {"@graph": [{"@type": "WebSite"}, node]}
    found = G.json_ld_article(pages(f'<script type="application/ld+json">{json.dumps([node])}</script>')).collect()
    assert [json.loads(r["node"])["name"] for r in found] == ["z"]
    assert G.with_nodes(pages("<div>Real<script>var a=1;</script></div>")).select(G.text_of(F.col("nodes")[0]).alias("t")).first()["t"] == "Real"
    xml = [("u", '<article><article-title xml:lang="en">Alloys with x &lt; 0.5 &amp; y</article-title></article>'), ("v", "<article><article-title>T")]
    got = {r["url"]: r for r in G.jats_metadata(spark.createDataFrame(xml, "url string, xml string")).collect()}
    assert got["u"]["title"] == "Alloys with x < 0.5 & y" and not got["u"]["error"]
    assert got["v"]["title"] == "" and got["v"]["error"]


def test_first_per_key_sorts_nothing(spark):
    rows = [(k, n, s, f"t{k}-{n}-{i}") for i in range(3) for k in (None, "a", "b") for n, s in ((3, 0.5), (1, 2.5), (1, 0.25), (None, None))]
    df = spark.createDataFrame(rows + rows[:4], "k string, n int, s double, t string")
    whole = segments.first_per_key(df, ["k"], F.col("n"))
    assert {r["k"]: r["n"] for r in whole.collect()} == {None: None, "a": None, "b": None} and whole.count() == 3
    known = df.where("n is not null")
    assert {r["k"]: (r["s"], r["n"]) for r in segments.first_per_key(known, ["k"], F.col("s"), F.col("n")).collect()} == {k: (0.25, 1) for k in (None, "a", "b")}
    assert segments.first_per_key(known, ["k"], F.col("n"), F.col("s")).count() == 3
    again = R.dedupe_references(spark.createDataFrame([(1, i, t) for i, t in enumerate(["x doi.org/10.1/a", "y", "y"])], "doc_id long, line_no int, text string"))
    for query in (whole, again):
        assert "SortAggregate" not in query._jdf.queryExecution().executedPlan().toString()
