"""One test for each finding of round 4."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from galley.catalog import article_jobs
from galley.catalog.issue_jobs import JOURNALS
from galley.operators import issues as K
from galley.functions import nodes as N
from galley.operators import matching as M
from galley.operators import pages as G
from galley.plans import members as W
from galley.streaming import ingest as I

ARTICLE = "issue string, name string, surname string, title string"


def test_only_lines_with_a_key_of_a_phrase_are_kept(spark, monkeypatch):
    """of many lines those that may hold a phrase are written and moved, and words only as far as a surname asks."""
    kept = {}

    def written(df, name):
        kept[name] = W.written(df, name)
        return kept[name]

    monkeypatch.setattr(M, "written", written)
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(3000)]
    lines[700], lines[900], lines[950] = "xOn the origin of bright speciesy", "Ann Bell-Green writes Longestword", "short one"
    df = spark.createDataFrame([("i", n, t) for n, t in enumerate(lines)], "issue string, line_no long, text string")
    asked = [("i", "a", "", "on the origin of bright species"), ("i", "b", "Bell-Green", ""), ("i", "c", "longestword", ""), ("i", "d", "", "Short  one"), ("i", "e", "", "estword"), ("i", "f", "", "longestwor"), ("j", "g", "", "short one"), (None, "h", "bell", "short one")]
    got = {r["name"]: r["start_line"] for r in M.locate_article(spark.createDataFrame(asked, ARTICLE), df).collect()}
    assert got == {"a": 701, "b": 901, "c": 901, "d": 951, "e": None, "f": 901, "g": None, "h": None}
    assert kept["lines"].count() < 100


def test_lines_numbered_in_parts_are_found_where_numbered_lines_are(spark):
    """lines numbered in their part give the places of lines numbered in the issue, around the contents list too."""
    rng, lines, parts, starts, arts = random.Random(7), [], [], [], []
    for issue in ("i", "j", "k"):
        at = 0
        for part in range(-3, 12):
            texts = [f"{rng.choice(['alpha', 'beta', 'gamma'])} {rng.choice(['delta', 'mu', 'nu'])} {rng.choice(['pi', 'rho', 'tau'])} word" for _ in range(rng.randint(1, 20))]
            if (issue, part) in (("j", 0), ("k", 6)):
                texts[0] = "Contents of it"
            lines += [(issue, at + n, t) for n, t in enumerate(texts)]
            parts += [(issue, part, n, t) for n, t in enumerate(texts)]
            starts.append((issue, part, at))
            at += len(texts)
        arts += [(issue, f"{a}{b}{c}", "", f"{a} {b} {c}") for a in ("alpha", "beta", "gamma") for b in ("delta", "mu", "nu") for c in ("pi", "rho", "tau")]
    a = spark.createDataFrame(arts, ARTICLE)
    want = M.locate_article(a, spark.createDataFrame(lines, "issue string, line_no long, text string"))
    got = M.locate_article(a, spark.createDataFrame(parts, "issue string, part long, line_no int, text string"), starts=spark.createDataFrame(starts, "issue string, part long, start long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.where("start_line IS NOT NULL").count() > 40


def test_key_filter_holds_back_no_asked_key(spark):
    """every asked key passes, and few others do."""
    keys = spark.range(20000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(30000).select("id", F.array(F.xxhash64("id")).alias("k")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.array().cast("array<bigint>").alias("k")))
    members = W.Members(keys)
    passed = {r["id"] for r in rows.where(F.size(members.asked(F.col("k"))) > 0).collect()}
    assert passed >= set(range(20000)) and len(passed) < 20200 and -1 not in passed
    texts = spark.createDataFrame([("xx0123456789",), ("0123456789é",), ("012345678",), ("",), (None,), ("9876543210",)], "t string")
    grams = W.Members(spark.createDataFrame([("0123456789é",)], "t string").select(W.gram_key(F.col("t")).alias("key")))
    assert [r[0] for r in texts.select(grams.any_gram(F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_records_are_sorted_before_their_text_is_made(spark):
    """articles reach the writer over one exchange, and what is sorted has the rows of the pieces."""
    sf = "/root/testdata/sf0.001"
    records, journals = article_jobs.records(spark, sf), JOURNALS.df(spark, sf)
    pieces, xml = K.issue_pieces(records, journals)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan and "to_xml" not in plan
    got = sorted(map(str, pieces.select("issue", "part", "place", xml.alias("xml")).collect()))
    assert got == sorted(map(str, K.issue_xml_parts(records, journals).collect())) and len(got) > 100


def _analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def _page(spark, html):
    return N.with_headings(N.with_nodes(spark.createDataFrame([(html,)], "html string")))


def test_a_caption_is_looked_for_once(spark):
    """the caption of a language block is bound, not looked for at each use, and blocks read as before."""
    html = '<table><tr><td class="x multilang"><span class="lang_caption">ENG</span> ENG name</td><td class="multilang"><span class="lang_caption"></span>no</td><td class="multilangs"><span class="lang_caption">ENG</span>b</td></tr></table>'
    df = _page(spark, html).select(G._captioned(F.col("nodes"), F.filter("nodes", lambda n: N.has_class(n, "multilang"))).alias("c"))
    assert [tuple(x) for x in df.first()["c"]] == [("en", "ENG name")]
    assert _analyzed(df).count("lang_caption") == 2


def test_headings_lose_their_colons_once(spark):
    """a heading is bared once for all phrases, and sections end where they did."""
    html = "<h2>Keys::</h2><p>a</p><h3>words</h3><p>b</p><h2>More</h2><p>c</p><h2>Summary:</h2><p>d</p>"
    page, wanted = _page(spark, html), (["keys", "words", "terms"], ["summary:"], ["summary"])
    assert tuple(page.select(*[N.section_text(w) for w in wanted]).first()) == ("a b", "", "d")
    assert _analyzed(page.select(N.section_text(wanted[0]).alias("a"))).count(":+") == 2


def test_a_task_of_a_batch_reads_many_records(spark, tmp_path):
    """small records are not a task each."""
    for k in range(120):
        folder = tmp_path / "in" / f"issue{k % 3}" / "json"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"r{k}.json").write_text(json.dumps({"pages": str(k)}) if k % 10 else "{broken", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        I.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(int(r["pages"]) for r in good.collect()) == [k for k in range(120) if k % 10] and bad.count() == 12
    assert len(list((tmp_path / "good").rglob("part-*.parquet"))) <= 40
