"""Issue documents on disk, their schema, places in an order, and progress of a stream."""

import os
from collections import Counter
from xml.etree import ElementTree

from pyspark.sql import functions as F

from galley.operators import issues as K
from galley.operators import warehouse as H
from galley.sources import issue_files
from galley.streaming import ingest

XSD = os.path.join(os.path.dirname(os.path.abspath(__file__)), "issue_document.xsd")
GOOD = (
    '<journal><titleid>1</titleid><issn>1234-5678</issn><journalInfo lang="RUS"><title>t</title></journalInfo><issue><volume/><number>2</number>'
    "<dateUni>2024</dateUni><pages>1-9</pages><articles><article><pages>1</pages></article></articles></issue></journal>"
)


def parts(spark, sizes):
    rows = [(f"issue {k}", 0, None, f"<journal n='{k}'>") for k in sizes]
    rows += [(f"issue {k}", 1, i, f"<article>{i} й &amp; x</article>") for k, n in sizes.items() for i in range(n)]
    rows += [(f"issue {k}", 2, None, "</journal>") for k in sizes]
    return spark.createDataFrame(rows, "issue string, part int, place int, xml string")


def test_one_document_per_issue_from_many_tasks(spark, tmp_path):
    sizes = {0: 3000, 1: 1, 2: 0, 3: 40}
    spread = parts(spark, sizes).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = issue_files.write_issue_files(spark, spread, ["part", "place"], str(tmp_path / "out"), str(tmp_path / "work")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(os.listdir(tmp_path / "out")) == [f"issue {k}.xml" for k in sizes]
    work = next((tmp_path / "work").iterdir())
    assert sum(f.endswith(".xml") for f in os.listdir(work)) > 1
    for r in made:
        path = tmp_path / "out" / r.file
        root = ElementTree.parse(path).getroot()
        n = sizes[int(root.get("n"))]
        assert [int(a.text.split()[0]) for a in root] == list(range(n)) and os.path.getsize(path) == r.bytes


def test_failed_attempts_leave_nothing_behind(spark, tmp_path):
    """A task that fails once half-way and is run again, as a task on a lost executor is."""
    folder = str(tmp_path / "pieces")
    writer = issue_files.PieceWriter(folder)

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 3

    rows = [{"issue": "a", "xml": "<x>"}, {"issue": "a", "xml": "</x>"}, {"issue": "b", "xml": "<y/>"}]
    kept, issue_files.TaskContext = issue_files.TaskContext, Context
    try:
        def broken():
            yield rows[0]
            raise RuntimeError("lost")

        try:
            writer.write(broken())
        except RuntimeError:
            pass
        message = writer.write(iter(rows))
        aborted = writer.write(iter(rows))
    finally:
        issue_files.TaskContext = kept
    writer.commit([message, None])
    listed = (tmp_path / "pieces" / "committed.txt").read_text().split()
    assert listed == [message.stretches]
    writer.abort([aborted])
    assert not (tmp_path / "pieces" / aborted.pieces).exists() and (tmp_path / "pieces" / message.pieces).exists()
    # Putting together twice, as a retried task would, gives one file.
    stretches = spark.read.schema(issue_files.STRETCHES).json(f"{folder}/{message.stretches}")
    grouped = stretches.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("task", "start", "size", "file"))).alias("parts"))
    for _ in range(2):
        issue_files._put_together(grouped, str(tmp_path / "out"), folder).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["a.xml", "b.xml"]
    assert ElementTree.parse(tmp_path / "out" / "a.xml").getroot().tag == "x"


def test_issue_names_stay_in_their_folder():
    assert [issue_files.file_name(n) for n in ("../../x", "a/b", "..", "1234-5678_2024_1")] == ["_.._x", "a_b", "_", "1234-5678_2024_1"]


FAULTS = {
    "good": (GOOD, set()),
    "no titleid": (GOOD.replace("<titleid>1</titleid>", ""), {("titleid", "missing")}),
    "no info": (GOOD.replace('<journalInfo lang="RUS"><title>t</title></journalInfo>', ""), {("journalInfo", "missing")}),
    "no issue": (GOOD[: GOOD.index("<issue>")] + "</journal>", {("issue", "missing")}),
    "root": (GOOD.replace("journal>", "book>"), {("journal", "root")}),
    "cut off": (GOOD[:-6], {("journal", "parse")}),
    "odd volume": (GOOD.replace("<volume/>", "<volume>v</volume>"), {("volume", "value")}),
    "empty volume": (GOOD.replace("<volume/>", "<volume> </volume>"), set()),
    "language": (GOOD.replace("RUS", "DEU"), {("journalInfo", "attribute lang")}),
    "no language": (GOOD.replace(' lang="RUS"', ""), {("journalInfo", "attribute lang")}),
    "twice": (GOOD.replace("<number>2</number>", "<number>2</number><number>3</number>"), {("number", "repeated")}),
    "order": (GOOD.replace("<number>2</number><dateUni>2024</dateUni>", "<dateUni>2024</dateUni><number>2</number>"), {("number", "order")}),
    "unknown": (GOOD.replace("<titleid>1</titleid>", "<titleid>1</titleid><colour/>"), {("journal", "unexpected")}),
    "two faults": (GOOD.replace("<dateUni>2024</dateUni>", "").replace(">1</titleid>", ">x</titleid>"), {("dateUni", "missing"), ("titleid", "value")}),
}


def test_each_planted_fault_is_named(spark):
    df = spark.createDataFrame([(k, xml) for k, (xml, _) in FAULTS.items()], "issue string, xml string")
    got = {}
    for r in K.xsd_errors(df, XSD).collect():
        got.setdefault(r.issue, set()).add((r.element, r.rule))
    assert got == {k: want for k, (_, want) in FAULTS.items() if want}


def test_issue_documents_pass_the_schema(spark):
    from galley.catalog import article_jobs as A

    sf = "/root/testdata/sf0.001"
    documents = K.issue_xml(A.records(spark, sf), A.JOURNALS.df(spark, sf))
    assert documents.count() > 0
    left = Counter((r.element, r.rule) for r in K.xsd_errors(documents, XSD).collect())
    assert not left, left


def test_places_are_dense_in_every_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("issue"), (F.col("id") * 7919 % 3001).cast("string").alias("pages"), F.col("id").cast("string").alias("name"))
    got = {}
    for r in H.order_articles(df).collect():
        got.setdefault(r.issue, {})[r.pos] = (int(r.pages), r.name)
    for places in got.values():
        assert sorted(places) == list(range(1, len(places) + 1))
        assert [places[p] for p in sorted(places)] == sorted(places.values())


def test_runs_newest_first(spark):
    df = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r2", "c"), ("r1", "a"), ("r10", "z")], "run_id string, issue string")
    assert sorted(map(tuple, H.list_runs(df).collect())) == [(1, "r2", 1, "c"), (2, "r10", 1, "z"), (3, "r1", 1, "a"), (3, "r1", 2, "b")]


def test_progress_after_three_batches_and_a_replay(spark, tmp_path):
    rows = [("a", True), ("a", None), ("b", True), ("a", True), ("c", False), ("b", True), ("a", False)]
    source, table = tmp_path / "in", str(tmp_path / "table")
    for k in range(3):
        part = rows[k::3]
        spark.createDataFrame(part, "issue string, processed boolean").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("issue string, processed boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = ingest.write_progress(stream, table, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert len([p for p in os.listdir(table) if p.startswith("batch=")]) == 3
    want = Counter(map(tuple, H.issue_progress(spark.createDataFrame(rows, "issue string, processed boolean")).collect()))
    assert Counter(map(tuple, ingest.read_progress(spark, table).collect())) == want
    # A batch that comes again after a failure changes nothing.
    again = [p for p in sorted(source.iterdir()) if p.suffix == ".parquet"]
    for n in range(3):
        counts = spark.read.parquet(f"{table}/batch={n}").collect()
        for f in again:
            batch = spark.read.parquet(str(f))
            if Counter(map(tuple, ingest.batch_progress(batch).collect())) == Counter(map(tuple, counts)):
                ingest.merge_progress(batch, n, table)
                break
    assert Counter(map(tuple, ingest.read_progress(spark, table).collect())) == want
