from galley.llm import quality


def test_kept_and_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").select("quality", "toxic", "keep").collect()
    clean = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r.keep for r in got if r.toxic == 1]
    low = [r.keep for r in got if r.quality == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(toxic) / len(toxic) < 0.08 and sum(low) / len(low) < 0.05


def test_sparse_sites_shrink(spark):
    rows = [("a", "a/x", int(i < 90), 0) for i in range(100)] + [("b", "b/x", int(i < 5), 0) for i in range(100)] + [("c", "c/x", 1, 0)] + [("a", "a/y", 0, 0)] * 2
    hosts, paths, means = quality.site_priors(spark.createDataFrame(rows, "host string, path string, low int, toxic int"))
    h = {r.host: r.host_low for r in hosts.collect()}
    assert 0.85 < h["a"] < 0.9 and h["b"] < 0.08 and means["low"] < h["c"] < 1
    p = {r.path: r.path_low for r in paths.collect()}
    assert 0 < p["a/y"] < h["a"] and abs(p["a/x"] - 0.9) < 0.05


def test_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "x"), (2, None, 0, "x"), (None, 1, 1, "x"), (77, 1, 0, "x"), (5, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = awkward.collect()
    got = quality.classify(awkward, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.keep is not None for r in got)
    assert len(quality.classify(awkward, labels.limit(0)).collect()) == len(rows)
    assert quality.classify(awkward.limit(0), labels).count() == 0
