import tempfile
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from galley.llm import sharding

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards):
    """Every row once, with its size and checksum; places gapless; bytes near equal."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    at, load = defaultdict(list), Counter()
    for r in rows:
        at[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(places) == list(range(len(places))) for places in at.values())
    return load


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign(docs).collect()
    load = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(load.values()) - min(load[s] for s in range(8)) < 0.02 * sum(load.values()) / 8
    again = sharding.assign(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_awkward(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    check(sharding.assign(awkward, 3).collect(), docs, 3)
    assert sharding.assign(awkward.limit(0)).collect() == []


def test_one_row_repeated(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 99).alias("text"))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = same.union(other)
    load = check(sharding.assign(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(load.values()) - min(load.values()) <= 1000


def owners(slot_map):
    return {r.slot: (r.shard, r.bytes) for r in slot_map.collect()}


def shares(held):
    load = Counter()
    for shard, size in held.values():
        load[shard] += size
    return load


def test_map_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    loads = sharding.slot_loads(sharding.records(docs, "doc_id", "text"))
    folder = tempfile.mkdtemp(prefix="galley-map-") + "/maps"
    sharding.store_map(sharding.first_map(loads, 8), folder, 1)
    sharding.store_map(sharding.grown(sharding.read_map(spark, folder), loads, 8), folder, 2)
    one, two = owners(sharding.read_map(spark, folder, 1)), owners(sharding.read_map(spark, folder))
    assert len(one) == sharding.SLOTS
    assert all(two[s] == one[s] or two[s][0] == 8 for s in one)
    total = sum(b for _, b in one.values())
    assert 0.7 * total / 9 < shares(two)[8] < 1.5 * total / 9
    # One shard's slots become three times as heavy: others keep theirs, and the parts come near each other again.
    heavier = loads.join(sharding.read_map(spark, folder, 1).select("slot", "shard"), "slot")
    heavier = heavier.select("slot", F.when(F.col("shard") == 0, F.col("bytes") * 3).otherwise(F.col("bytes")).alias("bytes"), "rows")
    three = owners(sharding.rebalanced(sharding.read_map(spark, folder, 1), heavier, 8))
    assert all(three[s][0] == shard for s, (shard, _) in one.items() if shard != 0)
    parts = shares(three)
    assert max(parts.values()) < 1.1 * sum(parts.values()) / 8
    fewer = owners(sharding.rebalanced(sharding.read_map(spark, folder, 2), loads, 8))
    assert {s for s, _ in fewer.values()} == set(range(8))


def test_write(spark, awkward):
    loads = sharding.slot_loads(sharding.records(awkward, "doc_id", "text", told_by=awkward.columns))
    folder = tempfile.mkdtemp(prefix="galley-shards-") + "/out"
    slot_map = sharding.first_map(loads, 3)
    sharding.write_shards(awkward, folder, slot_map)
    back = spark.read.parquet(folder)
    assert Counter(map(str, back.select("row.*").collect())) == Counter(map(str, awkward.collect()))
    places = defaultdict(list)
    for r in back.select("shard", "slot").collect():
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
