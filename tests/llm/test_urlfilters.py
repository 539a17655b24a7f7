from collections import Counter
from datetime import datetime, timedelta

import pytest

from galley.llm import urlfilters
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def patterns(url):
    if not url or "://" not in url:
        return set()
    host, _, path = url.split("://", 1)[1].partition("/")
    host = host.rsplit("@", 1)[-1].split(":")[0].lower()
    parts = [p for p in path.split("?")[0].split("#")[0].split("/") if p]
    labels = host.split(".")
    out = {f"host:{host}"} | {"domain:" + ".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    return out | {f"path:{host}/" + "/".join(parts[: i + 1]) for i in range(len(parts))}


def brute(captures, entries, allow=()):
    out = Counter()
    for page, url, when in captures:
        hits = []
        for name, pattern in {(e[0], e[1]) for e in entries}:
            said = [(e[2], -1 if e[3] is None else e[3], e[4] == "remove", e[4]) for e in entries if e[:2] == (name, pattern) and name and e[2] and e[4] in ("add", "remove") and when and e[2] <= when]
            if said and pattern in patterns(url) and max(said)[3] == "add":
                hits.append(name)
        names = sorted(set(hits))
        out[(page, url, when, ",".join(names), len(hits), bool(names) and not set(names) & set(allow))] += 1
    return out


ENTRIES = [
    ("bad", "host:a.example.com", at(10), 1, "add"), ("bad", "host:a.example.com", at(100000), 2, "remove"), ("bad", "host:a.example.com", at(100000), 1, "add"),
    ("bad", "domain:example.com", at(500), 3, "add"), ("good", "path:a.example.com/x", at(50), 4, "add"), ("good", "path:a.example.com/x", at(60.5), 5, "remove"),
    ("bad", "host:a.example.com", at(86400 * 3), 6, "add"), ("bad", "host:a.example.com", at(86400 * 40), 7, "remove"), (None, "host:a.example.com", at(0), 8, "add"),
    ("ugly", "host:a.example.com", None, 9, "add"), ("ugly", "host:a.example.com", at(1), None, "add"), ("ugly", "host:a.example.com", at(1), 3, "keep"),
    ("twin", "host:b.org", at(5), 1, "add"), ("twin", "host:b.org", at(5), 1, "remove"),
]


def tables(spark, captures, entries=ENTRIES):
    c = spark.createDataFrame([(*x, "x", "x") for x in captures], "page_id long, url string, fetched timestamp, list string, n string")
    return c, spark.createDataFrame(entries, "list string, pattern string, ts timestamp, seq long, action string")


def test_against_brute_force(spark):
    urls = ["http://a.example.com/x/y?q=1", "https://u:p@A.Example.com:80/x", "http://b.org", "http://sub.a.example.com/z#f", "nonsense", "", None]
    times = [at(s) for s in (0, 9.999999, 10, 49, 50, 60.4, 60.5, 499, 500, 99999, 100000, 86400 * 3, 86400 * 39.9, 86400 * 400)] + [None]
    captures = [(i % 11 if i % 13 else None, u, t) for i, (u, t) in enumerate((u, t) for u in urls for t in times)] + [(1, urls[0], times[4])] * 3
    got = Counter(map(tuple, urlfilters.evaluate(*tables(spark, captures), allow=("good",)).collect()))
    assert got == brute(captures, ENTRIES, ("good",))
    assert urlfilters.evaluate(*tables(spark, captures[:1])).where("false").count() == 0


def test_empty(spark):
    c, e = tables(spark, [(1, "http://a.example.com/", at(20))])
    assert urlfilters.evaluate(c.limit(0), e).count() == 0
    assert [r.blocked for r in urlfilters.evaluate(c, e.limit(0)).collect()] == [False]


@pytest.mark.parametrize("first,end", [(0, 1), (5, 700), (63, 4097), (1704067200, 1704067201), (1704067211, urlfilters.FOREVER)])
def test_cells_cover_each_second_once(spark, first, end):
    cells = spark.range(1).select(urlfilters._cells(F.lit(first), F.lit(end)).alias("c")).first()["c"]
    spans = sorted((c.cell * 8**c.level, (c.cell + 1) * 8**c.level) for c in cells)
    assert spans[0][0] == first and spans[-1][1] == end and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(cells) <= 14 * urlfilters.LEVELS


def test_python_stays_out(spark):
    plan = urlfilters.evaluate(*tables(spark, [(1, "http://b.org", at(1))]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEval", "BatchEval", "MapIn", "Cartesian", "NestedLoop"))


def test_every_event_is_an_entry(spark):
    base = "/root/testdata/sf0.001"
    events, pages = spark.read.parquet(f"{base}/events.parquet"), spark.read.parquet(f"{base}/pages.parquet")
    assert urlfilters.entries_of(events, pages).count() == events.count()


def test_distant_times(spark):
    far = datetime(9000, 1, 1)
    entries = [("bad", "host:b.org", datetime(1950, 1, 1), 1, "add"), ("good", "host:b.org", datetime(1960, 1, 1), 2, "add"), ("good", "host:b.org", datetime(2300, 1, 1), 3, "remove")]
    captures = [(1, "http://b.org", far), (2, "http://b.org", datetime(1949, 1, 1)), (3, "http://b.org", datetime(1955, 5, 5, 5, 5, 5)), (4, "http://b.org", datetime(2299, 1, 1))]
    got = Counter(map(tuple, urlfilters.evaluate(*tables(spark, captures, entries), allow=("good",)).collect()))
    assert got == brute(captures, entries, ("good",))
