"""Quality classifier by hierarchical empirical Bayes: a document's own evidence meets the record of its site.

Two questions are asked of every document: is it of low quality, and is it toxic. Evidence is the sum of the log ratios
of its features (distinct words, and classes of its shape), each ratio shrunk towards one in proportion to how few
labelled documents hold the feature. The prior is the posterior of the document's path, which is shrunk towards its
host, which is shrunk towards the whole corpus; how strongly is estimated from how much hosts, and paths within hosts,
differ beyond chance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, saved

# Labelled documents whose features are counted, at most. It bounds the model: a feature that is kept is in several of them.
SAMPLE = 20_000
# Documents' worth of belief that a feature says nothing.
PSEUDO = 5.0
# Log ratios below this are chance among thousands of features.
LEAST = 1.5
# A document goes when a fault is at least this likely: four to one, so that one weak sign is not enough.
DROP = 0.8
# Distinct features a task holds before it passes their counts on.
HELD = 1 << 20
TARGETS = ("low", "toxic")
_LETTERS = re.compile(r"[\w\s]+")


def features(text: str | None) -> np.ndarray:
    """Distinct 64-bit names of a text's features: its words, and classes of its shape."""
    text = text or ""
    counts = Counter(text.lower().split())
    n = counts.total()
    shape = []
    if n >= 10:
        often = sum(10 * c > n for _, c in counts.most_common(3))
        letters = len(_LETTERS.sub("", text))
        shape += [f"\x00often {often}", f"\x00distinct {10 * len(counts) // n}", f"\x00other {20 * letters // len(text)}"]
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in [*counts, *shape]], np.uint64).view(np.int64)


def count_features(labelled: DataFrame) -> DataFrame:
    """``text, low, toxic`` -> ``feature, n, low, toxic``: labelled documents that hold a feature, and how many are either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}

        def give() -> pa.RecordBatch:
            rows = np.array([(k, *v) for k, v in held.items()], np.int64).reshape(-1, 4)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in rows.T], ["feature", "n", *TARGETS])

        for batch in batches:
            for text, low, toxic in zip(batch.column("text").to_pylist(), *[batch.column(t).to_pylist() for t in TARGETS]):
                for f in features(text).tolist():
                    row = held.setdefault(f, [0, 0, 0])
                    row[0] += 1
                    row[1] += low
                    row[2] += toxic
            if len(held) > HELD:
                yield give()
        if held:
            yield give()

    found = labelled.select("text", *TARGETS).mapInArrow(run, "feature long, n long, low long, toxic long")
    return found.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])


def log_ratio(n: Column, bad: Column, share: float) -> Column:
    """Shrunken log of how much more often bad documents hold a feature than good ones: gamma-Poisson posterior means."""
    p = F.lit(PSEUDO)
    return F.log((bad + p) / (n * share + p)) - F.log((n - bad + p) / (n * (1 - share) + p))


class Evidence:
    """Weights of all features that say something, the same on every worker; the sample bounds their number."""

    def __init__(self, counted: DataFrame, shares: dict[str, float]):
        self.weights: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for target in TARGETS:
            share = min(max(shares[target], 1e-6), 1 - 1e-6)
            told = counted.select("feature", log_ratio(F.col("n"), F.col(target), share).alias("w"))
            # Signs of a fault only: prose around a fault is no excuse for it.
            rows = told.where(F.col("w") >= LEAST).collect()
            rows.sort(key=lambda r: r.feature)
            self.weights[target] = (np.array([r.feature for r in rows], np.int64), np.array([r.w for r in rows], np.float64))

    def of(self, text: str | None) -> list[float]:
        own, out = features(text), []
        for names, weights in self.weights.values():
            at = np.searchsorted(names, own)
            at[at == len(names)] = 0
            out.append(float(weights[at[names[at] == own]].sum()) if len(names) else 0.0)
        return out

    def column(self, text: Column) -> Column:
        kind = pa.struct([(t, pa.float64()) for t in TARGETS])

        def run(texts: pa.Array) -> pa.Array:
            got = [self.of(t.as_py()) for t in texts]
            return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.float64()) for k in range(len(TARGETS))], fields=list(kind))

        return F.arrow_udf(run, ", ".join(f"{t} double" for t in TARGETS)).asNondeterministic()(text)


def strength(groups: DataFrame, n: str, bad: str, mean: Column) -> float:
    """Pseudo-count of a beta prior for groups around ``mean`` by the method of moments: large if groups hardly differ."""
    spread = groups.where(F.col(n) > 1).select(F.col(n).alias("n"), (F.col(bad) / F.col(n)).alias("p"), mean.alias("m"))
    noise = F.col("m") * (1 - F.col("m"))
    row = spread.agg(
        F.sum(F.col("n") * (F.pow(F.col("p") - F.col("m"), 2))).alias("between"), F.sum(noise).alias("chance"),
        F.sum(F.col("n") * noise).alias("noise"),
    ).first()
    if not row.noise:
        return 1e6
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (strength + 1)), summed over the groups.
    over, room = row.between - row.chance, row.noise - row.chance
    return 1e6 if over <= 0 or room <= 0 else min(1e6, max(1.0, room / over - 1.0))


def site_priors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """``host, path, low, toxic`` -> posterior means per host and per path, and the corpus means."""
    paths = labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    paths = saved(paths, "paths").df
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    hosts = saved(hosts, "hosts").df
    row = hosts.agg(F.sum("n"), *[F.sum(t) for t in TARGETS]).first()
    total = row[0] or 0
    means = {t: (row[k + 1] or 0) / total if total else 0.0 for k, t in enumerate(TARGETS)}
    for t in TARGETS:
        k = strength(hosts, "n", t, F.lit(means[t]))
        hosts = hosts.withColumn(f"host_{t}", (F.col(t) + F.lit(k * means[t])) / (F.col("n") + F.lit(k)))
    named = hosts.select(F.col("host").alias("h"), *[f"host_{t}" for t in TARGETS])
    met = saved(paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "path-hosts").df
    for t in TARGETS:
        k = strength(met, "n", t, F.col(f"host_{t}"))
        met = met.withColumn(f"path_{t}", (F.col(t) + k * F.col(f"host_{t}")) / (F.col("n") + F.lit(k)))
    return hosts.select("host", *[f"host_{t}" for t in TARGETS]), met.select("host", "path", *[f"path_{t}" for t in TARGETS]), means


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: tuple[str, ...] = ("source", "lang"),
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, p_low, p_toxic, score, keep`` for every row of ``docs``.

    ``labels`` has ``doc_id, quality, toxic``; a label that is null or whose document is missing teaches nothing, and of
    repeated labels the worst counts. The evidence is fitted on about ``sample`` labelled documents, chosen by a hash of
    their id; site priors and everything else cover all rows. ``score`` is the probability that a document is neither
    of low quality nor toxic; ``keep`` says that each of both is less likely than ``DROP``. Null hosts and paths are sites of their
    own; sites without labels have the prior of their host, or of the corpus. Null and empty texts only have a shape. Other
    columns are ignored.
    """
    path = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in path_cols])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("host"), path.alias("path"))
    told = plain(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null and quality is not null and toxic is not null")
    told = saved(told.groupBy("doc_id").agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic")), "labels").df
    n = told.count()
    part = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 20))))
    counted = saved(count_features(rows.select("doc_id", "text").join(part, "doc_id")), "features")
    hosts, paths, means = site_priors(rows.select("doc_id", "host", "path").join(told, "doc_id"))
    shares = part.agg(*[F.avg(t).alias(t) for t in TARGETS]).first()
    evidence = Evidence(counted.df, {t: shares[t] or 0.0 for t in TARGETS})
    counted.drop()
    judged = rows.select("doc_id", "host", "path", evidence.column(F.col("text")).alias("e"))
    judged = judged.select("doc_id", "host", "path", *[F.col(f"e.{t}").alias(f"e_{t}") for t in TARGETS])
    # Sites are far fewer than rows, and a host may hold a third of these: sites are repeated per salt, rows spread over salts.
    salts = 16
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "e_low"), F.lit(salts)).cast("int"))
    h = hosts.withColumnRenamed("host", "h").withColumn("s", salt)
    p = paths.withColumnsRenamed({"host": "h", "path": "p"}).withColumn("s", salt)
    met = judged.join(h, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left").drop("h", "s")
    met = met.join(p, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("salt") == F.col("s")), "left")
    for t in TARGETS:
        prior = F.coalesce(f"path_{t}", f"host_{t}", F.lit(means[t]))
        prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
        met = met.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + F.col(f"e_{t}")))))
    keep = (F.col("p_low") < DROP) & (F.col("p_toxic") < DROP)
    return met.select("doc_id", "p_low", "p_toxic", ((1 - F.col("p_low")) * (1 - F.col("p_toxic"))).alias("score"), keep.alias("keep"))
