"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions throughout.

Every source gets a number of words by weight, at most ``cap`` times what it has. A document then stands for a fractional
number of copies; the whole part is certain and the rest is a probability. Two documents of a source are paired and words
move between them at random, with the odds that keep each one's expectation, until one probability is zero or one. The
undecided one meets the next. Groups of bounded size are decided at once; what is left of each group meets again one level
higher, so a source of any size needs a number of levels that grows with the logarithm of its documents, and the words
of a source only move within it: its total differs from its target by the rounding of one last document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, plain, row_key, saved, taken_rows

GROUP = 128
WEIGHTS = (3, 1, 2)
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` (one row per source) -> with ``target``.

    Weights repeat over the sources in order of code points, null last. All sources share ``share`` times all words by
    weight; a source over ``cap`` times its own words stops there and the others share what is left, until none is over.
    """
    by = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sizes.select("source", "source_size"), by, "__no").df
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select("source", "source_size", weight[(F.col("__no") % len(weights)).cast("int")].alias("w"))
    table = saved(ranked, "weights").df
    limit = F.col("source_size") * cap
    budget = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    rate, full = 0.0, None
    while True:
        # A source that stops at one rate stops at every higher one, so the set only grows.
        stops = limit < F.col("w") * rate
        used, free, n = table.agg(
            F.coalesce(F.sum(F.when(stops, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stops, F.col("w"))), F.lit(0.0)),
            F.count(F.when(stops, 1)),
        ).first()
        if n == full or free == 0:
            break
        full, rate = n, (budget - used) / free
    return table.select("source", "source_size", F.least(limit, F.col("w") * rate).alias("target"))


def _uniform(*cols: Column) -> Column:
    """Repeatable number in [0, 1) from the given values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _unit(u: Column, p: Column | None = None) -> Column:
    return F.struct(u["key"].alias("key"), u["size"].alias("size"), (u["p"] if p is None else p).alias("p"))


def _meet(state: Column, x: Column) -> Column:
    """One step: the undecided unit ``state.rest`` meets ``x``; one of them is decided.

    Units have a mass ``p * size``. ``gain`` moves to the rest what fills it or empties ``x``, ``loss`` the reverse.
    """
    rest = state["rest"]
    gain = F.least(rest["size"] * (1 - rest["p"]), x["size"] * x["p"])
    loss = F.least(rest["size"] * rest["p"], x["size"] * (1 - x["p"]))
    up = _uniform(rest["key"], x["key"], F.lit(8)) * (gain + loss) < loss
    fills = rest["size"] * (1 - rest["p"]) <= x["size"] * x["p"]
    drains = rest["size"] * rest["p"] <= x["size"] * (1 - x["p"])

    def moved(u: Column, mass: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), u["p"] + mass / u["size"]))

    one, zero = F.lit(1.0), F.lit(0.0)
    rest_full, x_empty = _unit(rest, one), _unit(x, zero)
    rest_empty, x_full = _unit(rest, zero), _unit(x, one)
    decided = F.when(up, F.when(fills, rest_full).otherwise(x_empty)).otherwise(F.when(drains, rest_empty).otherwise(x_full))
    left = F.when(up, F.when(fills, _unit(x, moved(x, -gain))).otherwise(_unit(rest, moved(rest, gain)))).otherwise(
        F.when(drains, _unit(x, moved(x, loss))).otherwise(_unit(rest, moved(rest, -loss)))
    )
    return F.struct(left.alias("rest"), F.concat(state["done"], F.array(decided)).alias("done"))


def _rounds(units: DataFrame, most: int, group: int) -> DataFrame:
    """``source, key, size, p`` with 0 < p < 1 and size > 0 -> ``source, key, one``; ``most``: units of a source at most."""
    done, left, level = [], units, 0
    while True:
        dealt = left.withColumn("bin", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(max(1, -(-most // group)))))
        falling = F.struct((-F.col("size")).alias("order"), "key", "size", "p")
        grouped = dealt.groupBy("source", "bin").agg(F.array_sort(F.collect_list(falling)).alias("units"))
        kind = "array<struct<key:string,size:double,p:double>>"
        start = F.struct(_unit(F.col("units")[0]).alias("rest"), F.array().cast(kind).alias("done"))
        met = F.aggregate(F.slice("units", 2, F.size("units")), start, _meet).alias("met")
        out = saved(grouped.select("source", met), f"pivot-{level}").df
        last = most <= group
        done.append(out.select("source", F.explode("met.done").alias("u")).select("source", "u.key", (F.col("u.p") == 1).alias("one")))
        left = out.select("source", "met.rest.*")
        if last:
            # One unit per source is left; the nearer whole number keeps its words closest to the target.
            done.append(left.select("source", "key", (F.col("p") >= 0.5).alias("one")))
            return reduce(DataFrame.union, done)
        # A unit decided exactly leaves its partner whole too; such rests are settled, not carried on.
        done.append(left.where("p in (0.0, 1.0)").select("source", "key", (F.col("p") == 1).alias("one")))
        left = left.where("p > 0.0 and p < 1.0")
        most, level = -(-most // group), level + 1


def decide(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, group: int = GROUP) -> DataFrame:
    """``doc_id, source, size, key`` -> one row per ``key``: all of that, ``n`` rows, ``source_size``, ``target``, ``copies``.

    ``key`` names what must be decided; rows that repeat a key are one unit of ``n`` rows, and ``copies`` is the number
    of times the mix takes them together, at most ``cap`` each. Sizes of 0 take no part in the rounding.
    """
    units = docs.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    units = saved(units, "units").df
    sources = saved(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units")), "sources").df
    goal = targets(sources, weights, share, cap).select(F.col("source").alias("s"), "source_size", "target")
    # A source may hold a third of all units; every source row is repeated per salt so that the join splits it.
    salts = 32
    salted = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = salted.withColumnRenamed("salt", "s_salt")
    mine = units.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    joined = mine.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("s_salt")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    whole = joined.select("source", "key", "doc_id", "size", "n", "source_size", "target", expected.alias("e"))
    whole = whole.withColumn("base", F.floor("e")).withColumn("p", F.col("e") - F.col("base"))
    whole = saved(whole, "shares").df
    open_ = whole.where("p > 0 and size > 0").select("source", "key", F.col("size").cast("double").alias("size"), "p")
    most = sources.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]
    rounded = _rounds(open_, most, group).select("key", "one", F.col("source").alias("s"))
    same = (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
    out = whole.join(rounded.withColumnRenamed("key", "k"), same, "left")
    copies = (F.col("base") + F.coalesce(F.col("one"), F.lit(False)).cast("int")).cast("bigint")
    return out.select("source", "key", "doc_id", "size", "n", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; ``taken`` is the words the mix takes of it.

    A null source is a source of its own, after all others. Null and empty texts have size 0 and nothing is taken of
    them. Rows of equal id, source and text are interchangeable: together they get the copies of one unit, the first of
    them the odd ones. An empty table, or one without words, gives targets of 0. Other columns are ignored.
    """
    rows = plain(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = rows.select("doc_id", "source", words(F.col("text")).alias("size"), row_key(rows, "doc_id", "source", "text").alias("key"))
    made = decide(sized, **how)
    each = made.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("row") < F.col("copies") % F.col("n")).cast("int")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows without words are not taken. Rows that repeat each other in every column are one unit. The text moves once, to
    meet its decision.
    """
    key = row_key(docs, id_col)
    size = words(F.col(f"`{text_col}`"))
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), key.alias("key"))
    made = decide(sized, **how).where("copies > 0 and size > 0").select("key", "n", "copies")
    return taken_rows(docs, key, saved(made, "decided").df)
