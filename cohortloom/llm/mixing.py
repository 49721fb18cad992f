"""Mixing sources to target weights by pivotal dependent rounding.

Sources share the words of the corpus by weight, no source beyond ``cap`` times
its own size.  A document's expected number of copies is its source's target
over its source's size; the whole part is fixed, the fraction is rounded:
documents are paired, and words of expected mass pass from one to the other, at
random but without bias, until one of the two fractions is 0 or 1; the other goes
on to the next pair.  A transfer keeps the words of the pair, so a source ends
within half a document of its target.

The pairing is a reduction tree.  Fractions are dealt by hash into small buckets
of one source; a bucket leaves one fraction, which joins the ``FAN`` next buckets
on the level above; the one fraction that a source ends with goes to its nearer
side.  Levels are written to tables; a source of any size is never gathered.  Built-in expressions only; chance comes from hashes, so reruns agree.

Defined results: a null text has no words; documents without words take none;
a null source is a source of its own, last in order; rows that agree in id,
source and size are rounded as one unit and share its copies evenly, so a hot id
makes no hot bucket; an empty table gives an empty result; other columns stay out
of the decisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.llm.common import bind, documents, stored, utf8, words_of

WEIGHTS = (5, 2, 1)
CAP = 3.0
FAN = 64
_TINY = 1e-9


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """(doc_id, source, size) with the words of each text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.size(words_of(utf8(text))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): shares by weight, with what caps leave over reshared.

    Sources reach their cap in the order of ``cap * size / weight``; the level of the
    rest is fixed by the first source that stays below.  One row for each source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = total.withColumn("weight", weight.cast("double")).withColumn(
        "bound", F.lit(cap) * F.col("source_size"))
    order = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    rows = rows.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(
            F.sum("bound").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))})
    level = F.col("left") / F.col("weights")
    rows = rows.withColumn("level", F.min(F.when(
        level <= F.col("bound") / F.col("weight"),
        F.struct((F.col("bound") / F.col("weight")).alias("at"), level.alias("level")))
    ).over(whole)["level"])
    return rows.select("source", "source_size", F.least(
        "bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _settle(acc: Column, item: Column, seed: int) -> Column:
    """One pairing: the state is the open item and the list of settled ones."""
    a, b = acc["open"], item
    # Words that can pass to a, and from a, until one fraction is whole.
    gain_a, gain_b = (1 - a["p"]) * a["size"], b["p"] * b["size"]
    lose_a, lose_b = a["p"] * a["size"], (1 - b["p"]) * b["size"]
    plus, minus = F.least(gain_a, gain_b), F.least(lose_a, lose_b)
    to_a = _uniform(F.lit(seed), a["h"], b["h"]) * (plus + minus) < minus

    def with_p(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    def outcome(full: Column, rest: Column) -> Column:
        return F.struct(rest.alias("open"),
                        F.concat(acc["settled"], F.array(full)).alias("settled"))

    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(to_a, F.when(gain_a <= gain_b, outcome(
        with_p(a, one), with_p(b, F.greatest(zero, b["p"] - gain_a / b["size"]))))
        .otherwise(outcome(with_p(b, zero), with_p(a, F.least(one, a["p"] + gain_b / a["size"]))))
    ).otherwise(F.when(lose_a <= lose_b, outcome(
        with_p(a, zero), with_p(b, F.least(one, b["p"] + lose_a / b["size"]))))
        .otherwise(outcome(with_p(b, one), with_p(a, F.greatest(zero, a["p"] - lose_b / a["size"])))))


def _level(items: DataFrame, seed: int) -> DataFrame:
    """One row for each bucket: the item left open and the settled ones."""
    # Long documents settle first, so that what stays open tends to be short.
    item = F.struct((-F.col("size")).alias("rank"), "h", "doc_id", "size", "m", "base", "p")
    lists = items.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def run(x: Column) -> Column:
        start = F.struct(F.get(x, 0).alias("open"), F.slice(x, 1, 0).alias("settled"))
        return F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), start,
                           lambda acc, i: bind(i, lambda j: _settle(acc, j, seed)))

    return (lists.select("source", "bucket", bind(F.col("items"), run).alias("r"))
            .select("source", "bucket", "r.open", "r.settled"))


def mix(sized: DataFrame, shares: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS,
        cap: float = CAP, seed: int = 7) -> DataFrame:
    """Units ``(doc_id, source, size, m, copies, source_size, target)``: the ``m`` rows that
    agree in id, source and size take ``copies`` copies together."""
    shares = stored(targets(sized, weights, cap) if shares is None else shares)
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    joined = units.join(shares, units["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(
        F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0) * F.col("m")
    part = ratio - F.floor(ratio)
    joined = joined.withColumns({
        "h": F.xxhash64(F.lit(seed), "doc_id", "source", "size"),
        "base": (F.floor(ratio) + F.when(part >= 1 - _TINY, 1).otherwise(0)).cast("long"),
        "p": F.when((part < _TINY) | (part >= 1 - _TINY) | (F.col("size") == 0), 0.0)
        .otherwise(part)})
    joined = stored(joined)
    # A bucket holds about FAN fractions of one source.
    n = joined.filter("p > 0").groupBy("source").agg(F.count("*").alias("n"))
    items = joined.filter("p > 0").select("source", "doc_id", "size", "m", "base", "p", "h")
    items = items.join(n, items["source"].eqNullSafe(n["source"])).drop(n["source"]).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.ceil(F.col("n") / FAN))).drop("n")
    most = n.agg(F.max("n")).first()[0] or 0
    settled, depth = [], 0
    while most:
        out = stored(_level(items, seed + depth))
        settled.append(out.select("source", F.explode("settled").alias("i")))
        depth += 1
        if most <= FAN ** depth:
            break
        items = out.select("source", "open.*", F.floor(F.col("bucket") / FAN).alias("bucket"))
    if most:
        # The last fraction of a source goes to the nearer side.
        final = out.select("source", F.col("open").withField("p", F.round("open.p")).alias("i"))
        done = reduce(DataFrame.unionByName, [*settled, final]).select(
            "source", "i.doc_id", "i.size", "i.m", (F.col("i.base") + F.col("i.p")).cast("long")
            .alias("copies"))
    else:
        done = joined.filter("p > 0").select("source", "doc_id", "size", "m",
                                             F.col("base").alias("copies"))
    rest = joined.filter("p = 0").select("source", "doc_id", "size", "m",
                                         F.col("base").alias("copies"))
    done = done.unionByName(rest)
    return done.join(shares, done["source"].eqNullSafe(shares["source"])).drop(shares["source"])


def per_row(units: DataFrame) -> DataFrame:
    """One row for each document of a unit, with its own copies."""
    each = units.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.withColumn("copies", (F.floor(F.col("copies") / F.col("m")) + F.when(
        F.col("_i") <= F.col("copies") % F.col("m"), 1).otherwise(0)).cast("long")).drop("_i", "m")


def repeat_rows(docs: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    names = docs.columns
    keyed = docs.withColumn("_size", F.size(words_of(utf8("text"))).cast("long"))
    u = units.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                     F.col("size").alias("_n"), F.col("m").alias("_m"), F.col("copies").alias("_copies"))
    rows = keyed.join(u.filter("_copies > 0"), keyed["doc_id"].eqNullSafe(u["_id"])
                      & keyed["source"].eqNullSafe(u["_source"]) & (keyed["_size"] == u["_n"]))
    # Units of one row, the usual case, need no order.
    unit = W.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    one = rows.filter("_m = 1")
    many = rows.filter("_m > 1").withColumn("_i", F.row_number().over(unit)).withColumn(
        "_copies", F.floor(F.col("_copies") / F.col("_m")) + F.when(
            F.col("_i") <= F.col("_copies") % F.col("_m"), 1).otherwise(0)).drop("_i")
    both = one.unionByName(many).filter("_copies > 0")
    return both.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
                           ).select(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mix(stored(sizes(documents(spark, sf_dir))))
    return per_row(units).select("doc_id", "size", "source_size", "target",
                                 (F.col("copies") * F.col("size")).alias("taken"), "source",
                                 "copies")


QUERIES = {"op7_mixing": op7_mixing}
ORACLE: dict[str, str] = {}
