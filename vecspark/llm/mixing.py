"""Mixing sources to target weights by entropy balancing (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, plainly_named, row_hash

#: Words between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Newton steps at most; they end when no multiplier moves by more than TOLERANCE.
NEWTON_STEPS = 25
TOLERANCE = 1e-8
#: How firmly the mixture keeps the corpus's mean log-size of a word's document: the penalty is this share of all words.
RIDGE = 1e-3
ROUNDING_PASSES = 4
#: Documents of a source and size class that are ordered in one task, about, where a class is large.
BIN_ROWS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row (source, source_size, target) for each source, from rows (source, source_size).

    Sources in code-point order, null last, get the weights in turn and split share x all sizes; none gets more than
    most x its own size, and what is over goes to the others by weight. That is min(most * size, level * weight), whose level
    follows from the sources sorted by most * size / weight. One row for each source is sorted in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("turn", F.col("cap") / F.col("w"))
    everything = Window.orderBy("turn", F.col("source").asc_nulls_last())
    before, after = everything.rowsBetween(Window.unboundedPreceding, -1), everything.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = ranked.withColumns({"level": (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)})
    level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(whole)["level"]
    return levels.withColumn("at", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def _exact(c: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(c.cast("decimal(27,9)")).cast("double")


def balance(sizes: DataFrame, goal: DataFrame, most: float = 2.0) -> DataFrame:
    """Rows (source, size, rate) for rows (source, size, n): the rates nearest to 1 in relative entropy that meet the targets.

    A word is the unit, and a rate lies between 0 and `most`. Constraints are each source's words and, for all documents
    together, the mean log-size of a word's document (kept softly, as it can be out of reach). The dual has a multiplier l for
    each source and one, m, that all share; rate = most * logistic(base + l + m * z), z the centred log-size. Each Newton
    step joins the multipliers to the rows, adds up gradient and Hessian by source, and solves: the Hessian is diagonal but for
    the row of m, so m's step follows from sums over the sources. Sources at their limit or without words need no multiplier.
    """
    total = sizes.agg(F.sum(F.col("n") * F.col("size")).alias("w"), _exact(F.col("n") * F.col("size") * F.log1p(F.col("size").cast("double"))).alias("z")).first()
    words = float(total.w or 0)
    centre = (total.z or 0.0) / words if words else 0.0
    start = F.lit(math.log(1 / (most - 1)) if most > 1 else 0.0)
    w, z = (F.col("n") * F.col("size")).cast("double"), F.log1p(F.col("size").cast("double")) - F.lit(centre)
    fixed = F.when((F.col("source_size") <= 0) | (F.col("target") <= 0), 0.0).when(F.col("target") >= F.lit(most) * F.col("source_size"), float(most))
    goal = goal.withColumnRenamed("source", "ts").withColumn("fixed", fixed)
    rate = F.coalesce(F.col("fixed"), F.lit(float(most)) / (1 + F.exp(-(start + F.col("l") + F.col("m") * z))))
    # at first each source's own rate without m
    first = F.col("target") / (F.lit(float(most)) * F.col("source_size") - F.col("target"))
    l0 = F.when(F.col("fixed").isNull(), F.log(first) - start).otherwise(0.0)
    state = durable(goal.withColumn("l", l0).withColumn("m", F.lit(0.0)))
    sizes, held, active = durable(sizes), state.where("fixed is not null"), state.where("fixed is null")
    ridge = F.lit(RIDGE * words)
    everything = Window.partitionBy()
    for _ in range(NEWTON_STEPS):
        rows = sizes.join(active, _same("source", "ts")).withColumn("r", rate)
        h = w * F.col("r") * (1 - F.col("r") / F.lit(float(most)))
        sums = rows.groupBy("ts", "source_size", "target", "fixed", "l", "m").agg(_exact(w * F.col("r")).alias("got"), _exact(w * F.col("r") * z).alias("gz"), _exact(h).alias("h"), _exact(h * z).alias("hz"), _exact(h * z * z).alias("hzz"))
        sums = sums.withColumn("h", F.greatest("h", F.lit(1e-9)))
        sums = sums.withColumn("g", F.col("got") - F.col("target"))
        whole = lambda c: F.sum(c.cast("decimal(27,9)")).over(everything).cast("double")
        schur = F.greatest(whole(F.col("hzz")) + ridge - whole(F.col("hz") * F.col("hz") / F.col("h")), ridge)
        dm = (whole(F.col("hz") * F.col("g") / F.col("h")) - whole(F.col("gz")) - ridge * F.col("m")) / schur
        moved = sums.withColumn("dm", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dm)))
        dl = (-F.col("g") - F.col("hz") * F.col("dm")) / F.col("h")
        moved = moved.withColumn("dl", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), dl)))
        new = durable(moved.select("ts", "source_size", "target", "fixed", (F.col("l") + F.col("dl")).alias("l"), (F.col("m") + F.col("dm")).alias("m"), (F.abs("dl") + F.abs("dm")).alias("moved")))
        far = new.agg(F.max("moved")).first()[0]
        active = new.drop("moved")
        if far is None or far < TOLERANCE:
            break
    # rounded so far that another order of equal sums can't show
    return sizes.join(active.unionByName(held), _same("source", "ts")).select("source", "size", F.round(rate, 9).alias("rate"), "source_size", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _correct(rows: DataFrame, limit: float, parts: int) -> DataFrame:
    """One pass of rounding: what a source still lacks (or has too much) is taken from (or added to) its largest documents that fit.

    Candidates are cut into bins by source, size and hash (`parts` of them); bins that begin past the gap are dropped before any sort.
    """
    gap = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    open_ = rows.join(gap.withColumnRenamed("source", "gs"), _same("source", "gs"), "left").drop("gs")
    side = F.signum("gap")
    may = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(side > 0, F.col("copies") + 1 <= limit).otherwise(F.col("copies") >= 1)
    open_ = open_.withColumn("may", may).withColumn("bin", F.when(F.col("may"), -F.floor(F.log2(F.col("size").cast("double")) * 8) * parts + F.pmod(F.col("salt"), F.lit(parts))))
    bins = open_.where("may").groupBy("source", "bin").agg(F.sum("size").alias("weight"), F.first("gap").alias("g"))
    starts = bins.withColumn("start", F.sum("weight").over(Window.partitionBy("source").orderBy("bin")) - F.col("weight")).where("start < abs(g)").select(F.col("source").alias("bs"), F.col("bin").alias("bb"), "start")
    first = Window.partitionBy("source", "bin").orderBy(F.desc("size"), "salt", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = open_.where("may").join(starts, _same("source", "bs") & (F.col("bin") == F.col("bb"))).withColumn("upto", F.col("start") + F.sum("size").over(first))
    chosen = chosen.where(F.col("upto") <= F.abs("gap")).groupBy(F.col("key").alias("ck")).agg(F.first(side).alias("change"))
    return rows.join(chosen, rows["key"] == chosen["ck"], "left").withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("long")).drop("ck", "change")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep_key: bool = False) -> DataFrame:
    """A row for each document: doc_id, source, size (words), source_size, target of its source, rate, copies and taken = copies x size.

    Rates are those of `balance`; copies are the rate rounded down or up by a hash of the document, then corrected source by
    source (ROUNDING_PASSES times) so that each source's taken words come within a few words of its target. A null text or one
    without words has size 0, and its copies are its rounded rate. Null is a source of its own, last in order. Equal documents
    are rounded apart by their place among their equals, so reruns agree. An empty table gives no rows; further columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("same"))
    twin = F.row_number().over(Window.partitionBy("same", "doc_id", "source", "size").orderBy(F.lit(1)))
    base = base.withColumn("twin", twin)
    base = base.select("doc_id", "source", "size", "same", F.xxhash64("same", "source", "twin").alias("key"), F.xxhash64(F.lit("salt"), "same", "source", "twin").alias("salt"))
    base = durable(base)
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rates = balance(base.groupBy("source", "size").agg(F.count("*").alias("n")), goal, most)
    rates = rates.withColumnsRenamed({"source": "ts", "size": "tsize"})
    rows = base.join(rates, _same("source", "ts") & (F.col("size") == F.col("tsize")), "left").drop("ts", "tsize")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("round"), "salt"), 11).cast("double") * F.lit(2.0**-53)
    rows = rows.withColumn("copies", (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    rows = durable(rows)
    parts = 16 + rows.count() // (16 * BIN_ROWS)
    for _ in range(ROUNDING_PASSES):
        rows = durable(_correct(rows, most, parts))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["same"] if keep_key else []))


def resample(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs, all columns, each row as often as `mix` takes it; of rows alike in doc_id, text and source the first by a hash of all columns are taken first."""
    rows = plainly_named(docs, "doc_id", "text", "source")
    columns = rows.columns
    rows = rows.withColumn("same", F.xxhash64("doc_id", "text")).withColumn("place", row_hash(rows))
    taken = mix(docs.select("doc_id", "text", "source"), weights, share, most, keep_key=True).groupBy("doc_id", "source", "same").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("same").alias("h"), "copies")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("same") == F.col("h"))
    w = Window.partitionBy("doc_id", "source", "same").orderBy("place")
    joined = rows.join(taken.hint("shuffle_hash"), on).withColumn("n", F.get("copies", F.row_number().over(w) - 1).cast("int"))
    return joined.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*columns).toDF(*docs.columns)
