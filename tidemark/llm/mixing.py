"""Mixing sources to target weights by entropy balancing.

Documents get rates (how often each is taken) that are as near to one as the
targets allow: the rates that minimise the relative entropy to taking every
document once, with one token constraint for each source, are r = exp(t * size) for
one multiplier t of each source, cut at MOST.  The multipliers solve the convex
dual; Newton steps (on the logarithm of the words) over all sources at once read one sum and one slope of each
source from the counts of (source, size), and a step that leaves the interval in
which the solution is known to lie is replaced by its middle.

Rates become copies so that words, not documents, are kept: within a source sizes
are walked from the longest to the shortest, each gets the whole number of copies
nearest to its words plus what the sizes before it left over, unless the shorter
sizes could not make up for the rest, and so a source ends about half of its
shortest text from its target.  The copies of one size are shared out evenly; the
documents that get one more are those whose doc_id comes first by its hash.

What grows: a source of any share of the rows is only counts of its distinct
sizes (no more than the square root of twice its words); ranks within a (source,
size) are taken in as many buckets as a bucket has rows, through the buckets'
counts; rows that agree in doc_id, source and size are counted for each writing
task first.

Defined results: a null text has size 0 and is never taken; null is a source,
after all others; a source without words has target 0; rows with a null doc_id or
a repeated one are documents of their own; an empty table gives no rows.  Other
columns are dropped.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut

WEIGHTS = (1, 2, 3)
#: No document, and so no source, is taken more often.
MOST = 3
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Newton steps, at most; a source is done when its words are within TOLERANCE of its target.
STEPS, TOLERANCE = 80, 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _part) of every row; _part: the task that read it."""
    words = F.regexp_count("text", F.lit(WORD_RE)).cast("long")
    return docs.select(
        "doc_id", "source", F.coalesce(words, F.lit(0).cast("long")).alias("size"), F.spark_partition_id().alias("_part")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size).

    Weights go to the sources by code point, null last, and repeat.  A target above `most` times its
    source is cut there; what is over goes to the others by weight, until none is above.
    """
    table = cut(_weighed(sources, weights))
    total = table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    share = 0.0
    while True:
        # All sources below `most` times their size take `share` words for each unit of weight.
        capped = F.col("weight") * F.lit(share) >= most * F.col("source_size")
        r = table.agg(
            F.sum(F.when(capped, most * F.col("source_size"))).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("free"),
        ).first()
        left = (total - (r["held"] or 0)) / r["free"] if r["free"] else share
        if left <= share:
            break
        share = left
    capped = F.least(F.col("weight") * F.lit(float(share)), (most * F.col("source_size")).cast("double"))
    return table.select("source", "source_size", capped.alias("target"))


def _weighed(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds weight: sources are numbered through the counts of ranges, so any number of them will do."""
    keyed = sources.withColumn("_none", F.col("source").isNull())
    ranged = cut(keyed.repartitionByRange("_none", "source").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_none", "source")) - 1
    number = F.col("_start") + F.col("_at")
    chosen = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    return (
        ranged.withColumn("_at", inside)
        .join(starts, "_range")
        .select("source", "source_size", chosen.alias("weight"))
    )


def rate(size: Column, multiplier: Column, most: int = MOST) -> Column:
    """How often a text of that size is taken."""
    return F.least(F.exp(F.least(multiplier * size, F.lit(math.log(most)))), F.lit(float(most)))


def balanced(classes: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """wanted with multiplier: the solution of the dual of each source.

    classes: (source, size, n); wanted: (source, source_size, target).  Each step is one
    aggregation of the classes by source.
    """
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    # A multiplier is log(rate) of a text of one word, so the solution lies between these.
    low = F.when(ratio < 1, F.log(ratio)).otherwise(0.0)
    high = F.when(ratio > 1, F.lit(math.log(most))).otherwise(0.0)
    state = wanted.select(
        "*",
        F.coalesce(low, F.lit(0.0)).alias("low"),
        F.coalesce(high, F.lit(0.0)).alias("high"),
        # Every text once, unless all must be taken as often as they may.
        F.when(ratio >= most, F.lit(math.log(most))).otherwise(0.0).alias("multiplier"),
        (ratio.isNull() | (ratio == 1) | (ratio >= most)).alias("done"),
    )
    for _ in range(STEPS):
        state = cut(state)
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done").select(F.col("source").alias("_source"), "multiplier")
        size = F.col("size").cast("double")
        r = rate(size, F.col("multiplier"), most)
        sums = (
            classes.join(open_, F.col("source").eqNullSafe(F.col("_source")))
            .groupBy("_source")
            .agg(
                F.sum(F.col("n") * size * r).alias("_words"),
                F.sum(F.when(r < most, F.col("n") * size * size * r)).alias("_slope"),
            )
        )
        gap = F.col("_words") - F.col("target")
        m = F.col("multiplier")
        low = F.when(gap < 0, m).otherwise(F.col("low"))
        high = F.when(gap > 0, m).otherwise(F.col("high"))
        # Of the logarithm of the words, which is the nearer to a straight line.
        newton = m - F.try_divide(F.col("_words"), F.col("_slope")) * F.log(F.try_divide(F.col("_words"), F.col("target")))
        inside = (newton > low) & (newton < high)
        settled = (F.abs(gap) <= TOLERANCE * F.col("target")) | (high - low <= 1e-15 * F.greatest(F.abs(low), F.abs(high)))
        step = F.when(settled, m).when(inside, newton).otherwise((low + high) / 2)
        state = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source",
            "source_size",
            "target",
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            F.when(F.col("done"), m).otherwise(step).alias("multiplier"),
            (F.col("done") | settled).alias("done"),
        )
    return state.select("source", "source_size", "target", "multiplier")


def copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Adds copies to classes (source, size, n, rate): whole numbers, with the rest carried to the next shorter size."""

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        held = group["size"] * group["n"]
        wanted = held * group["rate"]
        below, room = wanted.sum() - wanted.cumsum(), most * (held.sum() - held.cumsum())  # of the shorter sizes
        rest, out = 0.0, []
        for size, n, own, less, more in zip(group["size"].tolist(), group["n"].tolist(), wanted, below, room, strict=True):
            words, taken = own + rest, 0
            if size:
                near = math.floor(words / size + 0.5)
                few = [min(max(x, 0), most * n) for x in (near, near - 1, near + 1)]
                # What is left over must be what the shorter sizes can take more or less, as far as may be.
                taken = min(few, key=lambda x: max(1e-3, words - x * size - (more - less), -less - (words - x * size)))
            rest = words - taken * size
            out.append(taken)
        return group.assign(copies=out)

    return classes.groupBy("source").applyInPandas(
        carry, "source string, size long, n long, source_size long, target double, rate double, copies long"
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, rate, copies) of every row of docs (doc_id, text, source).

    taken: the words that the mix takes of it, which is copies * size.
    """
    rows = cut(sized(docs.withColumn("source", F.col("source").cast("string"))))
    same = cut(rows.groupBy("source", "size", "doc_id", "_part").agg(F.count("*").alias("n")))
    classes = cut(same.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    told = balanced(classes, targets(sizes, weights, most), most).withColumnRenamed("source", "_source")
    rated = classes.join(told, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "size", "n", "source_size", "target", rate(F.col("size").cast("double"), F.col("multiplier"), most).alias("rate")
    )
    return _dealt(rows, same, cut(copies(rated, most)))


def _dealt(rows: DataFrame, same: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row's copies: an even share of its class's, and one more for the first documents by hash."""
    of_class = classes.select(
        F.col("source").alias("_source"),
        F.col("size").alias("_size"),
        "source_size",
        "target",
        "rate",
        F.floor(F.try_divide("copies", "n")).alias("_each"),
        (F.col("copies") % F.col("n")).alias("_more"),
        F.ceil(F.sqrt("n")).alias("_buckets"),
    )
    in_class = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    groups = cut(
        same.withColumn("_hash", F.xxhash64("doc_id"))
        .join(of_class, in_class)
        .withColumn("_bucket", F.pmod(F.col("_hash"), F.col("_buckets")))
        .drop("_source", "_size", "_buckets")
    )
    bucket = ["source", "size", "_bucket"]
    sums = groups.groupBy(*bucket).agg(F.sum("n").alias("_n"))
    before = W.partitionBy("source", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_source"),
        F.col("size").alias("_size"),
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = W.partitionBy(*bucket).orderBy("_hash", "doc_id", "_part").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    more = F.least(F.greatest(F.col("_more") - first, F.lit(0)), F.col("n"))
    ranked = groups.join(starts, in_class & (F.col("_bucket") == F.col("_of"))).select(
        *[F.col(c).alias(f"_g_{c}") for c in ("source", "size", "doc_id", "_part", "n")],
        "source_size", "target", "rate", "_each", more.alias("_with"),
    )
    key = ["source", "size", "doc_id", "_part"]
    alike = F.lit(True)
    for c in key:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    # Of rows that agree in all of it (no more than one task read) it is the same which have one more.
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    taken = rows.join(ranked, alike).withColumn("_place", place)
    count = (F.col("_each") + (F.col("_place") <= F.col("_with")).cast("long")).alias("copies")
    return taken.select("doc_id", "source", "size", "source_size", "target", "rate", count).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies"
    )
