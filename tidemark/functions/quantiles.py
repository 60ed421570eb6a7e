"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut


def quantiles(values: DataFrame, keys: list[str], column: str, at: tuple[float, ...]) -> DataFrame:
    """(*keys, quantiles): linear quantiles of what is not null, an array in the order of `at`.

    Equal values are counted first.  Distinct ones are dealt out in order over
    ranges that Spark balances, and ranks come from the counts of the ranges
    before, so a group is never gathered.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
        F.sum("_sum").over(W.partitionBy(*keys)).alias("_total"),
    )
    inside = W.partitionBy(*keys, "_part").orderBy("_v")
    ranked = ranged.withColumn("_upto", F.sum("_n").over(inside)).join(starts, [*keys, "_part"])
    end = F.col("_start") + F.col("_upto")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= end - F.col("_n")) & (rank < end), F.col("_v")))

    out = []
    for q in at:
        place = F.col("_total") - 1 if q == 1 else (F.col("_total") - 1) * q
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append(low + (high - low) * share)
    return ranked.groupBy(*keys).agg(F.array(*out).alias("quantiles"))
