"""Run metrics as (series_key, metric, value) rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.frames import ratio
from tidemark.functions.lineage import cut
from tidemark.operators.validation import future_return
from tidemark.plans.params import (
    BOOTSTRAP_PERCENTILES,
    BOOTSTRAP_SAMPLES,
    EPSILON,
    REGIME_BASELINE,
    REGIME_HALF_LIFE,
    REGIME_HIGH,
    REGIME_LOW,
    REGIME_RECENT,
    SEED,
)
from tidemark.sources.bars import CHUNK, chunked

HORIZON = 10
INSTABILITY = ("hurst_20", "vol_ratio_20", "rsi_20", "price_position_20")


def long_form(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "series_key"]
    return wide.select("series_key", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        ["series_key"], names, "metric", "value"
    )


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def zone_metrics(zones: DataFrame) -> DataFrame:
    """Number of zones and means of their scores."""
    means = {
        "mean_consolidation_score": "consolidation_score",
        "mean_attention_context_score": "attention_context_score",
        "mean_periodic_context_score": "periodic_context_score",
        "mean_scale_anchor_score": "scale_anchor_score",
        "mean_sutte_score": "sutte_score",
        "mean_interaction_score": "interaction_score",
        "mean_sutte_divergence_confidence": "sutte_divergence_confidence",
    }
    return zones.groupBy("series_key").agg(
        F.count("*").alias("total_consolidations"),
        *[F.avg(c).alias(name) for name, c in means.items()],
    )


def signal_metrics(told: DataFrame) -> DataFrame:
    """Counts of signals, their bias and probabilities, and returns of following them."""
    gain = F.col("direction") * F.col("gain")
    with_gain = chunked(told, 0, HORIZON).withColumn("gain", future_return(HORIZON)).where("owned")
    up, down = F.count_if(F.col("direction") == 1), F.count_if(F.col("direction") == -1)
    some = F.when(F.col("probability") > 0, F.col("probability"))
    mean, std = F.avg(gain), F.stddev_samp(gain)
    return with_gain.groupBy("series_key").agg(
        F.count_if(F.col("direction") != 0).alias("breakout_signals"),
        F.count_if(F.col("probability") > 0.7).alias("high_prob_signals"),
        up.alias("up_breakout_signals"),
        down.alias("down_breakout_signals"),
        F.count_if(F.col("direction") == 0).alias("neutral_signal_bars"),
        _or_zero(F.try_divide(up - down, up + down)).alias("signal_bias"),
        _or_zero(F.avg(some)).alias("mean_probability"),
        _or_zero(F.stddev_samp(some)).alias("prob_std"),
        _or_zero(F.max(some)).alias("max_probability"),
        _or_zero(F.min(some)).alias("min_probability"),
        mean.alias("simulated_mean_return"),
        std.alias("simulated_std_return"),
        _or_zero(mean / (std + EPSILON) * F.sqrt(F.lit(252.0))).alias("simulated_sharpe"),
        _or_zero(F.avg((gain > 0).cast("double"))).alias("simulated_win_rate"),
        (F.product(1 + gain) - 1).alias("simulated_total_return"),
    )


def regime_metrics(bars: DataFrame) -> DataFrame:
    """Volatility of the last 20 returns against that of the last 80, plain and fading with age.

    A series without a return has volatilities of 0 and ratios of 1.
    """
    span = REGIME_BASELINE
    every = bars.groupBy("series_key").agg(F.max("n").alias("_n")).select("series_key")
    last = bars.where(F.col("rn") >= F.col("n") - span - 1)
    step = W.partitionBy("series_key").orderBy("rn")  # 81 rows of a series at most
    last = last.withColumn("r", ratio(F.col("close"), F.lag("close").over(step)) - 1).where("r IS NOT NULL")
    age = F.col("n") - 1 - F.col("rn")
    weight = F.exp(-F.log(F.lit(2.0)) * age / REGIME_HALF_LIFE)

    def vol(size: int) -> tuple[Column, Column]:
        r = F.when(age < size, F.col("r"))
        w = F.when(age < size, weight)
        return F.stddev_pop(r), F.sqrt(F.sum(w * r * r) / F.sum(w))

    (plain, fading), (plain_b, fading_b) = vol(REGIME_RECENT), vol(span)
    out = last.groupBy("series_key").agg(
        plain.alias("regime_recent_vol"),
        plain_b.alias("regime_baseline_vol"),
        fading.alias("regime_recent_ewm_vol"),
        fading_b.alias("regime_baseline_ewm_vol"),
    )
    a = F.col("regime_recent_vol") / (F.col("regime_baseline_vol") + EPSILON)
    b = F.col("regime_recent_ewm_vol") / (F.col("regime_baseline_ewm_vol") + EPSILON)
    shift = (a >= REGIME_HIGH) | (a <= REGIME_LOW) | (b >= REGIME_HIGH) | (b <= REGIME_LOW)
    out = out.withColumns(
        {
            "regime_vol_ratio": a,
            "regime_ewm_vol_ratio": b,
            "regime_shift_flag": shift.cast("double"),
        }
    )
    none = {c: 1.0 if c.endswith("ratio") else 0.0 for c in out.columns if c != "series_key"}
    return every.join(out, "series_key", "left").na.fill(none)


def instability(features: DataFrame, columns: tuple[str, ...] = INSTABILITY) -> DataFrame:
    """Mean of the last 20 rolling deviations of features, their gaps left out."""
    reach = 2 * REGIME_RECENT
    one = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns]
    )
    told = features.select("series_key", "rn", "n", F.explode(one).alias("f")).select(
        "series_key", "rn", "n", "f.metric", "f.v"
    )
    # The last rows that are not null, however far apart.  Spark limits a ranked group before it is
    # shuffled, so a task sends `reach` rows of a series and feature at most.
    back = W.partitionBy("series_key", "metric").orderBy(F.desc("rn"))
    near = told.where("v IS NOT NULL").withColumn("k", F.row_number().over(back)).where(F.col("k") <= reach)
    frame = W.partitionBy("series_key", "metric").orderBy("rn").rowsBetween(-(REGIME_RECENT - 1), 0)
    dev = F.when(F.count("v").over(frame) >= 5, F.stddev_samp("v").over(frame))
    tail = near.withColumn("d", dev).where(F.col("d").isNotNull() & (F.col("k") <= REGIME_RECENT))
    found = tail.groupBy("series_key", "metric").agg(F.avg("d").alias("value"))
    every = told.select("series_key", "metric").distinct()
    return every.join(found, ["series_key", "metric"], "left").select(
        "series_key", F.concat("metric", F.lit("_instability")).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


def run_metrics(zones: DataFrame, told: DataFrame, bars: DataFrame, features: DataFrame) -> DataFrame:
    """All metrics of a run, without the bootstrap interval; zone metrics are 0 where there is no zone."""
    every = bars.groupBy("series_key").agg(F.max("n").alias("_n")).select("series_key")
    wide = [every.join(zone_metrics(zones), "series_key", "left").na.fill(0), signal_metrics(told), regime_metrics(bars)]
    return reduce(DataFrame.unionByName, [*map(long_form, wide), instability(features)])


def bootstrap_interval(told: DataFrame) -> DataFrame:
    """Percentiles of resampled mean probabilities (500 resamples, fixed seed) of each series.

    How many of a resample's draws fall on each chunk of a series is a multinomial
    draw over the chunks' sizes, and which of its rows they fall on one within the
    chunk: together that is a draw over all rows, and no group holds more than a
    chunk's rows or a series' chunks.
    """
    some = told.where("probability > 0").select(
        "series_key", F.floor(F.col("rn") / CHUNK).alias("chunk"), "rn", F.col("probability").alias("p")
    )
    sizes = some.groupBy("series_key", "chunk").agg(F.count("*").alias("n"))

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        n = group["n"].to_numpy()
        draws = np.random.default_rng(SEED).multinomial(n.sum(), n / n.sum(), BOOTSTRAP_SAMPLES)
        return group[["series_key", "chunk"]].assign(draws=list(draws.T))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rn")
        p, chunk = group["p"].to_numpy(), int(group["chunk"].iloc[0])
        rng = np.random.default_rng([SEED, chunk])
        even = np.full(len(p), 1 / len(p))
        sums = [float(rng.multinomial(k, even) @ p) for k in group["draws"].iloc[0]]
        return pd.DataFrame({"series_key": [group["series_key"].iloc[0]], "n": [len(p)], "sums": [sums]})

    drawn = cut(sizes.groupBy("series_key").applyInPandas(share, "series_key string, chunk long, draws array<long>"))
    sums = (
        some.join(drawn, ["series_key", "chunk"])
        .groupBy("series_key", "chunk")
        .applyInPandas(draw, "series_key string, n long, sums array<double>")
    )
    means = (
        sums.select("series_key", "n", F.posexplode("sums").alias("sample", "sum"))
        .groupBy("series_key", "sample")
        .agg((F.sum("sum") / F.sum("n")).alias("mean"))
    )
    low, mid, high = (F.percentile("mean", F.lit(q / 100)) for q in BOOTSTRAP_PERCENTILES)  # of the resamples
    return means.groupBy("series_key").agg(low.alias("p05"), mid.alias("p50"), high.alias("p95"))
