"""Consolidation detector: every trailing window is scored from eight components.

The window of row rn is [rn - lookback, rn - 1]: it leaves out the row itself
and is shorter at the start of a series.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import before, clip, lag, ratio, shortest
from tidemark.operators.context import compression_signature, context_scores, hurst_score
from tidemark.plans.params import (
    AUTO_PERCENTILE,
    COMPONENTS,
    DIAGNOSTIC_LEVELS,
    DIAGNOSTIC_SAMPLES,
    DIVERGENCE_THRESHOLD,
    DIVERGENCE_WINDOW,
    EPSILON,
    SUTTE_MIN_HISTORY,
    THRESHOLD_BOUNDS,
    TYPICAL_MAX,
    TYPICAL_MIN,
    Params,
)

#: Names of the divergence labels.
LABELS = {"trust_fade": ("TRUST", "FADE"), "aligned_divergent": ("ALIGNED", "DIVERGENT")}


def window_core(df: DataFrame, params: Params, gate: bool = True) -> DataFrame:
    """Range and contraction of the window before each row; only rows whose window is allowed.

    With the gate, rows too near the end of their series are left out too.
    """
    w, long = before(params.lookback), before(params.lookback * 4)
    df = df.withColumns(
        {
            "lookback": F.least(F.col("rn"), F.lit(params.lookback)),
            "zone_high": F.max("high").over(w),
            "zone_low": F.min("low").over(w),
            "close_mean": F.avg("close").over(w),
            "past_vol": F.avg("hl_range_pct").over(w),
            "hist_vol": F.avg("hl_range_pct").over(long),
        }
    )
    df = df.withColumns(
        {
            "past_range": F.col("zone_high") - F.col("zone_low"),
            "past_range_pct": (F.col("zone_high") - F.col("zone_low"))
            / (F.col("close_mean") + EPSILON)
            * 100,
            "vol_contraction": F.when(
                F.col("hist_vol") > 0, F.col("past_vol") / F.col("hist_vol")
            ).otherwise(1.0),
        }
    )
    ok = (F.col("lookback") >= params.min_bars) & (F.col("close_mean") > 0)
    if gate:
        ahead = F.least(F.lit(params.lookforward), F.col("n") - F.col("rn"))
        ok = ok & (ahead >= params.min_bars)
    limit = (F.col("past_vol") + EPSILON) * params.range_threshold
    return df.withColumns(
        {
            "scored": F.coalesce(ok, F.lit(False)),
            "c_contraction": 1 - F.least(F.col("vol_contraction"), F.lit(1.0)),
            "c_range": 1 - F.least(F.col("past_range_pct") / limit, F.lit(1.0)),
        }
    )


def position_std(df: DataFrame, params: Params) -> DataFrame:
    """Deviation of the close's place in the window's growing range; 1 without a range."""
    w = before(params.lookback)
    start = F.struct(
        F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"), F.array().cast("array<double>").alias("at")
    )

    def grow(s: Column, x: Column) -> Column:
        hi, lo = F.greatest(s["hi"], x["high"]), F.least(s["lo"], x["low"])
        place = F.array((x["close"] - lo) / (hi - lo))
        return F.struct(
            hi.alias("hi"), lo.alias("lo"), F.when(hi > lo, F.concat(s["at"], place)).otherwise(s["at"]).alias("at")
        )

    bars = F.collect_list(F.struct("high", "low", "close")).over(w)
    df = df.withColumn("_at", F.aggregate(bars, start, grow, lambda s: s["at"]))
    mean = F.try_divide(F.aggregate("_at", F.lit(0.0), lambda s, x: s + x), F.size("_at"))
    df = df.withColumn("_mean", mean)
    square = F.aggregate(
        "_at", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))
    )
    std = F.sqrt(F.try_divide(square, F.size("_at")))
    return df.withColumn("pos_std", F.coalesce(std, F.lit(1.0))).drop("_at", "_mean")


def interaction(df: DataFrame, params: Params) -> DataFrame:
    """Candle compression: small bodies and balanced wicks over the window."""
    w = before(params.lookback)
    body = clip(F.avg("body_to_range_ratio").over(w), 0.0, 1.0)
    wick = clip(F.avg("wick_balance").over(w), 0.0, 1.0)
    return df.withColumn("interaction_score", (1 - body + wick) / 2)


def normalised(raw: Column) -> Column:
    """A raw score from its typical range to 0 .. 1."""
    return clip((raw - TYPICAL_MIN) / (TYPICAL_MAX - TYPICAL_MIN), 0.0, 1.0)


def sutte_score(df: DataFrame, params: Params) -> DataFrame:
    """Strength, steadiness and recent growth of the candle signal over the window."""
    w = before(params.lookback)
    df = df.withColumns(
        {
            "_c": F.collect_list("sutte_conviction").over(w),
            "_dev": F.stddev_samp("sutte_direction").over(w),
        }
    )
    n = F.size("_c")

    def mean(values: Column) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))

    early, late = mean(F.slice("_c", 1, 3)), mean(F.slice("_c", F.greatest(n - 2, F.lit(1)), F.lit(3)))
    growth = ratio(late - early, early + EPSILON)
    trend = F.when(n >= 6, 0.5 + clip(growth, -0.5, 0.5)).otherwise(0.5)
    steady = 1 - F.least(F.col("_dev"), F.lit(1.0))
    score = clip(0.4 * mean(F.col("_c")) + 0.3 * steady + 0.3 * trend, 0.0, 1.0)
    enough = (F.col("lookback") >= SUTTE_MIN_HISTORY) & (n > 0)
    return df.withColumn("sutte_raw", F.when(enough, score).otherwise(0.5)).drop("_c", "_dev")


def divergence_frames(df: DataFrame, params: Params) -> DataFrame:
    """What divergence() reads from frames: the mean signal and the price move of the window's end."""
    w = before(shortest(DIVERGENCE_WINDOW, params.lookback))
    df = df.withColumns(
        {"_first": F.first("close").over(w), "_last": lag("close"), "recent_signal": F.avg("sutte_signal").over(w)}
    )
    trend = F.signum((F.col("_last") - F.col("_first")) / (F.col("_first") + EPSILON))
    return df.withColumn("price_trend", trend).drop("_first", "_last")


def divergence(df: DataFrame, labels: str = "trust_fade") -> DataFrame:
    """Whether the candle signal of the window's end agrees with the price move; needs score."""
    same, opposite = LABELS[labels]
    s, trend = F.col("recent_signal"), F.col("price_trend")
    active = (
        (F.col("lookback") >= max(2, SUTTE_MIN_HISTORY))
        & s.isNotNull()
        & (F.abs(s) > DIVERGENCE_THRESHOLD)
        & (trend != 0)
    )
    agrees = F.signum(s) == trend
    boost = F.abs(s) * (1 + 0.5 * clip(F.col("score"), 0.0, 1.0))
    return df.withColumns(
        {
            "divergence": F.when(active, F.when(agrees, trend).otherwise(-trend)).otherwise(0.0),
            "divergence_signal": F.when(active, F.when(agrees, same).otherwise(opposite)).otherwise("NEUTRAL"),
            "divergence_confidence": F.when(
                active, F.least(boost * F.when(agrees, 1.5).otherwise(2.0), F.lit(1.0))
            ).otherwise(0.0),
        }
    )


def structure(df: DataFrame, params: Params, gate: bool = True) -> DataFrame:
    """The components that only windows of bars make."""
    df = sutte_score(interaction(position_std(window_core(df, params, gate), params), params), params)
    held = clip(F.col("pos_std") * params.position_sensitivity, 0.0, 1.0)
    return df.withColumns(
        {
            "c_position": 0.5 * (1 - held) + 0.5 * F.col("interaction_score"),
            "hurst_exponent": lag("hurst_20"),
            "c_hurst": hurst_score(lag("hurst_20")),
            "c_sutte": normalised(F.col("sutte_raw")),
        }
    )


def score_windows(features: DataFrame, params: Params, gate: bool = True, labels: str = "trust_fade") -> DataFrame:
    """Every allowed window with its components, score and divergence, one row for each bar.

    features: context features of chunked bars. The result has a row for each
    owned bar, scored or not, so that later steps keep the series whole.
    """
    framed = divergence_frames(structure(compression_signature(features), params, gate), params)
    df = context_scores(framed, params)
    df = df.withColumns(
        {
            "scale_raw": F.when(F.col("scored"), F.col("scale_raw")),
            "c_attention": normalised(F.col("attention_raw")),
            "c_periodic": normalised(F.col("periodic_raw")),
        }
    )
    df = df.withColumn("c_scale", normalised(F.col("scale_raw")))
    total = sum((params.weight(c) * F.col(f"c_{c}") for c in COMPONENTS), F.lit(0.0))
    return divergence(df.withColumn("score", total), labels)


def zones(scored: DataFrame, params: Params) -> DataFrame:
    """Accepted windows, in the order of detection."""
    return scored.where(F.col("scored") & (F.col("score") > params.threshold)).select(
        "series_key",
        (F.col("rn") - F.col("lookback")).alias("start_idx"),
        (F.col("rn") - 1).alias("end_idx"),
        F.col("lookback").alias("duration"),
        F.col("past_range").alias("range_width"),
        F.col("past_range_pct").alias("range_width_pct"),
        F.col("vol_contraction").alias("volatility_ratio"),
        F.col("c_position").alias("mean_reversion_strength"),
        "hurst_exponent",
        F.col("score").alias("consolidation_score"),
        F.col("attention_raw").alias("attention_context_score_raw"),
        F.col("periodic_raw").alias("periodic_context_score_raw"),
        F.col("scale_raw").alias("scale_anchor_score_raw"),
        F.col("c_attention").alias("attention_context_score"),
        F.col("c_periodic").alias("periodic_context_score"),
        F.col("c_scale").alias("scale_anchor_score"),
        F.col("sutte_raw").alias("sutte_score_raw"),
        F.col("c_sutte").alias("sutte_score"),
        F.col("divergence").alias("sutte_divergence"),
        F.col("divergence_confidence").alias("sutte_divergence_confidence"),
        F.col("divergence_signal").alias("sutte_divergence_signal"),
        "interaction_score",
    )


def thresholds(scored: DataFrame, params: Params) -> DataFrame:
    """(series_key, threshold, redetected): the setting's, or for series in which it accepts no window the automatic one if lower."""
    found = auto_threshold(diagnostic_scores(scored), params).withColumnRenamed("threshold", "_auto")
    best = F.max(F.when(F.col("scored"), F.col("score")))
    empty = ~F.coalesce(F.col("_best") > params.threshold, F.lit(False))
    again = empty & F.coalesce(F.col("_auto") + EPSILON < params.threshold, F.lit(False))
    return (
        scored.groupBy("series_key")
        .agg(best.alias("_best"))
        .join(found, "series_key", "left")
        .select("series_key", F.when(again, F.col("_auto")).otherwise(params.threshold).alias("threshold"), again.alias("redetected"))
    )


def redetected(scored: DataFrame, params: Params) -> tuple[DataFrame, Params]:
    """Scored windows with each series' own threshold, and the setting that reads it: nothing is scored again."""
    told = scored.join(thresholds(scored, params), "series_key")
    return told, replace(params, threshold=F.col("threshold"))


def live_window(features: DataFrame, params: Params) -> DataFrame:
    """The score of each series' last bar, without the gate on bars ahead.

    features need the last rows only: those of latest(bars, 1 + the rows before that halo() names).
    """
    return score_windows(features, params, gate=False).where("scored AND rn = n - 1")


def diagnostic_scores(scored: DataFrame, samples: int = DIAGNOSTIC_SAMPLES) -> DataFrame:
    """Scores of evenly spaced rows, about `samples` in each series."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / samples))
    return scored.where(F.col("scored") & (F.col("rn") % step == 0)).select("series_key", "rn", "score")


def threshold_diagnosis(
    scores: DataFrame, params: Params, levels: tuple[float, ...] = DIAGNOSTIC_LEVELS
) -> DataFrame:
    """How many sampled windows each threshold would accept, with a summary of the scores.

    The thresholds are the levels and the setting's own, each once and in order.
    """
    levels = tuple(sorted({params.threshold, *levels}))
    summary = [  # of diagnostic_scores(), which are few: percentiles may hold them all
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"),
        F.expr("percentile(score, 0.25)").alias("p25"),
        F.expr("percentile(score, 0.5)").alias("p50"),
        F.expr("percentile(score, 0.75)").alias("p75"),
        F.max("score").alias("max"),
    ]
    counts = [F.count_if(F.col("score") > x).alias(f"l{i}") for i, x in enumerate(levels)]
    told = scores.groupBy("series_key").agg(*summary, *counts)
    each = F.array(
        *[F.struct(F.lit(x).alias("level"), F.col(f"l{i}").alias("above")) for i, x in enumerate(levels)]
    )
    return told.select(
        "series_key", F.explode(each).alias("e"), "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    ).select("series_key", "e.level", "e.above", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def auto_threshold(scores: DataFrame, params: Params, percentile: float = AUTO_PERCENTILE) -> DataFrame:
    """A threshold from the scores themselves, no higher than the present one, within bounds."""
    low, high = THRESHOLD_BOUNDS
    found = F.expr(f"percentile(score, {percentile / 100})")
    return scores.groupBy("series_key").agg(
        F.greatest(F.lit(low), F.least(F.lit(high), F.lit(params.threshold), found)).alias("threshold")
    )
