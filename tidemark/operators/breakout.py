"""Breakout probability and direction of each bar from the zones before it.

A zone that ends at row e acts on the rows after it for its hold period. As
that is bounded, the zones that act on a row stand in a short frame before it:
no join and no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import rows
from tidemark.functions.lineage import cut
from tidemark.operators.detector import score_windows
from tidemark.operators.features import context_features
from tidemark.plans.params import (
    CONTEXT_BONUS,
    EPSILON,
    HOLD_MULTIPLIER,
    MIN_HOLD,
    SUTTE_BOOST,
    SUTTE_MIN_HISTORY,
    SUTTE_PENALTY,
    Params,
)
from tidemark.sources.bars import chunked, halo, latest

#: Rows whose mean range is a bar's recent volatility.
RECENT_ROWS = 10
#: Rows of a series that are searched for its last zone first, and by how much more if there is none.
TAIL_ROWS, WIDER = 1_024, 8


def hold_period(duration: Column, params: Params) -> Column:
    """Rows a zone acts on: one and a half times its length (half to even), within bounds."""
    scaled = F.bround(duration * HOLD_MULTIPLIER, 0).cast("long")
    return F.greatest(F.lit(MIN_HOLD), F.least(F.lit(params.max_hold), scaled))


def _agreement(ours: Column, theirs: Column, size: Column, share: float) -> Column:
    up, down = SUTTE_BOOST * share, SUTTE_PENALTY * share
    return F.when(ours == theirs, 1 + size * up).otherwise(1 - size * down)


def probability(bar: dict[str, Column], zone: Column, params: Params) -> tuple[Column, Column]:
    """(probability, direction) that a zone gives a bar; null where it gives none."""
    width = zone["hi"] - zone["lo"]
    up, down = bar["close"] > zone["hi"], bar["close"] < zone["lo"]
    beyond = F.when(up, bar["close"] - zone["hi"]).otherwise(zone["lo"] - bar["close"])
    strength = (
        (1 + F.try_divide(beyond, width))
        * F.greatest(F.try_divide(bar["recent_vol"], zone["vol"] + EPSILON), F.lit(0.0))
        * zone["bias"]
    )
    direction = F.when(up, 1).when(down, -1)
    z = params.steepness * (strength - params.min_expansion - params.logistic_threshold)
    candle = F.when(
        (bar["rn"] + 1 < SUTTE_MIN_HISTORY) | (bar["direction"] == 0) | bar["conviction"].isNull(), 1.0
    ).otherwise(_agreement(bar["direction"], direction, bar["conviction"], 1.0))
    shape = F.when((zone["signal"] == "NEUTRAL") | (zone["confidence"] <= 0), 1.0).otherwise(
        _agreement(F.signum(zone["divergence"]), direction, zone["confidence"], 0.5)
    )
    p = F.least(F.greatest(candle * shape / (1 + F.exp(-z)), F.lit(0.0)), F.lit(1.0))
    gives = (width > 0) & direction.isNotNull() & (strength >= params.min_expansion)
    return F.when(gives, p), F.when(gives, direction)


def zone_column(params: Params) -> Column:
    """The zone of a scored row as a struct; null where it is not accepted."""
    scores = [F.col(c) for c in ("score", "c_attention", "c_periodic", "c_scale")]
    bias = 1 + CONTEXT_BONUS * (sum(scores[1:], scores[0]) / 4)
    return F.when(
        F.col("scored") & (F.col("score") > params.threshold),
        F.struct(
            (F.col("rn") - 1).alias("end"),
            hold_period(F.col("lookback"), params).alias("hold"),
            F.col("zone_high").alias("hi"),
            F.col("zone_low").alias("lo"),
            F.col("past_vol").alias("vol"),
            bias.alias("bias"),
            F.col("divergence_signal").alias("signal"),
            F.col("divergence").alias("divergence"),
            F.col("divergence_confidence").alias("confidence"),
        ),
    )


def zone_bars(scored: DataFrame, params: Params) -> DataFrame:
    """(series_key, rn, zone_end, probability, direction) of each zone and row that it acts on."""
    bars = recent_volatility(scored, params)
    acting = bars.withColumn("_z", _acting(params)).withColumn("z", F.explode("_z"))
    p, d = probability(_bar(), F.col("z"), params)
    return acting.select(
        "series_key", "rn", F.col("z.end").alias("zone_end"), p.alias("probability"), d.alias("direction")
    )


def recent_volatility(scored: DataFrame, params: Params) -> DataFrame:
    """Scored rows in chunks again, with the mean range of the bars before each."""
    # Later frames reach a few rows back, so rows without their halo are dealt anew.
    dealt = chunked(scored, before=max(params.hold_rows, RECENT_ROWS))
    return dealt.withColumn("recent_vol", F.avg("hl_range_pct").over(rows(-RECENT_ROWS, -1)))


def _acting(params: Params) -> Column:
    z = F.collect_list(zone_column(params)).over(rows(1 - params.hold_rows, 0))
    return F.filter(z, lambda x: (x["end"] + x["hold"] >= F.col("rn")) & F.col("owned"))


def _bar() -> dict[str, Column]:
    return {
        "close": F.col("close"),
        "rn": F.col("rn"),
        "recent_vol": F.col("recent_vol"),
        "direction": F.col("sutte_direction"),
        "conviction": F.col("sutte_conviction"),
    }


def signals(scored: DataFrame, params: Params) -> DataFrame:
    """(series_key, ts, rn, n, close, probability, direction) of every bar.

    The probability is the greatest of the acting zones; the direction is that
    of the last zone, in order of detection, whose own exceeds a half.
    """

    def fold(z: Column) -> Column:
        p, d = probability(_bar(), z, params)
        return F.struct(p.alias("p"), d.alias("d"))

    df = recent_volatility(scored, params).withColumn("_z", _acting(params)).where("owned")
    df = df.withColumn("_z", F.transform("_z", fold))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("d"))
    told = F.aggregate(
        "_z",
        start,
        lambda s, z: F.struct(
            F.greatest(s["p"], F.coalesce(z["p"], F.lit(0.0))).alias("p"),
            F.when(z["p"] > 0.5, z["d"]).otherwise(s["d"]).alias("d"),
        ),
    )
    return df.withColumn("_s", told).select(
        "series_key",
        "ts",
        "rn",
        "n",
        "close",
        F.col("_s.p").alias("probability"),
        F.col("_s.d").alias("direction"),
    )


def current_breakout(scored: DataFrame, params: Params) -> DataFrame:
    """The last bar of each series against the last zone before it, without bars ahead.

    Without recent volatility the zone's own is taken.
    """
    accepted = scored.where(F.col("scored") & (F.col("score") > params.threshold))
    last_zone = accepted.groupBy("series_key").agg(
        F.max_by(zone_column(params), "rn").alias("z")
    )
    bars = recent_volatility(scored, params).where("owned AND rn = n - 1")
    df = bars.join(last_zone, "series_key")
    p, d = against(F.col("z"), params)
    return df.select(
        "series_key", "ts", "rn", F.col("z.end").alias("zone_end"), p.alias("probability"), d.alias("direction")
    )


def against(zone: Column, params: Params) -> tuple[Column, Column]:
    """(probability, direction) of a bar against one zone before it; both 0 where it gives none.

    Without recent volatility the zone's own is taken.
    """
    vol = F.when(zone["vol"] > 0, zone["vol"]).otherwise(EPSILON)
    bar = _bar() | {"recent_vol": F.when(F.col("recent_vol") > 0, F.col("recent_vol")).otherwise(vol)}
    p, d = probability(bar, zone, params)
    p = F.coalesce(F.when(F.col("rn") > zone["end"], p), F.lit(0.0))
    return p, F.when(p > 0.5, d).otherwise(0)


def latest_breakouts(bars: DataFrame, params: Params, tail: int = TAIL_ROWS) -> DataFrame:
    """current_breakout() of numbered bars, from the end of each series.

    Only the last rows are made into features and scored; series without a zone there are read
    further back, eight times as far each time, up to their start.
    """
    before, after = halo(params)
    longest = bars.agg(F.max("n").alias("n")).first()["n"] or 0
    told, left = None, bars
    while True:
        near = chunked(latest(left, tail + before), before, after)
        scored = score_windows(context_features(near), params).where(F.col("rn") >= F.col("n") - tail)
        found = cut(current_breakout(scored, params))
        told = found if told is None else told.unionByName(found)
        if tail >= longest:
            return told
        left = left.join(found.select("series_key"), "series_key", "left_anti")
        if left.isEmpty():
            return told
        tail *= WIDER
