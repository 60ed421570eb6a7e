"""Engineered features of bars.  Input: series_key, chunk, rn, ts, open, high, low, close."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import clip, lag, ratio, return_over
from tidemark.functions.sliding import Frame, Step, computed, slide
from tidemark.plans.params import (
    EPSILON,
    HURST_DEFAULT,
    HURST_LAGS,
    HURST_MIN_POINTS,
    LONG,
    MEDIUM,
    SHORT,
    SUTTE_PERIOD,
    SUTTE_THRESHOLD,
)
from tidemark.sources.bars import reaching

YEAR = math.sqrt(252)
#: What rows before a chunk may weigh in an exponential mean: below a double's precision.
EWM_REST = 2.0**-60


def price_geometry(df: DataFrame) -> DataFrame:
    """Ranges, bodies and wicks of each bar."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns(
        {
            "typical_price": (h + lo + c) / 3,
            "hl_range": h - lo,
            "hl_range_pct": ratio(h - lo, c) * 100,
            "oc_range": F.abs(o - c),
            "oc_range_pct": ratio(F.abs(o - c), c) * 100,
            "upper_wick": h - F.greatest(o, c),
            "lower_wick": F.least(o, c) - lo,
        }
    )
    width = F.col("hl_range") + EPSILON
    return df.withColumns(
        {
            "volume_proxy": F.col("hl_range") * F.col("hl_range_pct"),
            "body_size": F.col("oc_range"),
            "body_to_range_ratio": ratio(F.col("oc_range"), width),
            "wick_balance": clip(
                1 - ratio(F.abs(F.col("upper_wick") - F.col("lower_wick")), width), 0.0, 1.0
            ),
        }
    )


def temporal_phase(df: DataFrame) -> DataFrame:
    """Hour, minute and weekday, and their places on a circle."""
    df = df.withColumns(
        {
            "hour_utc": F.hour("ts").cast("double"),
            "day_of_week": F.weekday("ts").cast("double"),
            "minute_of_day": (F.hour("ts") * 60 + F.minute("ts")).cast("double"),
        }
    )
    out = {}
    for name, column, period in (
        ("hour", "hour_utc", 24),
        ("minute", "minute_of_day", 1440),
        ("dow", "day_of_week", 7),
    ):
        angle = F.col(column) * (2 * math.pi / period)
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return df.withColumns(out)


def log_return(df: DataFrame) -> DataFrame:
    step = ratio(F.col("close"), lag("close"))
    return df.withColumn("log_return", F.when(step > 0, F.ln(step)))


def _of(kind: str, column: str, size: int, least: int | None = None) -> dict[str, Frame]:
    """A frame under the name that steps share it by."""
    return {f"_of_{kind}_{column}_{size}": Frame(kind, column, size, least)}


def volatility_step(periods: tuple[int, ...]) -> Step:
    frames = {}
    for p in periods:
        frames |= {f"high_{p}": Frame("max", "high", p), f"low_{p}": Frame("min", "low", p)}
        frames |= _of("stddev_samp", "log_return", p) | vol_ratio_frames(p)

    def finish(df: DataFrame) -> DataFrame:
        df = df.withColumns(
            {f"realized_vol_{p}": F.col(f"_of_stddev_samp_log_return_{p}") * YEAR for p in periods}
            | {f"vol_ratio_{p}": vol_ratio(p) for p in periods}
            | {f"range_width_{p}": F.col(f"high_{p}") - F.col(f"low_{p}") for p in periods}
        )
        return df.withColumns(
            {f"range_width_pct_{p}": ratio(F.col(f"range_width_{p}"), F.col("close")) * 100 for p in periods}
            | {
                f"price_position_{p}": ratio(
                    F.col("close") - F.col(f"low_{p}"), F.col(f"range_width_{p}") + EPSILON
                )
                for p in periods
            }
        )

    return log_return, frames, finish


def volatility(df: DataFrame, periods: tuple[int, ...] = SHORT + MEDIUM + LONG) -> DataFrame:
    """Envelope, width, position, volatility ratio and realised volatility of each period."""
    return computed(df, volatility_step(periods))


def vol_ratio_frames(p: int) -> dict[str, Frame]:
    return _of("mean", "hl_range_pct", p) | {f"_of_long_hl_range_pct_{p}": Frame("mean", "hl_range_pct", 3 * p, p)}


def vol_ratio(p: int) -> Column:
    """Mean range of the last p rows against that of the last 3 p (p at least)."""
    return ratio(F.col(f"_of_mean_hl_range_pct_{p}"), F.col(f"_of_long_hl_range_pct_{p}"))


def rsi(p: int) -> Column:
    """Relative strength from plain means of the rises and falls of close (0 in the first row)."""
    gain, loss = (F.col(f"_of_mean__of_{x}_{p}") for x in ("gain", "loss"))
    return F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, 100.0)


def momentum_step(periods: tuple[int, ...]) -> Step:
    frames = {}
    for p in periods:
        frames |= _of("mean", "_of_gain", p) | _of("mean", "_of_loss", p)
        frames |= _of("mean", f"roc_{p}", p) | _of("mean", "hl_range_pct", p)

    def prepare(df: DataFrame) -> DataFrame:
        step = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
        return df.withColumns(
            {"_of_gain": F.greatest(step, F.lit(0.0)), "_of_loss": F.greatest(-step, F.lit(0.0))}
            | {f"roc_{p}": return_over("close", p) * 100 for p in periods}
            | {f"momentum_{p}": F.col("close") - lag("close", p) for p in periods}
        )

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"rsi_{p}": rsi(p) for p in periods}
            | {
                f"trend_strength_{p}": ratio(
                    F.abs(F.col(f"_of_mean_roc_{p}_{p}")), F.col(f"_of_mean_hl_range_pct_{p}") + EPSILON
                )
                for p in periods
            }
        )

    return prepare, frames, finish


def momentum(df: DataFrame, periods: tuple[int, ...] = SHORT + MEDIUM) -> DataFrame:
    """Rate of change, momentum, relative strength and trend strength of each period."""
    return computed(df, momentum_step(periods))


def hurst_step(periods: tuple[int, ...]) -> Step:
    least, most = HURST_LAGS
    frames = {
        f"_of_slope_{p}": Frame("spread_slope", "close", p, lags=tuple(range(least, min(most, p // 2) + 1)))
        for p in periods
        if p >= HURST_MIN_POINTS
    }

    def finish(df: DataFrame) -> DataFrame:
        default = F.lit(HURST_DEFAULT)
        slopes = {p: F.col(f"_of_slope_{p}") if f"_of_slope_{p}" in frames else default for p in periods}
        return df.withColumns(
            {f"hurst_{p}": F.when(F.col("rn") >= p, F.coalesce(s, default)).otherwise(default) for p, s in slopes.items()}
        )

    return lambda df: df, frames, finish


def hurst(df: DataFrame, periods: tuple[int, ...] = MEDIUM) -> DataFrame:
    """Slope of log deviation on log lag over the p rows before each row; 0.5 where undefined."""
    return computed(df, hurst_step(periods))


def zscore_step(periods: tuple[int, ...]) -> Step:
    frames = {}
    for p in periods:
        frames |= _of("mean", "close", p) | _of("stddev_samp", "close", p)

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"zscore_{p}": ratio(F.col("close") - F.col(f"_of_mean_close_{p}"), F.col(f"_of_stddev_samp_close_{p}"))
                for p in periods
            }
        )

    return lambda df: df, frames, finish


def statistics(df: DataFrame, periods: tuple[int, ...] = MEDIUM) -> DataFrame:
    """z-score and Hurst proxy of each period."""
    return computed(df, zscore_step(periods), hurst_step(periods))


def candle_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sutte_low_ratio": ratio(F.col("close"), F.col("low") + EPSILON),
            "sutte_high_ratio": ratio(F.col("close"), F.col("high") + EPSILON),
        }
    )


def sutte_step() -> Step:
    frames = {f"sutte_{s}_ma": Frame("mean", f"sutte_{s}_ratio", SUTTE_PERIOD, 2) for s in ("low", "high")}

    def finish(df: DataFrame) -> DataFrame:
        df = df.withColumn("sutte_signal", _balance("sutte_low_ma", "sutte_high_ma"))
        signal = F.col("sutte_signal")
        return df.withColumns(
            {
                "sutte_conviction": clip(F.abs(signal), 0.0, 1.0),
                "sutte_direction": F.when(signal > SUTTE_THRESHOLD, 1)
                .when(signal < -SUTTE_THRESHOLD, -1)
                .otherwise(0),
            }
        )

    return candle_ratios, frames, finish


def sutte(df: DataFrame) -> DataFrame:
    """Candle structure signal from the close's place between low and high."""
    return computed(df, sutte_step())


def _balance(a: str, b: str) -> Column:
    return ratio(F.col(a) - F.col(b), F.col(a) + F.col(b) + EPSILON)


def adaptive_step(factor: float) -> Step:
    frames = {f"sutte_adaptive_{s}": Frame("ewm", f"sutte_{s}_ratio", factor=factor) for s in ("low", "high")}

    def prepare(df: DataFrame) -> DataFrame:
        # A chunk starts with rows of the one before: as many as weigh anything in a double.
        return reaching(candle_ratios(df), math.ceil(math.log(EWM_REST) / math.log1p(-factor)))

    return prepare, frames, lambda df: df.withColumn("sutte_adaptive_signal", _balance(*frames))


def sutte_adaptive(df: DataFrame, factor: float = 0.5) -> DataFrame:
    """Exponential means of the ratios, and their signal; ValueError if chunks do not carry the rows that weigh in."""
    return computed(df, adaptive_step(factor))


def atr(df: DataFrame, size: int = 20, least: int = 5) -> DataFrame:
    """Mean range of the last rows."""
    return slide(df, {f"atr_{size}": Frame("mean", "hl_range", size, least)})


def all_features(df: DataFrame) -> DataFrame:
    """Every feature; null where it is not defined yet."""
    steps = volatility_step(SHORT + MEDIUM + LONG), momentum_step(SHORT + MEDIUM), zscore_step(MEDIUM), hurst_step(MEDIUM)
    return computed(temporal_phase(price_geometry(df)), *steps, sutte_step(), adaptive_step(0.5))


def period_features(df: DataFrame, p: int) -> DataFrame:
    """Volatility, momentum and Hurst proxy of one period."""
    return computed(temporal_phase(price_geometry(df)), volatility_step((p,)), momentum_step((p,)), hurst_step((p,)))


def context_features(df: DataFrame) -> DataFrame:
    """The features that the detector reads."""
    contraction: Step = (lambda df: df, vol_ratio_frames(20), lambda df: df.withColumn("vol_ratio_20", vol_ratio(20)))
    df = temporal_phase(price_geometry(df))
    return computed(df, contraction, momentum_step((5, 20)), hurst_step((20,)), sutte_step())


def complete(df: DataFrame) -> DataFrame:
    """Rows whose bar is whole; number them anew afterwards. Raises if there is none."""
    out = df.na.drop(subset=["open", "high", "low", "close", "hl_range_pct"])
    if out.isEmpty():
        raise ValueError("no complete rows")
    return out
