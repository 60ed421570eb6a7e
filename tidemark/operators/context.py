"""Matching a window's last bar with its history, and the autoregressive anchor.

Medians, quartiles and median deviations of 16 columns over a sliding history,
and least squares of least norm, are numpy work: each chunk of a series (a
bounded number of rows) is one group of applyInArrow, which adds its scores to
the rows themselves, so nothing is joined afterwards.  The history is read in
blocks of reference rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.frames import clip
from tidemark.plans.params import (
    AR_LAGS,
    AR_MIN_SAMPLES,
    AR_TOLERANCE,
    ATTENTION_TEMPERATURE,
    ATTENTION_TOP_K,
    ATTENTION_WEIGHTS,
    CONTEXT_CLIP,
    EPSILON,
    HURST_FREE,
    HURST_PENALTY_MAX,
    IQR_TO_STD,
    MAD_TO_STD,
    PERIODIC_TEMPERATURE,
    PERIODIC_TOP_K,
    PERIODIC_WEIGHTS,
    Params,
)
from tidemark.sources.bars import reaching

_BLOCK = 64  # reference rows whose histories are in memory together: few, so that they stay in a core's cache


def hurst_score(value: Column) -> Column:
    """1 up to the free bound, 0 from the greatest penalty on, linear between; 0.5 if null."""
    inside = 1 - (value - HURST_FREE) / (HURST_PENALTY_MAX - HURST_FREE)
    return F.when(value.isNull(), 0.5).when(value <= HURST_FREE, 1.0).when(
        value >= HURST_PENALTY_MAX, 0.0
    ).otherwise(inside)


def compression_signature(df: DataFrame) -> DataFrame:
    """How much a row looks like consolidation: the mean of the terms that are defined."""
    terms = F.array_compact(
        F.array(
            1 - clip(F.col("vol_ratio_20"), 0.0, 2.0) / 2,
            1 - clip(F.col("body_to_range_ratio"), 0.0, 1.0),
            clip(F.col("wick_balance"), 0.0, 1.0),
            1 - clip(F.abs(F.col("trend_strength_20")) / 2, 0.0, 1.0),
            F.when(F.col("hurst_20").isNotNull(), hurst_score(F.col("hurst_20"))),
        )
    )
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(
        "signature", F.when(F.size(terms) > 0, F.try_divide(total, F.size(terms))).otherwise(0.5)
    )


def robust_scale(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale along the last axis: NaN is left out, all NaN gives 0 and 1.

    Each history is sorted once; its quartiles and its median deviation are read from that order.
    """
    ordered = np.sort(history, axis=-1)  # NaN last
    n = ordered.shape[-1] - np.isnan(ordered).sum(axis=-1)
    with np.errstate(all="ignore"):
        q1, centre, q3 = (_quantile(ordered, n, q) for q in (0.25, 0.5, 0.75))
        scale = np.fmax((q3 - q1) / IQR_TO_STD, MAD_TO_STD * _median_deviation(ordered, n, centre))
    flat = ~(scale > EPSILON)
    if flat.any():
        some = np.where(np.isnan(history[flat]), 0.0, history[flat])
        k = np.maximum(n[flat], 1)
        mean = some.sum(axis=-1) / k
        gap = np.where(np.isnan(history[flat]), 0.0, history[flat] - mean[:, None])
        std = np.sqrt((gap * gap).sum(axis=-1) / k)
        scale[flat] = np.where(std > EPSILON, std, 1.0)
    return np.where(n > 0, centre, 0.0), np.where(n > 0, scale, 1.0)


def _at(ordered: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.take_along_axis(ordered, place[..., None], axis=-1)[..., 0]


def _quantile(ordered: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of the first n of each last axis."""
    last = np.maximum(n - 1, 0)
    place = q * last
    low = np.floor(place).astype(int)
    a = _at(ordered, low)
    return a + (_at(ordered, np.minimum(low + 1, last)) - a) * (place - low)


def _median_deviation(ordered: np.ndarray, n: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Median of the distances to the centre."""
    last = np.maximum(n - 1, 0)
    low, high = last // 2, (last + 1) // 2
    a = _kth_distance(ordered, last, centre, low)
    return a + (_kth_distance(ordered, last, centre, high) - a) * 0.5


def _kth_distance(ordered: np.ndarray, last: np.ndarray, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest distance: the k + 1 nearest values stand together, so their first is found by bisection."""
    low, high = np.zeros_like(last), last - k
    while (low < high).any():
        middle = (low + high) // 2
        right = _at(ordered, middle + k) - centre >= centre - _at(ordered, middle)
        high = np.where(right, middle, high)
        low = np.where(right, low, np.minimum(middle + 1, high))

    def farthest(first: np.ndarray) -> np.ndarray:
        return np.maximum(centre - _at(ordered, first), _at(ordered, first + k) - centre)

    return np.minimum(farthest(low), farthest(np.maximum(low - 1, 0)))


def match_scores(
    history: np.ndarray, signature: np.ndarray, reference: np.ndarray, asked: list[tuple[np.ndarray, int, float]]
) -> list[np.ndarray]:
    """For each (weights of the columns, k, temperature): the mean signature of the k history rows most
    like the reference, weighted by likeness.

    history: (columns, references, rows); signature: (references, rows); reference: (columns, references).
    Rows beyond a short history have a NaN signature.  Of rows that are equally alike the oldest come first.
    """
    beyond = np.isnan(signature)
    centre, scale = robust_scale(np.where(beyond, np.nan, history) if beyond.any() else history)

    def scaled(x: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), 0.0, x)
        x -= c
        x /= s
        return np.clip(x, -CONTEXT_CLIP, CONTEXT_CLIP, out=x)

    gap = scaled(history, centre[..., None], scale[..., None])
    gap -= scaled(reference, centre, scale)[..., None]
    np.abs(gap, out=gap)
    known = np.nan_to_num(signature)
    out = []
    for weights, k, tau in asked:
        used = np.flatnonzero(weights)
        # Distances that agree to 12 digits are ties, whatever the order of the sum.
        distance = np.round(np.tensordot(weights[used], gap[used], axes=1) / weights.sum(), 12)
        like = np.where(beyond, -1.0, np.exp(-distance / tau))
        top = np.argsort(-like, axis=1, kind="stable")[:, :k]
        w = np.maximum(np.take_along_axis(like, top, axis=1), 0.0)
        total = w.sum(axis=1)
        mean = (w * np.take_along_axis(known, top, axis=1)).sum(axis=1) / np.where(total > EPSILON, total, 1)
        out.append(np.where(total > EPSILON, mean, 0.5))
    return out


def context_scores(df: DataFrame, params: Params, anchor: bool = True) -> DataFrame:
    """The owned rows of each chunk with attention_raw, periodic_raw and, unless it is left out, scale_raw.

    The window of row rn ends at rn - 1, which is the reference; its history are
    the rows before the window, params.history at most.
    """
    columns = list(ATTENTION_WEIGHTS)
    asked = [
        (np.array([weights.get(c, 0.0) for c in columns]), k, tau)
        for weights, k, tau in (
            (ATTENTION_WEIGHTS, ATTENTION_TOP_K, ATTENTION_TEMPERATURE),
            (PERIODIC_WEIGHTS, PERIODIC_TOP_K, PERIODIC_TEMPERATURE),
        )
    ]
    by_row = isinstance(params.lookback, Column)  # then a chunk's rows hold its setting
    setting = None if by_row else (params.lookback, params.history, params.min_bars)
    kept = [f for f in df.schema if f.name not in ("chunk", "owned", "signature")]
    names = [f.name for f in kept]
    added = ["attention_raw", "periodic_raw", *(["scale_raw"] if anchor else [])]

    def score(group: pa.Table) -> pa.Table:
        group = group.sort_by("rn")
        if by_row:
            lookback, least = (group[f"p_{c}"][0].as_py() for c in ("lookback", "min_bars"))
            span = Params(lookback=lookback).history
        else:
            lookback, span, least = setting
        owned = group["owned"].to_numpy()
        rn = group["rn"].to_numpy()
        numbers = [group[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
        pad = lookback + span
        values = np.full((len(columns), pad + len(rn)), np.nan)
        values[:, pad:] = numbers
        signature = group["signature"].to_numpy(zero_copy_only=False).astype(float)
        signature = np.concatenate([np.full(pad, np.nan), signature])
        wanted = np.flatnonzero(owned)
        out = np.full((2, len(wanted)), 0.5)
        for lo in range(0, len(wanted), _BLOCK):
            at = wanted[lo : lo + _BLOCK]
            known = np.clip(rn[at] - lookback, 0, span)  # rows of history
            at, slot = at[known >= max(least, 1)], lo + np.flatnonzero(known >= max(least, 1))
            if len(at):
                places = at[:, None] + np.arange(span)[None, :]  # padded places of the history
                out[:, slot] = match_scores(values[:, places], signature[places], values[:, at + pad - 1], asked)
        scores = [*out]
        if anchor:
            closes = group["close"].to_numpy(zero_copy_only=False).astype(float)
            scores.append(anchor_scores(closes, wanted, np.minimum(rn[wanted], lookback)))
        told = group.select(names).filter(pa.array(owned))
        return pa.table([*told.columns, *map(pa.array, scores)], names=[*names, *added])

    schema = StructType([*kept, *[StructField(c, DoubleType()) for c in added]])
    need = ["series_key", "chunk", *[n for n in ("owned", "signature") if n not in names]]
    read = reaching(df, params.reach).select(*dict.fromkeys([*names, *need]))
    return read.groupBy("series_key", "chunk").applyInArrow(score, schema)


def autoregressive_forecasts(prices: np.ndarray) -> np.ndarray:
    """The next price of each row of prices by least squares (of least norm) on up to three lags and a constant.

    Prices are counted from each row's first and in its own unit, so that no price is too small beside
    the constant; what the lags leave open is then chosen by the norm of the coefficients of the prices as given.
    """
    windows, size = prices.shape
    if size < AR_MIN_SAMPLES:
        return prices[:, -1] if size else np.zeros(windows)
    k = min(AR_LAGS, size - 1)
    n = size - k
    first = prices[:, :1]
    unit = np.exp2(np.frexp(np.abs(prices - first).max(axis=1, keepdims=True))[1])  # a power of two: divides exactly
    moved = (prices - first) / unit
    lags = np.stack([moved[:, k - j - 1 : k - j - 1 + n] for j in range(k)], axis=2)
    centre, level = lags.mean(axis=1), moved[:, k:].mean(axis=1)
    u, s, vt = np.linalg.svd(lags - centre[:, None, :], full_matrices=False)
    told = s > np.finfo(float).eps * max(n, k + 1) * s[:, :1]
    along = (u.transpose(0, 2, 1) @ (moved[:, k:] - level[:, None])[:, :, None])[:, :, 0]
    along = np.where(told, along / np.where(told, s, 1.0), 0.0)
    fitted = (vt.transpose(0, 2, 1) @ along[:, :, None])[:, :, 0]
    # The constant is what the means leave: coefficients that the lags do not tell make it smaller.
    means = first + unit * centre
    rest = first[:, 0] + unit[:, 0] * level - (means * fitted).sum(axis=1)
    free = np.where(told, 0.0, (vt @ means[:, :, None])[:, :, 0])
    norm = np.hypot.reduce(np.column_stack([np.ones(windows), free]), axis=1)
    fitted += (vt.transpose(0, 2, 1) @ (free / norm[:, None] * (rest / norm)[:, None])[:, :, None])[:, :, 0]
    last = moved[:, : -k - 1 : -1]
    forecast = first[:, 0] + unit[:, 0] * (level + ((last - centre) * fitted).sum(axis=1))
    return np.where(np.isfinite(forecast), forecast, prices[:, -1])


def anchor_scores(closes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each place the score of the window of that many closes before it: how near its last is to the forecast."""
    out = np.full(len(at), 0.5)
    for size in np.unique(sizes[sizes >= 2]).tolist():
        slots = np.flatnonzero(sizes == size)
        for lo in range(0, len(slots), 16 * _BLOCK):
            part = slots[lo : lo + 16 * _BLOCK]
            prices = closes[at[part][:, None] + np.arange(-size, 0)[None, :]]
            error = np.abs(prices[:, -1] - autoregressive_forecasts(prices[:, :-1]))
            span = np.maximum(prices.max(axis=1) - prices.min(axis=1), EPSILON)
            out[part] = np.maximum(0.0, 1.0 - np.minimum(error / span / AR_TOLERANCE, 1.0))
    return out
