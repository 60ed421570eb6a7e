"""Statistics of sliding frames in time that does not depend on how long the frames are.

A chunk of a series is cut into blocks of as many rows as a frame has.  A frame
is the end of one block and the beginning of the next, so two running passes
(from the beginning and from the end of each block) give every frame by one
merge: of extrema, of sums, or of counts, means and squared deviations.  Nothing
is subtracted, so a frame of equal values has a deviation of exactly zero.
Exponential means are compositions of affine maps, doubled until they reach back
to the first row of the chunk.

All frames of a chunk are one group of applyInArrow (a bounded number of rows):
Spark's own frames read every row of a frame again for each row.

Null, NaN: missing.  A result that is not finite is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class Frame:
    """A statistic of the last `size` rows; null with fewer than `least` values (the size by default).

    kind: max, min, mean, stddev_samp; ewm (of all rows of the chunk so far, weight `factor` for the last);
    spread_slope (see there; `lags` and the rows before the current one).
    """

    kind: str
    column: str
    size: int = 1
    least: int | None = None
    factor: float = 0.5
    lags: tuple[int, ...] = ()


def _blocks(x: np.ndarray, size: int) -> np.ndarray:
    """Rows in blocks: (place in block, block); missing values fill the last."""
    padded = np.full(-(-max(len(x), 1) // size) * size, np.nan)
    padded[: len(x)] = x
    return np.ascontiguousarray(padded.reshape(-1, size).T)


def _flat(blocks: np.ndarray, n: int) -> np.ndarray:
    return blocks.T.ravel()[:n]


def _before(x: np.ndarray, k: int) -> np.ndarray:
    """The value k rows before; missing in the first k."""
    out = np.full(len(x), np.nan)
    if k < len(x):
        out[k:] = x[: len(x) - k]
    return out


def known(x: np.ndarray, size: int) -> np.ndarray:
    """How many of the last rows have a value."""
    so_far = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    at = np.arange(1, len(x) + 1)
    return so_far[at] - so_far[np.maximum(at - size, 0)]


def extremum(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Greatest (np.fmax) or least (np.fmin) of the last rows."""
    blocks = _blocks(x, size)
    head = _flat(pick.accumulate(blocks, axis=0), len(x))
    tail = _flat(pick.accumulate(blocks[::-1], axis=0)[::-1], len(x))
    return pick(head, _before(tail, size - 1))


#: Frames of so few rows are added up row by row, the oldest first, as they would be by hand.
IN_ORDER = 8


def mean(x: np.ndarray, size: int) -> np.ndarray:
    if size <= IN_ORDER:
        values = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
        total = np.zeros(len(x))
        for k in range(min(size, len(x)) - 1, -1, -1):
            total[k:] += values[: len(x) - k]
        return total / known(x, size)
    blocks = np.nan_to_num(_blocks(x, size), nan=0.0, posinf=np.inf, neginf=-np.inf)
    head = _flat(np.cumsum(blocks, axis=0), len(x))
    tail = _flat(np.cumsum(blocks[::-1], axis=0)[::-1], len(x))
    # A frame that is a whole block is its head alone.
    split = (np.arange(len(x)) % size != size - 1) & (np.arange(len(x)) >= size)
    rest = _before(tail, size - 1)
    return (head + np.where(split, rest, 0.0)) / known(x, size)


def _running(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of each block's rows so far."""
    out = np.zeros((3, *blocks.shape))
    n, middle, squares = np.zeros((3, blocks.shape[1]))
    for j, x in enumerate(blocks):
        there = ~np.isnan(x)
        n = n + there
        delta = np.where(there, x - middle, 0.0)
        middle = middle + delta / np.maximum(n, 1)
        squares = squares + delta * np.where(there, x - middle, 0.0)
        out[:, j] = n, middle, squares
    return out[0], out[1], out[2]


def deviation(x: np.ndarray, size: int, free: int) -> np.ndarray:
    """Standard deviation of the last rows with n - free in the denominator."""
    blocks = _blocks(x, size)
    n, middle, squares = (_flat(v, len(x)) for v in _running(blocks))
    tail = [_before(_flat(v[::-1], len(x)), size - 1) for v in _running(blocks[::-1])]
    at = np.arange(len(x))
    split = (at % size != size - 1) & (at >= size)
    m, other, more = (np.where(split, v, 0.0) for v in tail)
    total = n + m
    gap = np.where((n > 0) & (m > 0), other - middle, 0.0)
    squares = squares + more + gap * gap * n * m / np.maximum(total, 1)
    return np.sqrt(np.where(total > free, squares / np.maximum(total - free, 1), np.nan))


def exponential_mean(x: np.ndarray, factor: float) -> np.ndarray:
    """s = (1 - factor) * s + factor * x from the first value on; a missing value leaves s as it is."""
    there = ~np.isnan(x)
    keep = np.where(there, 1.0 - factor, 1.0)
    add = np.where(there, factor * np.where(there, x, 0.0), 0.0)
    if there.any():
        first = int(np.argmax(there))
        keep[first], add[first] = 0.0, x[first]
    reach = 1
    while reach < len(x):
        add[reach:] = add[reach:] + keep[reach:] * add[:-reach]
        keep[reach:] = keep[reach:] * keep[:-reach]
        reach *= 2
    return np.where(np.cumsum(there) > 0, add, np.nan)


def spread_slope(x: np.ndarray, size: int, lags: tuple[int, ...]) -> np.ndarray:
    """Slope of the logarithm of the deviation of differences on that of their lag, over the `size` rows before each row.

    Lags without deviation are left out; missing with fewer than two.
    """
    n, sx, sy, sxx, sxy = np.zeros((5, len(x)))
    for k in lags:
        spread = _before(deviation(x - _before(x, k), size - k, 0), 1)
        there = spread > 0
        y, log = np.log(np.where(there, spread, 1.0)), math.log(k)
        n, sx, sxx = n + there, sx + there * log, sxx + there * log * log
        sy, sxy = sy + y, sxy + y * log
    below = n * sxx - sx * sx
    return np.where((n >= 2) & (below != 0), (n * sxy - sx * sy) / np.where(below != 0, below, 1.0), np.nan)


def statistic(frame: Frame, x: np.ndarray) -> np.ndarray:
    """The frame's statistic at each of a chunk's rows, which are in order."""
    with np.errstate(all="ignore"):
        if frame.kind == "ewm":
            return exponential_mean(x, frame.factor)
        if frame.kind == "spread_slope":
            return spread_slope(x, frame.size, frame.lags)
        made = {
            "max": lambda: extremum(x, frame.size, np.fmax),
            "min": lambda: extremum(x, frame.size, np.fmin),
            "mean": lambda: mean(x, frame.size),
            "stddev_samp": lambda: deviation(x, frame.size, 1),
        }[frame.kind]()
    return np.where(known(x, frame.size) >= (frame.least or frame.size), made, np.nan)


def slide(df: DataFrame, frames: Mapping[str, Frame]) -> DataFrame:
    """The rows of chunks with a column for each frame; other columns are kept as they are."""
    if not frames:
        return df
    names = df.columns

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["rn"].to_numpy(), kind="stable")
        read: dict[str, np.ndarray] = {}
        told = []
        for frame in frames.values():
            if frame.column not in read:
                numbers = group[frame.column].cast(pa.float64()).to_numpy(zero_copy_only=False)
                read[frame.column] = np.asarray(numbers, float)[order]
            placed = np.empty(len(order))
            placed[order] = statistic(frame, read[frame.column])
            told.append(pa.array(placed, mask=~np.isfinite(placed)))
        return pa.table([*group.select(names).columns, *told], names=[*names, *frames])

    schema = StructType([*df.schema, *[StructField(c, DoubleType()) for c in frames]])
    made = df.groupBy("series_key", "chunk").applyInArrow(run, schema)
    return made.withMetadata("chunk", df.schema["chunk"].metadata)


#: What prepares the columns of frames, the frames, and what is made of them.
Step = tuple[Callable[[DataFrame], DataFrame], dict[str, Frame], Callable[[DataFrame], DataFrame]]


def computed(df: DataFrame, *steps: Step) -> DataFrame:
    """All steps with their frames in one pass; columns that start with _of_ are theirs and go."""
    for prepare, _, _ in steps:
        df = prepare(df)
    df = slide(df, {name: frame for _, frames, _ in steps for name, frame in frames.items()})
    for _, _, finish in steps:
        df = finish(df)
    return df.select(*[c for c in df.columns if not c.startswith("_of_")])
