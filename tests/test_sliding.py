"""Sliding frames against reading every frame anew; exponential means against the recursion from the first bar."""

from __future__ import annotations

import math
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.sliding import Frame, slide, statistic
from tidemark.operators import features
from tidemark.sources.bars import chunked, owned

READ = {
    "max": max,
    "min": min,
    "mean": lambda v: math.fsum(v) / len(v),
    "stddev_samp": lambda v: plain.stdev(v) if len(v) > 1 else math.nan,
}


def anew(kind: str, x: list[float], size: int, least: int) -> list[float]:
    out = []
    for i in range(len(x)):
        frame = [v for v in x[max(0, i - size + 1) : i + 1] if not math.isnan(v)]
        out.append(READ[kind](frame) if len(frame) >= least else math.nan)
    return out


@pytest.mark.parametrize("kind", READ)
@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_frames_are_those_read_anew(kind, n):
    rng = np.random.default_rng(n)
    x = rng.choice([1.5, 2.25, -3.0, 1e6 + 0.25, math.nan], n) + rng.integers(0, 2, n) * 1e-3
    for size in (1, 2, 3, 10, 99, 100, 101, 300):
        for least in (1, 2, size):
            got = statistic(Frame(kind, "x", size, least), x)
            np.testing.assert_allclose(got, anew(kind, x.tolist(), size, least), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("value", [0.1, 1 / 3, 1e9 + 0.1])
def test_equal_values_have_no_deviation(value):
    got = statistic(Frame("stddev_samp", "x", 7), np.full(50, value))
    assert np.isnan(got[:6]).all() and (got[6:] == 0.0).all()


def test_slopes_are_those_of_lags_read_anew():
    x = np.cumsum(np.random.default_rng(3).normal(size=90)).tolist()
    got = statistic(Frame("spread_slope", "x", 20, lags=tuple(range(2, 11))), np.array(x))
    for i in range(20, 90):
        spreads = [(math.log(k), math.log(plain.pstdev([x[j] - x[j - k] for j in range(i - 20 + k, i)]))) for k in range(2, 11)]
        assert got[i] == pytest.approx(plain.linear_regression(*zip(*spreads, strict=True)).slope, abs=1e-9)
    assert np.isnan(statistic(Frame("spread_slope", "x", 20, lags=(2, 3)), np.full(40, 2.0))).all()


def test_a_missing_value_leaves_the_exponential_mean():
    got = statistic(Frame("ewm", "x"), np.array([math.nan, 4.0, math.nan, 2.0, math.nan]))
    assert np.isnan(got[0]) and got[1:].tolist() == [4.0, 4.0, 3.0, 3.0]


def test_rows_keep_their_columns_whatever_their_order(spark):
    rows = [("a", 0, i, float(i % 5) if i % 3 else None, {"k": str(i)}) for i in reversed(range(40))]
    df = spark.createDataFrame(rows, "series_key string, chunk long, rn long, x double, more map<string, string>").repartition(3)
    told = slide(df, {"high": Frame("max", "x", 4, 1), "inf": Frame("mean", "x", 50)}).collect()
    assert len(told) == 40 and all(r["more"] == {"k": str(r["rn"])} and r["inf"] is None for r in told)
    by = {r["rn"]: r for r in told}
    x = {i: by[i]["x"] for i in range(40)}
    assert all(by[i]["high"] == max((x[j] for j in range(max(0, i - 3), i + 1) if x[j] is not None), default=None) for i in range(40))
    assert slide(df.limit(0), {"high": Frame("max", "x", 4)}).collect() == []


@pytest.mark.parametrize("factor", [0.5, 0.2])
def test_exponential_means_are_the_recursion_over_a_long_series(spark, factor):
    """200,000 bars in chunks of 2,048: what a chunk carries before its own rows is all that weighs."""
    n = 200_000
    close = 100 + 10 * F.sin(F.col("rn") / 50) + F.rand(1)
    rows = spark.range(n, numPartitions=8).select(F.lit("A").alias("series_key"), F.col("id").alias("rn"), F.lit(n).cast("long").alias("n"))
    rows = rows.withColumns({"close": close, "low": close - F.rand(2), "high": close + F.rand(3)})
    told = owned(features.sutte_adaptive(chunked(rows, size=2_048), factor)).select("rn", "sutte_low_ratio", "sutte_adaptive_low").toPandas()
    told = told.sort_values("rn")
    expected, s = [], None
    for v in told["sutte_low_ratio"].tolist():
        s = v if s is None else (1 - factor) * s + factor * v
        expected.append(s)
    assert len(told) == n
    np.testing.assert_allclose(told["sutte_adaptive_low"], expected, rtol=1e-12)


def test_a_mean_that_reaches_further_than_its_chunk_is_refused(spark):
    rows = spark.createDataFrame([("A", 0, 1, 2.0, 1.0, 3.0)], "series_key string, rn long, n long, close double, low double, high double")
    with pytest.raises(ValueError, match="chunks must carry"):
        features.sutte_adaptive(chunked(rows), 0.01)


def test_short_frames_are_added_up_in_the_order_of_rows():
    """Differences of two means cancel all but their last digits, so these are those of the plain sum."""
    x = np.random.default_rng(4).uniform(0, 1, 500)
    x[7] = math.nan
    for size in (2, 3, 5):
        got = statistic(Frame("mean", "x", size, 1), x)
        for i in range(500):
            frame = [v for v in x[max(0, i - size + 1) : i + 1].tolist() if not math.isnan(v)]
            total = 0.0
            for v in frame:
                total += v
            assert got[i] == total / len(frame)
