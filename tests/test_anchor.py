"""The autoregressive anchor against plain least squares, on windows with and without a unique solution."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tests.compare import SMOKE_DIR
from tidemark.operators.context import anchor_scores, autoregressive_forecasts
from tidemark.plans.queries import PARAMS, bars, scored
from tidemark.sources.bars import owned


def forecast(prices):
    if len(prices) < 10:
        return prices[-1]
    rows = [[prices[i - 1], prices[i - 2], prices[i - 3], 1.0] for i in range(3, len(prices))]
    fitted = np.linalg.lstsq(np.array(rows), np.array(prices[3:]), rcond=None)[0]
    return float(np.array([prices[-1], prices[-2], prices[-3], 1.0]) @ fitted)


def anchor(prices):
    if len(prices) < 2:
        return 0.5
    error = abs(prices[-1] - forecast(prices[:-1])) / max(max(prices) - min(prices), 1e-10)
    return max(0.0, 1.0 - min(error / 0.75, 1.0))


@pytest.mark.parametrize("kind", ["random", "flat", "line", "steps", "two values"])
def test_anchors_are_least_squares_of_least_norm(kind):
    rng = np.random.default_rng(8)
    closes = {
        "random": 100 + rng.normal(0, 1, 120).cumsum(),
        "flat": np.full(120, 50.0),
        "line": np.arange(120.0) + 5,
        "steps": np.repeat(rng.uniform(10, 20, 12), 10),
        "two values": np.tile([10.0, 12.0], 60),
    }[kind]
    at = np.arange(1, 120)
    sizes = np.minimum(at, 20)
    expected = [anchor(closes[i - k : i].tolist()) for i, k in zip(at, sizes, strict=True)]
    # Flat windows have no range: an error of the last digit of a price counts as some of a ten-thousandth.
    assert anchor_scores(closes, at, sizes) == pytest.approx(expected, abs=1e-3 if kind == "flat" else 1e-6)


def test_every_window_has_its_anchor(spark):
    closes = {r["rn"]: r["close"] for r in owned(bars(spark, SMOKE_DIR)).collect()}
    rows = scored(spark, SMOKE_DIR).where("scored").collect()
    assert rows
    for r in rows:
        window = [closes[i] for i in range(r["rn"] - r["lookback"], r["rn"])]
        assert r["scale_raw"] == pytest.approx(anchor(window), abs=1e-6)
        scale = min(max((r["scale_raw"] - 0.3) / 0.5, 0.0), 1.0)
        assert r["c_scale"] == pytest.approx(scale, abs=1e-9)
        assert PARAMS.weight_scale > 0


def exact(prices):
    """The forecast without rounding; the lags must not be collinear."""
    p = [Fraction(x) for x in prices.tolist()]
    rows = [[p[i - 1], p[i - 2], p[i - 3], Fraction(1), p[i]] for i in range(3, len(p))]
    m = [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(4)]
    for i in range(4):
        for j in range(4):
            if j != i:
                share = m[j][i] / m[i][i]
                m[j] = [x - share * y for x, y in zip(m[j], m[i], strict=True)]
    return float(sum(m[i][4] / m[i][i] * x for i, x in enumerate([p[-1], p[-2], p[-3], 1])))


@pytest.mark.parametrize("unit", [1e-20, 1e-12, 1e-6, 1.0, 1e6, 1e20])
def test_forecasts_do_not_depend_on_how_small_or_large_prices_are(unit):
    """Beside the constant prices of 1e-12 were taken for nothing."""
    rng = np.random.default_rng(5)
    windows = unit * np.exp(rng.normal(0, 1, (40, 11)).cumsum(axis=1))
    expected = np.array([exact(w) for w in windows])
    span = windows.max(axis=1) - windows.min(axis=1)
    assert (np.abs(autoregressive_forecasts(windows) - expected) / span).max() < 1e-9


@pytest.mark.parametrize("unit", [1e-60, 1e-150, 1e-225])
def test_anchors_of_prices_whose_determinants_underflow(unit):
    """Products of six such prices are 0; the span is then the least one, and no forecast is far from the last price."""
    rng = np.random.default_rng(7)
    closes = unit * np.exp(rng.normal(0, 1, 60).cumsum())
    at = np.arange(12, 60)
    windows = closes[at[:, None] + np.arange(-12, 0)[None, :]]
    expected = np.array([exact(w[:-1]) for w in windows])
    span = windows.max(axis=1) - windows.min(axis=1)
    assert (np.abs(autoregressive_forecasts(windows[:, :-1]) - expected) / span).max() < 1e-9
    assert anchor_scores(closes, at, np.full(48, 12)).tolist() == [1.0] * 48


def test_coefficients_that_the_lags_leave_open_have_the_least_norm():
    """Also beside prices far from zero: the constant counts as one of the coefficients."""
    rng = np.random.default_rng(6)
    for level in (0.0, 1.0, 50.0):
        rise = level + np.repeat([0.0, 1.0], [19, 1]) * rng.uniform(1, 2)
        told = [rise, level + np.tile(rng.uniform(1, 2, 2), 10), level + np.append(np.tile([1.0, 2.0], 9), [5.0, 9.0])]
        expected = [forecast(w.tolist()) for w in told]
        assert autoregressive_forecasts(np.array(told)) == pytest.approx(expected, rel=1e-9)
