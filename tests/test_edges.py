"""Edge cases and invariants: hand-made bars whose results are known."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR
from tidemark.functions.quantiles import quantiles
from tidemark.operators import breakout, calibration, context, detector, metrics, report, validation
from tidemark.operators import features as feat
from tidemark.plans.params import COMPONENTS, EPSILON, Params
from tidemark.plans import queries
from tidemark.plans.queries import ACTIVE, PARAMS, QUERIES, bars, context_of, scored
from tidemark.sources.bars import chunked, halo, latest, numbered, owned, read_bars

BARS = "series_key string, ts timestamp, open double, high double, low double, close double"
HEADER = "open,high,low,close,snapshotTime\n"


def made(spark, closes, spread: float = 1.0):
    start = datetime(2024, 1, 1)
    rows = [("ALL", start + timedelta(hours=i), c, c + spread, c - spread, c) for i, c in enumerate(closes)]
    return chunked(numbered(spark.createDataFrame(rows, BARS)), *halo(PARAMS))


# Sources.


def test_csv_with_bad_cells(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text(HEADER + "1,2,0.5,1.5,2026:03:02-09:30:00\n1,x,0.5,1,2026:03:02-09:45:00\n1,2,0.5,,2026:03:02-10:00:00\n")
    rows = read_bars(spark, path).collect()
    assert [(r["ts"], r["close"]) for r in rows] == [(datetime(2026, 3, 2, 9, 30), 1.5)]


def test_csv_with_the_other_time_column(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("date,open,high,low,close\n2026-03-02 09:30:00,1,2,0.5,1.5\n")
    assert read_bars(spark, path).first()["ts"] == datetime(2026, 3, 2, 9, 30)


@pytest.mark.parametrize(
    ("text", "said"),
    [("open,high,low,snapshotTime\n1,2,1,2026:03:02-09:30:00\n", "close"), (HEADER + "a,b,c,d,e\n", "no usable rows")],
)
def test_csv_that_cannot_be_used(spark, tmp_path, text, said):
    path = tmp_path / "bars.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match=said):
        read_bars(spark, path)


def test_stale_bars_are_refused(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text(HEADER + "1,2,0.5,1.5,2020:03:02-09:30:00\n")
    with pytest.raises(ValueError, match="stale"):
        read_bars(spark, path, max_age_hours=2.0)


def test_rows_are_numbered_over_months_and_chunks(spark):
    df = made(spark, [100.0 + i for i in range(2_000)])
    assert [r["rn"] for r in owned(df).orderBy("ts").select("rn").collect()] == list(range(2_000))


def test_small_chunks_give_the_same_features(spark):
    closes = (100 + np.random.default_rng(3).normal(0, 1, 3_000).cumsum()).tolist()
    rows = numbered(made(spark, closes).where("owned").select("series_key", "ts", "open", "high", "low", "close"))
    columns = ["rn", "realized_vol_100", "vol_ratio_100", "rsi_50", "hurst_50", "sutte_adaptive_signal"]

    def told(df):
        return owned(feat.all_features(df)).select("rn", *[F.round(c, 8).alias(c) for c in columns[1:]])

    whole, parts = told(chunked(rows)), told(chunked(rows, size=700, before=512, after=64))
    assert parts.count() == 3_000 and whole.exceptAll(parts).count() == 0


# Features.


def test_chunks_that_carry_too_little_are_refused(spark):
    rows = numbered(made(spark, [50.0 + i % 7 for i in range(120)]).where("owned").select("series_key", "ts", "open", "high", "low", "close"))
    params = Params(lookback=50)
    with pytest.raises(ValueError, match="halo"):
        context.context_scores(context.compression_signature(feat.context_features(chunked(rows))), params)
    with pytest.raises(ValueError, match="halo"):
        validation.direction_targets(chunked(rows, after=5), 6)
    assert owned(validation.direction_targets(chunked(rows, after=6), 6)).where("target IS NULL").count() == 6


def test_a_long_horizon_has_a_target_across_chunks(spark):
    rows = spark.range(40_000).select(
        F.lit("ALL").alias("series_key"), F.col("id").alias("rn"), F.lit(40_000).alias("n"), (F.col("id") + 1.0).alias("close")
    )
    told = owned(validation.direction_targets(chunked(rows, after=100), 100))
    assert told.where("target IS NULL").count() == 100 and told.count() == 40_000


def test_small_chunks_give_the_same_scores_and_signals(spark, monkeypatch):
    rng = np.random.default_rng(9)
    closes = (100 + rng.normal(0, 1, 600).cumsum()).tolist()
    rows = numbered(made(spark, closes).where("owned").select("series_key", "ts", "open", "high", "low", "close"))
    params = replace(ACTIVE, min_expansion=0.5)

    def told(size: int):
        monkeypatch.setattr(chunked, "__defaults__", (*chunked.__defaults__[:2], size))
        scores = detector.score_windows(feat.context_features(chunked(rows, *halo(params), size=size)), params)
        columns = [F.round(c, 9).alias(c) for c in ("score", "scale_raw", "attention_raw")]
        signals = breakout.signals(scores, params).select("rn", F.round("probability", 9).alias("p"), "direction")
        return multiset(scores.select("rn", *columns).collect()), multiset(signals.collect())

    whole, parts = told(16_384), told(70)
    assert whole == parts and {r[2] for r in whole[1]} == {-1, 0, 1}


def multiset(rows):
    return sorted(map(tuple, rows), key=str)


def test_the_live_window_needs_the_last_rows_only(spark):
    whole = detector.live_window(context_of(spark, SMOKE_DIR), PARAMS).select("rn", F.round("score", 9).alias("s")).collect()
    near = QUERIES["live_window"](spark, SMOKE_DIR).collect()
    assert len(whole) == 1 and len(near) == 5
    alone = latest(queries.numbered_bars(spark, SMOKE_DIR), halo(PARAMS)[0] + 1)
    told = detector.live_window(feat.context_features(chunked(alone, *halo(PARAMS))), PARAMS)
    assert told.select("rn", F.round("score", 9).alias("s")).collect() == whole


def test_every_feature_is_there(spark):
    df = bars(spark, SMOKE_DIR)
    assert len(set(feat.all_features(df).columns) - set(df.columns)) == 86


def test_flat_prices(spark):
    rows = owned(feat.all_features(made(spark, [50.0] * 120, spread=0.0))).orderBy("rn").collect()
    last = rows[-1].asDict()
    assert last["rsi_5"] is None and last["zscore_20"] is None and last["vol_ratio_20"] is None
    assert last["hurst_20"] == 0.5 and last["range_width_20"] == 0 and last["body_to_range_ratio"] == 0


def test_only_gains(spark):
    rows = owned(feat.all_features(made(spark, [50.0 + i for i in range(60)]))).orderBy("rn").collect()
    assert rows[-1]["rsi_20"] == 100


def test_fewer_rows_than_a_window(spark):
    rows = owned(feat.all_features(made(spark, [50.0, 51.0, 52.0]))).orderBy("rn").collect()
    assert rows[-1]["high_5"] is None and rows[-1]["realized_vol_5"] is None and rows[-1]["sutte_low_ma"] is not None


# Detector.


def test_scores_stay_in_bounds_and_weights_add_up(spark):
    df = scored(spark, SMOKE_DIR).where("scored").persist()
    low, high = df.select(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1 and abs(sum(PARAMS.weight(c) for c in COMPONENTS) - 1) < 1e-12
    names = [f"c_{c}" for c in COMPONENTS]
    ends = df.agg(F.least(*map(F.min, names)).alias("low"), F.greatest(*map(F.max, names)).alias("high")).first()
    assert -1e-9 <= ends["low"] <= ends["high"] <= 1 + 1e-9
    zones = detector.zones(df, PARAMS)
    assert zones.where("end_idx <> start_idx + duration - 1").count() == 0


def test_nothing_is_scored_when_the_future_is_too_short(spark):
    params = replace(PARAMS, lookforward=3, min_bars=5)
    assert detector.score_windows(context_of(spark, SMOKE_DIR), params).where("scored").count() == 0


def test_no_score_looks_ahead(spark):
    closes = (100 + np.random.default_rng(7).normal(0, 1, 200).cumsum()).tolist()
    changed = closes[:150] + [c * 2 for c in closes[150:]]

    def told(values):
        df = detector.score_windows(feat.context_features(made(spark, values)), PARAMS)
        return df.where("scored AND rn <= 150").select("rn", F.round("score", 9).alias("score"))

    assert told(closes).exceptAll(told(changed)).count() == 0


def test_the_forecast_of_collinear_prices_is_finite():
    windows = np.array([np.full(20, 7.0), np.arange(20.0)])
    assert context.autoregressive_forecasts(windows) == pytest.approx([7.0, 20.0])
    assert context.autoregressive_forecasts(np.array([[1.0, 5.0]])) == [5.0]
    assert context.anchor_scores(np.array([3.0, 3.0]), np.array([1]), np.array([1])) == [0.5]


# Breakouts.


@pytest.mark.parametrize(("duration", "hold"), [(1, 5), (5, 8), (7, 10), (20, 15)])
def test_hold_periods_round_half_to_even(spark, duration, hold):
    row = spark.range(1).select(breakout.hold_period(F.lit(duration), Params(max_hold=15)).alias("h")).first()
    assert row["h"] == hold


def test_signals_are_consistent(spark):
    rows = breakout.signals(scored(spark, SMOKE_DIR), PARAMS).select("probability", "direction").collect()
    assert all(0 <= r["probability"] <= 1 and r["direction"] in (-1, 0, 1) for r in rows)
    assert all(r["probability"] > 0.5 for r in rows if r["direction"])


def test_the_latest_breakout_is_found_from_the_end(spark, monkeypatch):
    """Also where the last zone lies far back, and where there is none."""
    monkeypatch.setattr(breakout, "WIDER", 4)
    for params in (replace(ACTIVE, threshold=0.74), replace(ACTIVE, threshold=0.99)):
        whole = breakout.current_breakout(scored(spark, SMOKE_DIR, params, queries.BY_TYPE), params)
        near = breakout.latest_breakouts(queries.numbered_bars(spark, SMOKE_DIR, *queries.BY_TYPE), params, tail=50)
        assert multiset(near.collect()) == multiset(whole.collect())


def test_the_payload_says_what_its_parts_say(spark):
    payloads = {r["series_key"]: json.loads(r["payload"]) for r in QUERIES["forecast_payload"](spark, SMOKE_DIR).collect()}
    last = {r["series_key"]: r for r in QUERIES["latest_breakout"](spark, SMOKE_DIR).collect()}
    flags = {r["series_key"]: r["value"] for r in QUERIES["regime"](spark, SMOKE_DIR).where("metric = 'regime_shift_flag'").collect()}
    assert len(payloads) == 5
    for key, told in payloads.items():
        on = told["consolidation"]["active"]
        assert on == (told["consolidation"]["score"] > ACTIVE.threshold)
        assert (told["forecast"] is not None) == on
        assert told["context"]["regime_shift_detected"] == (flags[key] == 1)
        if on:
            assert told["forecast"]["probability"] == pytest.approx(last[key]["probability"], abs=1e-6)
            assert told["forecast"]["direction"] == {1: "up", -1: "down", 0: "none"}[last[key]["direction"]]


# Validation and calibration.


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError, match="too few"):
        validation.fold_bounds(8, 5, 3)
    assert validation.folds(made(spark, [1.0] * 8).where("owned")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(9, 5_000), st.integers(2, 5))
def test_folds_follow_each_other(n, splits):
    bounds = validation.fold_bounds(n, splits, 3)
    assert bounds[-1][3] == n and len({val - first for _, first, val, _ in bounds}) == 1
    assert all(a[3] == b[2] for a, b in zip(bounds, bounds[1:], strict=False))


@settings(max_examples=50, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=2, max_size=9))
@example([(0.0, 0.0), (0.9999999999999999, 0.0)])
def test_calibration_never_falls(points):
    model = calibration.anchors(points)
    if model:
        assert list(model.calibrated) == sorted(model.calibrated) and list(model.raw) == sorted(model.raw)
        assert model.raw[0] <= EPSILON and 1 - model.raw[-1] <= EPSILON  # points as near as that are one


def test_few_samples_are_not_calibrated(spark):
    rows = spark.createDataFrame([(0.6, 1)] * 24, "p double, hit int")
    assert calibration.fit(rows) is None


def test_the_search_is_seeded_and_keeps_the_best():
    best, tried = validation.search(None, 6, evaluate=lambda p: -abs(p.threshold - 0.3))
    again, _ = validation.search(None, 6, evaluate=lambda p: -abs(p.threshold - 0.3))
    assert best == again == max(tried, key=lambda t: t[1])[0]
    assert all(abs(sum(p.weight(c) for c in COMPONENTS) - 1) < 1e-9 for p, _ in tried)


def test_steady_folds_have_no_penalty():
    assert validation.stability_penalty([0.4] * 5) == pytest.approx(0)
    assert validation.stability_penalty([0.5, 0.4, 0.3, 0.2, 0.1]) > validation.stability_penalty([0.1, 0.2, 0.3, 0.4, 0.5])
    assert validation.objective([{"brier": 0.2, "coverage": 1.0}]) == -1.0
    assert validation.objective([{"brier": 0.2, "coverage": 0.5}, {"brier": 0.3, "coverage": 0.0}]) == pytest.approx(-0.25)
    assert validation.objective([{"brier": 0.2, "coverage": 0.0}] * 2) == -1.0
    fold = {"f1": 0.5, "sharpe": 1.0, "precision": 0.6, "recall": 0.4}
    assert validation.objective([{**fold, "fold": i} for i in range(3)], "blended") == pytest.approx(0.65)


def test_a_setting_is_named_by_its_digest():
    assert Params().digest() == Params().digest() != Params(lookback=21).digest()
    assert len(Params().digest()) == 8


# Reports.


def test_metrics_are_logged(spark, caplog):
    told = spark.createDataFrame([("A", "x", 0.5), ("A", "y", None)], "series_key string, metric string, value double")
    with caplog.at_level("INFO", logger="tidemark"):
        assert report.log_metrics(told) == 2
    assert [r.message for r in caplog.records] == ["A x 0.5000", "A y none"]


def test_spacing_keeps_the_gap_between_chunks(spark):
    """Every second gap is long; one more short one decides the median, and it lies between two chunks."""
    n = 16_384 + 2
    rows = spark.range(n).select(
        F.lit("A").alias("series_key"),
        F.timestamp_micros(F.col("id") * 1_000_000 + F.floor(F.col("id") / 2) * 1_000_000).alias("ts"),
        F.col("id").alias("rn"),
        F.lit(n).alias("n"),
    )
    times = np.array([i * 1000 + i // 2 * 1000 for i in range(n)])
    assert report.bar_spacing(rows).first()["bar_width_ms"] == 0.8 * np.median(np.diff(times))


def test_sparse_features_are_read_however_far_apart(spark):
    rng = np.random.default_rng(4)
    values = {i: float(v) for i, v in zip(range(0, 50_000, 1_000), rng.normal(0, 1, 50), strict=True)}
    rows = [("A", i, 50_000, values[i]) for i in values] + [("A", 49_999, 50_000, None), ("B", 0, 1, None)]
    told = metrics.instability(spark.createDataFrame(rows, "series_key string, rn long, n long, v double"), ("v",)).collect()
    series = np.array(list(values.values()))
    devs = [series[i - 19 : i + 1].std(ddof=1) for i in range(30, 50)]
    assert {r["series_key"]: r["value"] for r in told} == {"A": pytest.approx(np.mean(devs)), "B": 0.0}


def test_a_series_without_returns_has_a_calm_regime(spark):
    rows = spark.createDataFrame([("A", 0, 1, 5.0)], "series_key string, rn long, n long, close double")
    told = metrics.regime_metrics(rows).first().asDict()
    assert told == {
        "series_key": "A", "regime_recent_vol": 0.0, "regime_baseline_vol": 0.0, "regime_recent_ewm_vol": 0.0,
        "regime_baseline_ewm_vol": 0.0, "regime_vol_ratio": 1.0, "regime_ewm_vol_ratio": 1.0, "regime_shift_flag": 0.0,
    }


def test_resampled_means_lie_around_the_mean(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 1, 2_000)
    rows = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(p)] + [("A", 9_999, 0.0)], "series_key string, rn long, probability double")

    def told(size: int):
        monkeypatch.setattr(metrics, "CHUNK", size)
        return metrics.bootstrap_interval(rows).first()

    for r in (told(16_384), told(130)):
        error = p.std() / len(p) ** 0.5
        assert r["p50"] == pytest.approx(p.mean(), abs=error / 4)
        assert (r["p95"] - r["p05"]) / 2 == pytest.approx(1.645 * error, rel=0.15)
    assert told(130) == told(130)


@pytest.mark.parametrize("at", [(0.0, 0.25, 0.5, 1.0), (1 / 7, 2 / 7, 6 / 7)])
def test_quantiles_are_exact(spark, at):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 1_001), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    told = quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", at).collect()
    assert {r["k"] for r in told} == set(groups)
    for r in told:
        assert r["quantiles"] == pytest.approx(np.quantile(groups[r["k"]], at).tolist(), abs=1e-12)


def test_a_page_of_tables(spark, tmp_path):
    out = report.write_page(tmp_path / "deep" / "page.html", "A <title>", {"t": spark.range(3)})
    text = out.read_text(encoding="utf-8")
    assert "A &lt;title&gt;" in text and text.count("<tr") == 4


@pytest.mark.parametrize(("seconds", "label"), [(0, "0m"), (3_600, "1h"), (183_600, "2d 3h"), (90, "1m")])
def test_span_labels(seconds, label):
    assert report.span_label(seconds) == label
