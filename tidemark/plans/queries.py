"""Registered queries over the events table, and their SQL oracles."""

from __future__ import annotations

import random
from dataclasses import asdict, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut, scratch
from tidemark.operators import baseline as base
from tidemark.operators import breakout, calibration, charts, context, detector, metrics, report, validation
from tidemark.operators import search as tuning
from tidemark.operators import features as feat
from tidemark.plans import oracles as sql
from tidemark.plans.params import COMPONENTS, LONG, MEDIUM, SEARCH, SEED, SHORT, Params
from tidemark.sources.bars import CSV_TIME, bars_from_events, chunked, halo, latest, numbered, owned, read_bars, walk
from tidemark.streaming.bars import DELAY, stream_bars, write_bars
from tidemark.streaming.growing import read_growing, read_unusable, write_growing
from tidemark.streaming.signals import read_signals, write_signals

PARAMS = Params()
#: Windows that every component can answer, and a threshold that rejects most of them: bars of moving prices
#: break out both ways, with probabilities that are not all near 1.
ACTIVE = replace(
    PARAMS, lookback=12, min_bars=3, max_hold=10, min_expansion=1.1, threshold=0.5, steepness=1.0, range_threshold=4.0
)
#: A threshold that accepts windows of some series and none of others.
STRICT = replace(ACTIVE, threshold=0.63)
ALL = SHORT + MEDIUM + LONG
MAIN = SHORT + MEDIUM
KEYS = ["series_key", "ts", "rn"]
#: Width and key of bars: one series of all events, and one for each type, whose bars are narrow and often flat.
HOURLY = ("1 hour", None)
BY_TYPE = ("1 hour", "event_type")
#: Bars of the prices of each type, which move as those of a market do; ACTIVE is asked of them.
MOVING = ("1 hour", sql.WALK)
#: Bars that trials are valued on, settings that importance is told from, and trials of the search.
TRIED, TRIALS, SEARCHED = ("2 hours", sql.WALK), 12, 30
#: Pixel columns that lines are drawn in.
PIXELS = 100
#: Parts of the events that the stream of signals is started with.
PARTS = 3
#: Zones that end from then on, and how many of each series, are recent.
SINCE, RECENT = "2024-01-15 00:00:00", 40


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def numbered_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour", key: str | None = None) -> DataFrame:
    given = events(spark, sf_dir)
    if key == sql.WALK:
        given, key = walk(given, "event_type"), "event_type"
    return numbered(bars_from_events(given, width, key))


def bars(
    spark: SparkSession, sf_dir: str, width: str = "1 hour", key: str | None = None, params: Params = PARAMS
) -> DataFrame:
    return chunked(numbered_bars(spark, sf_dir, width, key), *halo(params))


def rounded(df: DataFrame, columns: list[str], doubles: list[str]) -> DataFrame:
    return df.select(*columns, *[(F.round(c, 6) + 0.0).alias(c) for c in doubles])


GEOMETRY = [
    "typical_price", "hl_range", "hl_range_pct", "oc_range", "oc_range_pct", "volume_proxy", "body_size",
    "upper_wick", "lower_wick", "body_to_range_ratio", "wick_balance",
]
PHASE = [
    "hour_utc", "day_of_week", "minute_of_day", "hour_sin", "hour_cos", "minute_sin", "minute_cos", "dow_sin", "dow_cos",
]
SUTTE = ["sutte_low_ratio", "sutte_high_ratio", "sutte_low_ma", "sutte_high_ma", "sutte_signal", "sutte_conviction"]
ADAPTIVE = ["sutte_adaptive_low", "sutte_adaptive_high", "sutte_adaptive_signal"]
SCORES = [*[f"c_{c}" for c in COMPONENTS], "interaction_score", "scale_raw", "score", "divergence_confidence"]
ZONES = [
    "range_width", "range_width_pct", "volatility_ratio", "mean_reversion_strength", "hurst_exponent",
    "consolidation_score", "attention_context_score_raw", "periodic_context_score_raw", "scale_anchor_score_raw",
    "attention_context_score", "periodic_context_score", "scale_anchor_score", "sutte_score_raw", "sutte_score", "sutte_divergence",
    "sutte_divergence_confidence", "interaction_score",
]


def _feature_query(make, columns: list[str], width: str = "1 hour", key: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(owned(make(bars(spark, sf_dir, width, key))), KEYS, columns)

    return run


def _volatility(df: DataFrame, periods=ALL) -> DataFrame:
    return feat.volatility(feat.temporal_phase(feat.price_geometry(df)), periods)


def _momentum(df: DataFrame) -> DataFrame:
    return feat.momentum(feat.price_geometry(df))


def _each(names: list[str], periods=ALL) -> list[str]:
    return [f"{x}_{p}" for x in names for p in periods]


def context_of(
    spark: SparkSession, sf_dir: str, width: str = "1 hour", key: str | None = None, params: Params = PARAMS
) -> DataFrame:
    return feat.context_features(bars(spark, sf_dir, width, key, params))


def scored(spark: SparkSession, sf_dir: str, params: Params = PARAMS, bar: tuple = HOURLY) -> DataFrame:
    return detector.score_windows(context_of(spark, sf_dir, *bar, params), params)


def ohlc_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(events(spark, sf_dir), *BY_TYPE)


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the events read as a stream: those that the watermark has closed by its end."""
    # A stream reads a folder or a pattern, not one file.
    source = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/[e]vents.parquet")
    out, checkpoint = scratch(spark, "bars"), scratch(spark, "stream")
    write_bars(stream_bars(source, *BY_TYPE), out, checkpoint, once=True).awaitTermination()
    closed = spark.read.parquet(out)
    return closed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV files, with rows that cannot be read among them, and read again."""
    path = scratch(spark, "csv")
    made = bars_from_events(events(spark, sf_dir)).select(
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.date_format("ts", CSV_TIME).alias("snapshotTime"),
    )
    broken = made.limit(3).withColumn("close", F.lit("none")).unionByName(made.limit(2).withColumn("snapshotTime", F.lit(None)))
    made.unionByName(broken).write.csv(path, header=True)
    return read_bars(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def grown(spark: SparkSession, sf_dir: str) -> str:
    """A table of bars that came as CSV files in parts, the stream started anew for each; some rows cannot be used.

    Bars of midnight come again without a close, those of one o'clock without a time, and with the
    last part those of two o'clock from before once more.
    """
    source, out, checkpoint = (scratch(spark, x) for x in ("csv", "bars", "stream"))
    made = numbered_bars(spark, sf_dir, *BY_TYPE).withColumn("part", F.floor(F.col("rn") * PARTS / F.col("n")))
    cells = made.select(
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.date_format("ts", CSV_TIME).alias("snapshotTime"),
        F.col("series_key").alias("event_type"),
        F.hour("ts").alias("hour"),
        "part",
    )
    cells = cut(
        cells.unionByName(cells.where("hour = 0").withColumn("close", F.lit("none")))
        .unionByName(cells.where("hour = 1").withColumn("snapshotTime", F.lit(None).cast("string")))
        .unionByName(cells.where(f"hour = 2 AND part < {PARTS - 1}").withColumn("part", F.lit(PARTS - 1).cast("long")))
    )
    for k in range(PARTS):
        cells.where(F.col("part") == k).drop("hour", "part").write.mode("append").csv(source, header=True)
        write_growing(spark, source, out, checkpoint, "event_type", once=True).awaitTermination()
    return out


def growing_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read_growing(spark, grown(spark, sf_dir))
    return told.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def growing_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be used of the same arrivals, with how often it came."""
    told = read_unusable(spark, grown(spark, sf_dir))
    return told.groupBy("series_key", "reason", "given_time").agg(F.count("*").alias("n"))


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of complete bars."""
    made = feat.complete(owned(feat.all_features(bars(spark, sf_dir, *BY_TYPE))))
    return rounded(made, KEYS, FEATURES)


FEATURES = [
    *GEOMETRY, *PHASE, "log_return",
    *_each(["high", "low", "range_width", "range_width_pct", "vol_ratio", "price_position", "realized_vol"]),
    *_each(["roc", "momentum", "rsi", "trend_strength"], MAIN), *_each(["zscore", "hurst"], MEDIUM),
    *SUTTE, "sutte_direction", *ADAPTIVE,
]


def window_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = owned(detector.window_core(feat.price_geometry(bars(spark, sf_dir)), PARAMS)).where("scored")
    return rounded(df, [*KEYS, "lookback"], ["past_range", "past_range_pct", "past_vol", "vol_contraction", "c_contraction", "c_range"])


def window_core_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = owned(detector.window_core(feat.price_geometry(bars(spark, sf_dir, *BY_TYPE)), PARAMS)).where("scored")
    return rounded(df, [*KEYS, "lookback"], ["past_range_pct", "vol_contraction", "c_contraction", "c_range"])


def position_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = owned(detector.position_std(bars(spark, sf_dir), PARAMS)).where(f"rn >= {PARAMS.min_bars}")
    return rounded(df, KEYS, ["pos_std"])


def sutte_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = feat.sutte(bars(spark, sf_dir)).withColumn("lookback", F.least("rn", F.lit(PARAMS.lookback)))
    return rounded(owned(detector.sutte_score(df, PARAMS)).where("rn > 0"), KEYS, ["sutte_raw"])


def compression_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(owned(context.compression_signature(context_of(spark, sf_dir))), KEYS, ["signature"])


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.context_scores(context.compression_signature(context_of(spark, sf_dir)), PARAMS, anchor=False)
    return rounded(df.where("rn > 0"), ["series_key", "rn"], ["attention_raw", "periodic_raw"])


def score_components(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    df = scored(spark, sf_dir, params, bar).where("scored")
    return rounded(df, [*KEYS, "lookback", "divergence_signal"], SCORES)


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_components(spark, sf_dir, PARAMS, HOURLY)


def scored_windows_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_components(spark, sf_dir, PARAMS, ("15 minutes", "event_type"))


def zones(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    found = detector.zones(scored(spark, sf_dir, params, bar), params)
    return rounded(found, ["series_key", "start_idx", "end_idx", "duration", "sutte_divergence_signal"], ZONES)


def live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that the last window reaches are made into features."""
    before, after = halo(PARAMS)
    near = chunked(latest(numbered_bars(spark, sf_dir, *BY_TYPE), before + 1), before, after)
    return rounded(detector.live_window(feat.context_features(near), PARAMS), [*KEYS, "divergence_signal"], ["scale_raw", "score"])


def threshold_diagnosis(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    told = detector.threshold_diagnosis(detector.diagnostic_scores(scored(spark, sf_dir, params, bar)), params)
    return rounded(told, ["series_key", "level", "above", "n"], ["mean", "std", "min", "p25", "p50", "p75", "max"])


def auto_threshold(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    told = detector.auto_threshold(detector.diagnostic_scores(scored(spark, sf_dir, params, bar)), params)
    return rounded(told, ["series_key"], ["threshold"])


def detection_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Params]:
    """Scored windows with the threshold of each series, after series without a zone got another."""
    return detector.redetected(cut(scored(spark, sf_dir, STRICT, MOVING)), STRICT)


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _ = detection_run(spark, sf_dir)
    accepted = F.count_if(F.col("scored") & (F.col("score") > F.col("threshold"))).alias("zones")
    counted = told.groupBy("series_key", "threshold").agg(accepted, F.count_if("scored").alias("windows"))
    return rounded(counted, ["series_key", "zones", "windows"], ["threshold"])


def redetected_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detector.zones(*detection_run(spark, sf_dir))
    return rounded(found, ["series_key", "start_idx", "end_idx", "duration", "sutte_divergence_signal"], ZONES)


def redetected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(breakout.signals(*detection_run(spark, sf_dir)), [*KEYS, "direction"], ["probability"])


def zone_bars(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    told = breakout.zone_bars(scored(spark, sf_dir, params, bar), params)
    return rounded(told, ["series_key", "rn", "zone_end", "direction"], ["probability"])


def told_of(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    return breakout.signals(scored(spark, sf_dir, params, bar), params)


def breakout_signals(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    return rounded(told_of(spark, sf_dir, params, bar), [*KEYS, "direction"], ["probability"])


def latest_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = breakout.latest_breakouts(numbered_bars(spark, sf_dir, *MOVING), ACTIVE)
    return rounded(told, ["series_key", "rn", "zone_end", "direction"], ["probability"])


def cv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = validation.folds(numbered_bars(spark, sf_dir, *BY_TYPE))
    return dealt.groupBy(F.col("origin").alias("series_key"), "fold").agg(
        F.min("old_rn").alias("train_start"),
        F.min(F.when(F.col("validation"), F.col("old_rn"))).alias("validation_start"),
        (F.max("old_rn") + 1).alias("validation_end"),
        F.count("*").alias("bars"),
        F.max("rn").alias("last_rn"),
    )


def direction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = owned(validation.direction_targets(bars(spark, sf_dir), PARAMS.max_hold))
    return rounded(df, [*KEYS, "target"], ["future_return"])


def fold_told(spark: SparkSession, sf_dir: str, bar: tuple = MOVING) -> DataFrame:
    return validation.fold_signals(owned(context_of(spark, sf_dir, *bar, ACTIVE)), ACTIVE)


def fold_signals(spark: SparkSession, sf_dir: str, bar: tuple = MOVING) -> DataFrame:
    told = fold_told(spark, sf_dir, bar)
    return rounded(told, ["origin", "fold", "old_rn", "direction", "target", "fold_target"], ["probability", "up_probability"])


def fold_metrics(spark: SparkSession, sf_dir: str, bar: tuple = MOVING) -> DataFrame:
    told = validation.fold_metrics(fold_told(spark, sf_dir, bar))
    return rounded(told, ["origin", "fold", "labelled"], FOLD_METRICS)


FOLD_METRICS = ["brier", "coverage", "answered_accuracy", "active_f1", "active_precision", "active_sharpe"]


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.fold_scores(fold_told(spark, sf_dir)), ["origin", "fold"], ["f1", "precision", "recall", "sharpe"])


def calibration_bins(spark: SparkSession, sf_dir: str, bar: tuple = MOVING) -> DataFrame:
    told = calibration.bins(calibration.usable(fold_told(spark, sf_dir, bar)))
    return rounded(told, ["bin", "n"], ["low", "high", "mean_p", "hit_rate", "blended"])


def calibrated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = calibration.fit(cut(calibration.usable(fold_told(spark, sf_dir))))
    told = told_of(spark, sf_dir)
    return rounded(model.apply(told) if model else told, [*KEYS, "direction"], ["probability"])


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut(scored(spark, sf_dir, ACTIVE, MOVING))
    made = owned(feat.period_features(bars(spark, sf_dir, *MOVING), 20))
    told = metrics.run_metrics(
        detector.zones(df, ACTIVE), breakout.signals(df, ACTIVE), numbered_bars(spark, sf_dir, *MOVING), made
    )
    return rounded(told, ["series_key", "metric"], ["value"])


def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = metrics.long_form(metrics.regime_metrics(numbered_bars(spark, sf_dir, *BY_TYPE)))
    return rounded(told, ["series_key", "metric"], ["value"])


def feature_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = owned(feat.period_features(bars(spark, sf_dir, *BY_TYPE), 20))
    return rounded(metrics.instability(made), ["series_key", "metric"], ["value"])


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap_interval(told_of(spark, sf_dir))


def timed(spark: SparkSession, sf_dir: str, params: Params, bar: tuple) -> DataFrame:
    df = cut(scored(spark, sf_dir, params, bar))  # read for its zones and twice for their times
    return report.timed_zones(detector.zones(df, params), df.select("series_key", "rn", "ts"))


def heatmap(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    return rounded(report.heatmap(timed(spark, sf_dir, params, bar)), ["series_key", "day", "hour", "zones"], ["mean_score"])


def event_frame(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    return rounded(report.event_frame(timed(spark, sf_dir, params, bar)), ["series_key", "timestamp_end"], EVENT)


EVENT = [
    "consolidation_score", "attention_context_score", "periodic_context_score", "scale_anchor_score", "sutte_score",
    "interaction_score",
]


def recent_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = report.recent_zones(timed(spark, sf_dir, ACTIVE, MOVING), F.lit(SINCE).cast("timestamp_ntz"), RECENT)
    return rounded(told, ["series_key", "start_idx", "end_idx", "timestamp_start", "timestamp_end"], ["consolidation_score"])


def follow_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut(scored(spark, sf_dir, ACTIVE, MOVING))
    told = report.follow_through(
        detector.zones(df, ACTIVE), df.select(*KEYS, "high", "low", "close"), breakout.signals(df, ACTIVE)
    )
    return rounded(told, [*KEYS, "part", "marker"], ["close", "resistance", "support", "midline", "marker_probability"])


def latest_signal(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    told = report.latest_signal(told_of(spark, sf_dir, params, bar))
    return rounded(told, LATEST, ["probability", "latest_raw_probability"])


LATEST = [
    "series_key", "visibility", "direction", "signal_ts", "active_up_count", "active_down_count", "raw_up_count",
    "raw_down_count", "latest_raw_direction", "latest_raw_ts",
]


def zone_snapshot(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    df = cut(scored(spark, sf_dir, params, bar))
    told = report.zone_snapshot(detector.zones(df, params), df.select("series_key", "rn"))
    return rounded(told, ["series_key", "available", "duration", "post_bars", "maturity"], ["score"])


def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut(scored(spark, sf_dir, ACTIVE, MOVING))
    snapshot = report.zone_snapshot(detector.zones(df, ACTIVE), df.select("series_key", "rn"))
    return report.brief(report.latest_signal(breakout.signals(df, ACTIVE)), snapshot)


def full_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief in full, of a run that detects series without zones again."""
    df, params = detection_run(spark, sf_dir)
    df = cut(df)
    found, told = detector.zones(df, params), breakout.signals(df, params)
    bars_of = df.select("series_key", "rn", "ts")
    snapshot = report.zone_snapshot(report.timed_zones(found, bars_of), bars_of)
    gains = metrics.long_form(metrics.signal_metrics(told))
    return report.full_brief(report.latest_signal(told), snapshot, gains)


def component_table(spark: SparkSession, sf_dir: str, params: Params = ACTIVE, bar: tuple = MOVING) -> DataFrame:
    told = report.component_table(detector.zones(scored(spark, sf_dir, params, bar), params), params)
    return rounded(told, ["series_key", "component", "weight"], ["mean", "contribution"])


def bar_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.bar_spacing(numbered_bars(spark, sf_dir, *BY_TYPE)), ["series_key"], ["bar_width_ms"])


def plot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.plot_window(numbered_bars(spark, sf_dir, *BY_TYPE), 7).select(*KEYS, "close")


def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of price and score are drawn from: at most four rows of each of a hundred pixel columns."""
    df = cut(scored(spark, sf_dir, ACTIVE, MOVING))
    lines = [
        charts.downsampled(rows, column, PIXELS).withColumn("line", F.lit(column))
        for column, rows in (("close", df), ("score", df.where("scored")))
    ]
    return rounded(lines[0].unionByName(lines[1]), [*KEYS, "line", "pixel"], ["value"])


def forecast_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = halo(ACTIVE)
    plain = numbered_bars(spark, sf_dir, *MOVING)
    last = breakout.latest_breakouts(plain, ACTIVE)
    live = detector.live_window(feat.context_features(chunked(latest(plain, before + 1), before, after)), ACTIVE)
    regime_now = metrics.regime_metrics(plain).select("series_key", "regime_shift_flag")
    return report.forecast_payload(
        live, last.select("series_key", "zone_end", "probability", "direction"), regime_now, ACTIVE
    )


def _benchmarked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold signals of the model, and of the logistic baseline, on the same features."""
    made = owned(feat.volatility(context_of(spark, sf_dir, *MOVING, ACTIVE), (20,)))
    targets = validation.direction_targets(chunked(made, *halo(ACTIVE)), ACTIVE.max_hold)
    dealt = cut(validation.folds(owned(targets)))
    return cut(validation.fold_signals(made, ACTIVE)), base.baseline(dealt, ACTIVE.max_hold)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base.benchmark(*_benchmarked(spark, sf_dir)), ["metric"], ["value"])


def model_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's side of the benchmark."""
    told = fold_told(spark, sf_dir).withColumn("label", F.col("fold_target"))
    names = [f"model_{x}" for x in ("sample_count", "coverage", "answered_accuracy", "brier")]
    return rounded(base.aggregate_result(told, "model"), [], names)


def trial_settings() -> list[Params]:
    """The settings of the registered trials: seeded draws from the search ranges."""
    rng = random.Random(SEED)
    return [tuning.setting(tuning.draw(rng)) for _ in range(TRIALS)]


def trial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(owned(context_of(spark, sf_dir, *TRIED, WIDEST)))


def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold of every trial, in one job."""
    told = tuning.trial_metrics(trial_features(spark, sf_dir), trial_settings())
    return rounded(told, ["trial", "origin", "fold", "labelled"], FOLD_METRICS)


def trial_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = trial_settings()
    told = tuning.objectives(tuning.trial_metrics(trial_features(spark, sf_dir), settings), len(settings))
    return rounded(told, ["trial"], ["objective"])


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of all parameters over the trials, each valued by its folds."""
    settings = trial_settings()
    told = tuning.objectives(tuning.trial_metrics(trial_features(spark, sf_dir), settings), len(settings))
    names = list(asdict(PARAMS))
    given = spark.createDataFrame(
        [(i, *map(float, asdict(p).values())) for i, p in enumerate(settings)],
        ", ".join(["trial int", *[f"{c} double" for c in names]]),
    )
    return rounded(validation.importance(given.join(told, "trial"), names), ["parameter"], ["importance"])


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trial of the model-based search: its setting, its objective over the folds and whether it is the best."""
    best, tried = tuning.search(trial_features(spark, sf_dir), SEARCHED)
    rows = [(i, p.digest(), *map(float, asdict(p).values()), float(v), p == best) for i, (p, v) in enumerate(tried)]
    names = ", ".join(f"{c} double" for c in [*asdict(PARAMS), "objective"])
    told = spark.createDataFrame(rows, f"trial int, digest string, {names}, best boolean")
    return rounded(told, ["trial", "digest", "best"], [*asdict(PARAMS), "objective"])


#: The longest windows that the search draws.
WIDEST = replace(PARAMS, lookback=SEARCH["lookback"][1], max_hold=SEARCH["max_hold"][1])


def streamed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live score and breakout of every closed bar of a stream that is stopped and started again with each part of the events."""
    given = events(spark, sf_dir)
    ends = given.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    source, out, checkpoint = (scratch(spark, x) for x in ("events", "signals", "stream"))
    step = (ends["b"] - ends["a"]) / PARTS
    edges = [F.lit(str(ends["a"] + k * step)).cast("timestamp_ntz") for k in range(1, PARTS)]
    number = sum(((F.col("ts") >= x).cast("int") for x in edges), F.lit(0))
    for k in range(PARTS):
        given.where(number == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(given.schema).parquet(source)
        write_signals(stream_bars(stream, *BY_TYPE), ACTIVE, out, checkpoint, once=True).awaitTermination()
    told = read_signals(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(told, [*KEYS, "divergence_signal", "zone_end", "direction"], ["score", "probability"])


QUERIES = {
    "ohlc_bars": ohlc_bars,
    "streamed_bars": streamed_bars,
    "csv_bars": csv_bars,
    "growing_bars": growing_bars,
    "growing_unusable": growing_unusable,
    "all_features": all_features,
    "price_geometry": _feature_query(feat.price_geometry, GEOMETRY),
    "price_geometry_by_type": _feature_query(feat.price_geometry, GEOMETRY, *BY_TYPE),
    "temporal_phase": _feature_query(feat.temporal_phase, PHASE),
    "rolling_envelope": _feature_query(_volatility, _each(["high", "low", "range_width", "range_width_pct"])),
    "vol_ratio": _feature_query(_volatility, _each(["vol_ratio"])),
    "price_position": _feature_query(_volatility, _each(["price_position"]), *BY_TYPE),
    "realized_vol": _feature_query(_volatility, ["log_return", *_each(["realized_vol"])]),
    "roc_momentum": _feature_query(_momentum, _each(["roc", "momentum"], MAIN)),
    "rsi": _feature_query(_momentum, _each(["rsi"], MAIN)),
    "trend_strength": _feature_query(_momentum, _each(["trend_strength"], MAIN)),
    "zscore": _feature_query(feat.statistics, _each(["zscore"], MEDIUM)),
    "hurst": _feature_query(feat.hurst, _each(["hurst"], MEDIUM)),
    "sutte": _feature_query(feat.sutte, [*SUTTE, "sutte_direction"]),
    "sutte_adaptive": _feature_query(lambda df: feat.sutte_adaptive(feat.sutte(df)), ADAPTIVE),
    "atr": _feature_query(lambda df: feat.atr(feat.price_geometry(df)), ["atr_20"]),
    "window_core": window_core,
    "window_core_by_type": window_core_by_type,
    "position_std": position_std,
    "sutte_score": sutte_score,
    "compression_signature": compression_signature,
    "context_scores": context_scores,
    "score_components": score_components,
    "scored_windows": scored_windows,
    "scored_windows_by_type": scored_windows_by_type,
    "zones": zones,
    "live_window": live_window,
    "threshold_diagnosis": threshold_diagnosis,
    "auto_threshold": auto_threshold,
    "thresholds": thresholds,
    "redetected_zones": redetected_zones,
    "redetected_signals": redetected_signals,
    "zone_bars": zone_bars,
    "breakout_signals": breakout_signals,
    "latest_breakout": latest_breakout,
    "cv_splits": cv_splits,
    "direction_targets": direction_targets,
    "fold_signals": fold_signals,
    "fold_metrics": fold_metrics,
    "calibration_bins": calibration_bins,
    "calibrated_signals": calibrated_signals,
    "benchmark": benchmark,
    "run_metrics": run_metrics,
    "regime": regime,
    "feature_instability": feature_instability,
    "bootstrap_interval": bootstrap_interval,
    "heatmap": heatmap,
    "event_frame": event_frame,
    "latest_signal": latest_signal,
    "zone_snapshot": zone_snapshot,
    "brief": brief,
    "full_brief": full_brief,
    "component_table": component_table,
    "bar_spacing": bar_spacing,
    "plot_window": plot_window,
    "plot_points": plot_points,
    "forecast_payload": forecast_payload,
    "recent_zones": recent_zones,
    "follow_through": follow_through,
    "model_result": model_result,
    "fold_scores": fold_scores,
    "trial_metrics": trial_metrics,
    "trial_objectives": trial_objectives,
    "search": search,
    "importance": importance,
    "streamed_signals": streamed_signals,
}
#: Queries that are asked of one hourly series too: with the default setting, or the folds' one.
PLAIN = {
    "score_components": score_components,
    "zones": zones,
    "threshold_diagnosis": threshold_diagnosis,
    "auto_threshold": auto_threshold,
    "zone_bars": zone_bars,
    "breakout_signals": breakout_signals,
    "heatmap": heatmap,
    "event_frame": event_frame,
    "latest_signal": latest_signal,
    "zone_snapshot": zone_snapshot,
    "component_table": component_table,
}
FOLDED = {"fold_signals": fold_signals, "fold_metrics": fold_metrics, "calibration_bins": calibration_bins}
QUERIES |= {f"{name}_anchored": partial(query, params=PARAMS, bar=HOURLY) for name, query in PLAIN.items()}
QUERIES |= {f"{name}_anchored": partial(query, bar=HOURLY) for name, query in FOLDED.items()}


ZONE_COLUMNS = """series_key, rn - lookback AS start_idx, rn - 1 AS end_idx, lookback AS duration,
  past_range AS range_width, past_range_pct AS range_width_pct, vol_contraction AS volatility_ratio,
  c_position AS mean_reversion_strength, hurst_exponent, score AS consolidation_score,
  attention_raw AS attention_context_score_raw, periodic_raw AS periodic_context_score_raw, scale_raw AS scale_anchor_score_raw,
  c_attention AS attention_context_score, c_periodic AS periodic_context_score, c_scale AS scale_anchor_score,
  sutte_raw AS sutte_score_raw, c_sutte AS sutte_score, divergence AS sutte_divergence,
  divergence_confidence AS sutte_divergence_confidence, divergence_signal AS sutte_divergence_signal, interaction_score"""
TIMED = """tim AS (SELECT z.*, a.ts AS timestamp_start, b.ts AS timestamp_end FROM zone z
  JOIN feat a ON a.series_key = z.series_key AND a.rn = z.start_idx JOIN feat b ON b.series_key = z.series_key AND b.rn = z.end_idx)"""
LATEST_SQL = """lat AS (SELECT series_key, count(*) FILTER (WHERE a AND direction = 1) AS active_up_count,
  count(*) FILTER (WHERE a AND direction = -1) AS active_down_count, count(*) FILTER (WHERE direction = 1) AS raw_up_count,
  count(*) FILTER (WHERE direction = -1) AS raw_down_count, arg_max(direction, rn) FILTER (WHERE a) AS d,
  arg_max(probability, rn) FILTER (WHERE a) AS p, arg_max(ts, rn) FILTER (WHERE a) AS signal_ts,
  coalesce(arg_max(direction, rn) FILTER (WHERE direction <> 0), 0) AS latest_raw_direction,
  coalesce(arg_max(probability, rn) FILTER (WHERE direction <> 0), 0) AS latest_raw_probability,
  arg_max(ts, rn) FILTER (WHERE direction <> 0) AS latest_raw_ts
  FROM (SELECT *, direction <> 0 AND probability >= 0.55 AS a FROM sgn) GROUP BY series_key),
lts AS (SELECT *, CASE WHEN d IS NOT NULL THEN 'active' WHEN latest_raw_direction <> 0 THEN 'subthreshold' ELSE 'none' END AS visibility,
  coalesce(d, 0) AS direction, coalesce(p, 0) AS probability FROM lat)"""
SNAPSHOT = """sna AS (SELECT series_key, CASE WHEN z IS NULL THEN 'no' ELSE 'yes' END AS available, coalesce(z.duration, 0) AS duration,
  coalesce(n - z.end_idx - 1, 0) AS post_bars, coalesce(z.consolidation_score, 0) AS score,
  CASE WHEN z IS NULL THEN 'None' WHEN n - z.end_idx - 1 >= 8 THEN 'Developed' WHEN n - z.end_idx - 1 >= 4 THEN 'Forming'
    WHEN n - z.end_idx - 1 >= 1 THEN 'Early' ELSE 'Unconfirmed' END AS maturity
  FROM (SELECT series_key, max(n) AS n FROM feat GROUP BY 1) LEFT JOIN
    (SELECT series_key, arg_max(zone, end_idx) AS z FROM zone GROUP BY 1) USING (series_key))"""


def _zone(p: Params) -> str:
    return f"zone AS (SELECT {ZONE_COLUMNS} FROM com WHERE scored AND score > {p.threshold})"


def _plain_oracles(p: Params, chain: list[str]) -> dict[str, str]:
    """SQL of the queries of PLAIN for a setting; chain makes feat."""
    own, zone = [*chain, *sql.scored(p)], _zone(p)
    sig = [*own, *sql.breakouts(p)]
    sample = "dia AS (SELECT series_key, rn, score FROM com WHERE scored AND rn % greatest(1, n // 500) = 0)"
    levels = ", ".join(f"({x}::DOUBLE)" for x in sorted({p.threshold, 0.1, 0.2, 0.3, 0.4, 0.5}))
    weights = ", ".join(f"('{c}', {p.weight(c)}::DOUBLE)" for c in ("contraction", "position", "attention", "periodic", "scale", "sutte"))
    return {
        "score_components": sql.select(own, "com", [*KEYS, "lookback", "divergence_signal"], SCORES, "scored"),
        "zones": sql.select(
            [*own, zone], "zone", ["series_key", "start_idx", "end_idx", "duration", "sutte_divergence_signal"], ZONES
        ),
        "threshold_diagnosis": sql.select(
            [*own, sample, f"""out AS (SELECT series_key, level, count(*) FILTER (WHERE score > level) AS above, count(score) AS n,
  avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, quantile_cont(score, 0.25) AS p25,
  quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, max(score) AS max
  FROM dia CROSS JOIN (VALUES {levels}) AS l(level) GROUP BY ALL)"""],
            "out", ["series_key", "level", "above", "n"], ["mean", "std", "min", "p25", "p50", "p75", "max"],
        ),
        "auto_threshold": sql.select(
            [*own, sample, f"""out AS (SELECT series_key, greatest(0.10, least(0.50, {p.threshold}, quantile_cont(score, 0.7))) AS threshold
  FROM dia GROUP BY ALL)"""],
            "out", ["series_key"], ["threshold"],
        ),
        "zone_bars": sql.select(sig, "act", ["series_key", "rn", "zone_end", "direction"], ["probability"]),
        "breakout_signals": sql.select(sig, "sgn", [*KEYS, "direction"], ["probability"]),
        "heatmap": sql.select(
            [*own, zone, TIMED, """out AS (SELECT series_key, timestamp_end::DATE AS day, hour(timestamp_end) AS hour, count(*) AS zones,
  avg(consolidation_score) AS mean_score FROM tim GROUP BY ALL)"""],
            "out", ["series_key", "day", "hour", "zones"], ["mean_score"],
        ),
        "event_frame": sql.select([*own, zone, TIMED], "tim", ["series_key", "timestamp_end"], EVENT),
        "latest_signal": sql.select([*sig, LATEST_SQL], "lts", LATEST, ["probability", "latest_raw_probability"]),
        "zone_snapshot": sql.select(
            [*own, zone, SNAPSHOT], "sna", ["series_key", "available", "duration", "post_bars", "maturity"], ["score"]
        ),
        "component_table": sql.select(
            [*own, zone, f"wei(component, weight) AS (VALUES {weights})",
             """mea AS (UNPIVOT (SELECT series_key, avg(1 - least(volatility_ratio, 1)) AS contraction, avg(mean_reversion_strength) AS position,
  avg(attention_context_score) AS attention, avg(periodic_context_score) AS periodic, avg(scale_anchor_score) AS scale,
  avg(sutte_score) AS sutte FROM zone GROUP BY 1) ON contraction, position, attention, periodic, scale, sutte INTO NAME component VALUE mean)""",
             "out AS (SELECT *, mean * weight * 100 AS contribution FROM mea JOIN wei USING (component))"],
            "out", ["series_key", "component", "weight"], ["mean", "contribution"],
        ),
    }


USABLE = "use AS (SELECT probability AS p, (direction = target)::INT AS hit FROM tol WHERE direction <> 0 AND probability > 0 AND target IN (-1, 1))"
BINS = [
    USABLE,
    "edg AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7, 1]))) AS e FROM use)",
    """bin0 AS (SELECT least(len(list_filter(e, lambda x: x <= p)), len(e) - 1) AS bin, count(*) AS n, any_value(e) AS e, avg(p) AS mean_p,
  avg(hit) AS hit_rate, 0.35 * avg(p) + 0.65 * avg(hit) AS blended FROM use, edg GROUP BY 1)""",
    "bins AS (SELECT *, e[bin] AS low, e[bin + 1] AS high FROM bin0 WHERE bin > 0)",
]


def _fold_oracles(p: Params, bar: tuple) -> dict[str, str]:
    """SQL of the queries of FOLDED for a setting."""
    told = sql.fold_signals(p, *bar)
    return {
        "fold_signals": sql.select(
            told, "tol", ["origin", "fold::INT AS fold", "old_rn", "direction", "target", "fold_target"], ["probability", "up_probability"]
        ),
        "fold_metrics": sql.select(sql.fold_metrics(p, *bar), "fom", ["origin", "fold::INT AS fold", "labelled"], FOLD_METRICS),
        "calibration_bins": sql.select([*told, *BINS], "bins", ["bin", "n"], ["low", "high", "mean_p", "hit_rate", "blended"]),
    }


BRIEF_STATE = """CASE WHEN available = 'no' THEN 'No active setup' WHEN visibility = 'active' THEN CASE WHEN direction > 0 THEN 'Breaking up' ELSE 'Breaking down' END
    WHEN post_bars = 0 THEN 'Still consolidating' WHEN visibility = 'subthreshold' THEN 'Waiting for confirmation' ELSE 'Recent zone, no trigger' END AS setup_state,
  CASE WHEN available = 'no' THEN 'neutral' WHEN visibility = 'active' THEN CASE WHEN direction > 0 THEN 'support' ELSE 'risk' END
    WHEN post_bars = 0 OR visibility = 'subthreshold' THEN 'watch' ELSE 'neutral' END AS stance_tone,
  CASE WHEN available = 'no' THEN 'No zone' WHEN visibility = 'active' THEN 'Confirmed' WHEN post_bars = 0 THEN 'Inside zone'
    WHEN visibility = 'subthreshold' THEN 'Below trigger' ELSE 'No trigger' END AS trust_label,
  CASE WHEN available = 'no' THEN 'No' WHEN visibility = 'active' OR post_bars = 0 THEN 'Yes' ELSE 'Recent' END AS consolidation_answer,
  CASE WHEN available = 'no' THEN 'None' WHEN visibility = 'active' THEN CASE WHEN direction > 0 THEN 'Up' ELSE 'Down' END
    WHEN post_bars = 0 OR visibility = 'subthreshold' THEN CASE WHEN latest_raw_direction > 0 THEN 'Up lean' WHEN latest_raw_direction < 0 THEN 'Down lean'
      ELSE 'Undecided' END ELSE 'None' END AS breakout_side, maturity, post_bars"""


def _full_brief_oracle(signals: list[str]) -> str:
    """signals: steps that make com, thr, zone and sgn."""
    label = "CASE WHEN {} > 0 THEN 'up breakout' ELSE 'down breakout' END"
    parts = {
        "side": "CASE WHEN direction > 0 THEN 'up' ELSE 'down' END", "threshold": "'55%'", "label": label.format("direction"),
        "p": "printf('%.1f%%', probability * 100)", "time": "strftime(signal_ts, '%Y-%m-%d %H:%M')", "raw_label": label.format("latest_raw_direction"),
        "raw_p": "printf('%.1f%%', latest_raw_probability * 100)", "raw_time": "strftime(latest_raw_ts, '%Y-%m-%d %H:%M')",
    }

    def text(template: str) -> str:
        return "'" + template.format(**{k: f"' || {v} || '" for k, v in parts.items()}) + "'"

    def by_state(of: dict, quiet: str) -> str:
        return f"""CASE WHEN available = 'no' THEN {text(of["none"])} WHEN visibility = 'active' THEN {text(of["active"])}
    WHEN post_bars = 0 AND latest_raw_direction <> 0 THEN {text(of["inside"])} WHEN post_bars = 0 THEN {text(of[quiet])}
    WHEN visibility = 'subthreshold' THEN {text(of["below"])} ELSE {text(of["quiet"])} END"""

    lean = "latest_raw_direction <> 0 AND (post_bars = 0 OR visibility = 'subthreshold')"
    steps = [
        *signals, LATEST_SQL, SNAPSHOT,
        f"""gai AS (SELECT series_key, coalesce(avg(gain) / (stddev_samp(gain) + 1e-10) * sqrt(252), 0) AS sharpe FROM (SELECT *,
  direction * (lead(close, 10) {sql.ROW} / nullif(close, 0) - 1) AS gain FROM sgn) GROUP BY 1)""",
        """win AS (SELECT z.series_key, strftime(a.ts, '%Y-%m-%d %H:%M') || ' to ' || strftime(b.ts, '%Y-%m-%d %H:%M') AS span
  FROM (SELECT series_key, max(end_idx) AS end_idx, arg_max(start_idx, end_idx) AS start_idx FROM zone GROUP BY 1) z
  JOIN feat a ON a.series_key = z.series_key AND a.rn = start_idx JOIN feat b ON b.series_key = z.series_key AND b.rn = end_idx)""",
    ]
    none = "CASE WHEN available = 'no' THEN 'n/a'"
    return "WITH " + ",\n".join(steps) + f""" SELECT series_key, {BRIEF_STATE},
  {by_state(report.HEADLINES, "inside")} AS headline, {by_state(report.SUMMARIES, "inside_quiet")} AS summary,
  {none} WHEN visibility = 'active' THEN {parts["p"]} WHEN {lean} THEN {parts["raw_p"]} || ' raw' ELSE 'n/a' END AS confidence_label,
  {none} WHEN visibility = 'active' THEN {parts["time"]} WHEN {lean} THEN {parts["raw_time"]} ELSE 'n/a' END AS latest_signal_time,
  {none} ELSE printf('%.3f', score) END AS zone_score, {none} ELSE duration || ' bars' END AS zone_duration,
  {none} ELSE post_bars::VARCHAR END AS post_zone_bars, active_up_count || ' / ' || active_down_count AS active_breakout_mix,
  raw_up_count || ' / ' || raw_down_count AS raw_breakout_mix, '55%' AS display_threshold,
  printf('%.2f', coalesce(sharpe, 0)) AS simulated_sharpe, 'Unavailable' AS benchmark_verdict,
  coalesce(span, 'No completed accepted window') AS latest_zone_window
  FROM lts JOIN sna USING (series_key) LEFT JOIN gai USING (series_key) LEFT JOIN win USING (series_key)"""


def _calibrated_oracle(p: Params, bar: tuple) -> str:
    """The whole series' signals mapped by the curve through the bins of the folds' signals.

    A running maximum makes the curve rise; it begins at (0, 0) and stays level up to 1; points at one place are one.
    """
    chain = sql.features(*bar, everything=False)
    steps = [
        *sql.fold_signals(p, *bar),
        *BINS,
        """cur0 AS (SELECT max(least(greatest(mean_p, 0), 1)) OVER w AS x, max(least(greatest(blended, 0), 1)) OVER w AS y FROM bins
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        """cur1 AS (SELECT x, max(y) AS y FROM (SELECT * FROM cur0 UNION ALL SELECT 0, 0 FROM cur0 HAVING min(x) > 0
  UNION ALL SELECT 1, max(y) FROM cur0 HAVING max(x) < 1) GROUP BY x)""",
        "cur AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM cur1)",
    ]
    fitted = "WITH " + ",\n".join(steps) + "\nSELECT * FROM cur"
    whole = [*chain, *sql.scored(p), *sql.breakouts(p)]
    mapped = f"""cal0 AS ({fitted}),
cal AS (SELECT s.*, CASE WHEN s.probability > 0 THEN coalesce(c.y + (s.probability - c.x) * (c.y2 - c.y) / (c.x2 - c.x), s.probability)
  ELSE s.probability END AS q FROM sgn s LEFT JOIN cal0 c ON s.probability > c.x AND s.probability <= c.x2),
out AS (SELECT series_key, ts, rn, CASE WHEN q > 0.5 THEN direction ELSE 0 END AS direction, q AS probability FROM cal)"""
    return sql.select([*whole, mapped], "out", [*KEYS, "direction"], ["probability"])


def _trial_steps() -> list[str]:
    """tri: (trial, origin, fold, ...) of every trial, each by the SQL of one setting."""
    each = []
    for i, p in enumerate(trial_settings()):
        steps = ",\n".join(sql.fold_metrics(p, *TRIED))
        each.append(f"tri{i} AS MATERIALIZED (WITH {steps} SELECT {i} AS trial, * FROM fom)")
    return [*each, "tri AS (" + " UNION ALL ".join(f"SELECT * FROM tri{i}" for i in range(len(each))) + ")"]


def _trial_oracles() -> dict[str, str]:
    steps = _trial_steps()
    valued = f"""val AS (SELECT trial, coalesce(avg(v), -1)::DOUBLE AS objective FROM range({TRIALS}) AS r(trial) LEFT JOIN (SELECT trial, origin,
  CASE WHEN count(*) >= 2 AND avg(coverage) > 1e-10 THEN -avg(brier) ELSE -1 END AS v FROM tri GROUP BY ALL) USING (trial) GROUP BY trial)"""
    names = list(asdict(PARAMS))
    rows = ", ".join(f"({i}, {', '.join(f'{float(v)!r}::DOUBLE' for v in asdict(p).values())})" for i, p in enumerate(trial_settings()))
    told = f"""par(trial, {", ".join(names)}) AS (VALUES {rows}),
imp AS (UNPIVOT (SELECT {", ".join(f"coalesce(CASE WHEN isfinite(corr({c}, objective)) THEN abs(corr({c}, objective)) END, 0) AS {c}" for c in names)}
  FROM par JOIN val USING (trial)) ON {", ".join(names)} INTO NAME parameter VALUE importance)"""
    return {
        "trial_metrics": sql.select(steps, "tri", ["trial", "origin", "fold::INT AS fold", "labelled"], FOLD_METRICS),
        "trial_objectives": sql.select([*steps, valued], "val", ["trial::INT AS trial"], ["objective"]),
        "importance": sql.select([*steps, valued, told], "imp", ["parameter"], ["importance"]),
    }


def _oracles() -> dict[str, str]:
    p, full = PARAMS, sql.features()
    few = sql.features(everything=False)
    typed = sql.features(*BY_TYPE, everything=False)
    moving = sql.features(*MOVING, everything=False)

    def geometry(*args) -> list[str]:
        return [*sql.bars(*args), *sql.GEOMETRY]

    out = {
        "ohlc_bars": "WITH " + sql.bars(*BY_TYPE)[0] + " SELECT * FROM bars",
        "price_geometry": sql.select(geometry(), "geo", KEYS, GEOMETRY),
        "price_geometry_by_type": sql.select(geometry(*BY_TYPE), "geo", KEYS, GEOMETRY),
        "temporal_phase": sql.select([*geometry(), *sql.PHASE], "pha", KEYS, PHASE),
        "sutte": sql.select(full, "feat", KEYS, [*SUTTE, "sutte_direction"]),
        "sutte_adaptive": sql.select([*full, *sql.ADAPTIVE], "ada", KEYS, ADAPTIVE),
        "compression_signature": sql.select([*few, sql.SIGNATURE], "sig", KEYS, ["signature"]),
        "position_std": sql.select(
            [*geometry(), *sql.position(p, "geo"), "out AS (SELECT geo.*, coalesce(dev, 1) AS pos_std FROM geo LEFT JOIN pos USING (series_key, rn))"],
            "out", KEYS, ["pos_std"], f"rn >= {p.min_bars}",
        ),
        "sutte_score": sql.select(
            [*few, *sql.sutte_score(p), "out AS (SELECT feat.*, sutte_raw FROM feat JOIN sco USING (series_key, rn))"],
            "out", KEYS, ["sutte_raw"], "rn > 0",
        ),
        "context_scores": sql.select([*few, *sql.scored(p)], "com", ["series_key", "rn"], ["attention_raw", "periodic_raw"], "rn > 0"),
    }
    for name, columns in (
        ("rolling_envelope", _each(["high", "low", "range_width", "range_width_pct"])),
        ("vol_ratio", _each(["vol_ratio"])),
        ("realized_vol", ["log_return", *_each(["realized_vol"])]),
        ("roc_momentum", _each(["roc", "momentum"], MAIN)),
        ("rsi", _each(["rsi"], MAIN)),
        ("trend_strength", _each(["trend_strength"], MAIN)),
        ("hurst", _each(["hurst"], MEDIUM)),
    ):
        out[name] = sql.select(full, "feat", KEYS, columns)
    out["price_position"] = sql.select(sql.features(*BY_TYPE), "feat", KEYS, _each(["price_position"]))
    z = ", ".join(
        f"(close - ({sql.roll('avg', 'close', q)})) / nullif(({sql.roll('stddev_samp', 'close', q)}), 0) AS zscore_{q}" for q in MEDIUM
    )
    out["zscore"] = sql.select([*geometry(), f"out AS (SELECT *, {z} FROM geo)"], "out", KEYS, _each(["zscore"], MEDIUM))
    out["atr"] = sql.select(
        [*geometry(), f"out AS (SELECT *, {sql.roll('avg', 'hl_range', 20, 5)} AS atr_20 FROM geo)"], "out", KEYS, ["atr_20"]
    )
    core = ["past_range", "past_range_pct", "past_vol", "vol_contraction", "c_contraction", "c_range"]
    out["window_core"] = sql.select([*geometry(), *sql.core(p, "geo")], "cor", [*KEYS, "lookback"], core, "scored")
    out["window_core_by_type"] = sql.select(
        [*geometry(*BY_TYPE), *sql.core(p, "geo")], "cor", [*KEYS, "lookback"],
        ["past_range_pct", "vol_contraction", "c_contraction", "c_range"], "scored",
    )
    out["cv_splits"] = (
        "WITH " + ",\n".join([*sql.bars(*BY_TYPE), "whole AS (SELECT * FROM num)", *sql.folds(p)])
        + """ SELECT origin AS series_key, fold::INT AS fold, min(old_rn) AS train_start, min(old_rn) FILTER (WHERE validation) AS validation_start,
  max(old_rn) + 1 AS validation_end, count(*) AS bars, max(rn) AS last_rn FROM feat GROUP BY ALL"""
    )
    out["direction_targets"] = sql.select(
        [*sql.bars(), f"out AS (SELECT *, lead(close, {p.max_hold}) {sql.ROW} / close - 1 AS future_return FROM num)"],
        "out", [*KEYS, "sign(future_return)::INT AS target"], ["future_return"],
    )
    quarter = sql.features("15 minutes", "event_type", everything=False)
    windows = [*KEYS, "lookback", "divergence_signal"]
    out["scored_windows"] = sql.select([*few, *sql.scored(p)], "com", windows, SCORES, "scored")
    out["scored_windows_by_type"] = sql.select([*quarter, *sql.scored(p)], "com", windows, SCORES, "scored")
    out["live_window"] = sql.select(
        [*typed, *sql.scored(p, gate=False)], "com", [*KEYS, "divergence_signal"], ["scale_raw", "score"], "scored AND rn = n - 1"
    )
    out |= _plain_oracles(ACTIVE, moving) | _fold_oracles(ACTIVE, MOVING)
    out |= {f"{name}_anchored": text for name, text in _plain_oracles(PARAMS, few).items()}
    out |= {f"{name}_anchored": text for name, text in _fold_oracles(ACTIVE, HOURLY).items()}
    out["calibrated_signals"] = _calibrated_oracle(ACTIVE, MOVING)
    out["streamed_bars"] = (
        "WITH " + sql.bars(*BY_TYPE)[0] + f""" SELECT * FROM bars
  WHERE ts + INTERVAL '{BY_TYPE[0]}' <= (SELECT max(ts) FROM events) - INTERVAL '{DELAY}'"""
    )
    out["csv_bars"] = "WITH " + sql.bars()[0] + " SELECT series_key, ts, open, high, low, close FROM bars"
    by_type = "WITH " + ", ".join(sql.bars(*BY_TYPE))
    out["growing_bars"] = f"{by_type} SELECT series_key, ts, open, high, low, close, rn, n FROM num"
    out["growing_unusable"] = f"""{by_type}, bad AS (SELECT series_key, strftime(ts, '%Y:%m:%d-%H:%M:%S') AS given,
  CASE hour(ts) WHEN 0 THEN 'number' WHEN 1 THEN 'time' ELSE 'late' END AS reason FROM num
  WHERE hour(ts) < 2 OR (hour(ts) = 2 AND rn * {PARTS} // n < {PARTS - 1}))
SELECT series_key, reason, CASE WHEN reason <> 'time' THEN given END AS given_time, count(*) AS n FROM bad GROUP BY ALL"""
    out["all_features"] = sql.select(
        [*sql.features(*BY_TYPE), *sql.ADAPTIVE, f"out AS (SELECT *, {z} FROM ada)"], "out", KEYS, FEATURES, "hl_range_pct IS NOT NULL"
    )
    own = [*moving, *sql.scored(ACTIVE), _zone(ACTIVE)]
    sig = [*own, *sql.breakouts(ACTIVE)]
    out["recent_zones"] = sql.select(
        [*own, TIMED, f"""out AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY end_idx DESC) AS k FROM tim
  WHERE timestamp_end >= TIMESTAMP '{SINCE}')"""],
        "out", ["series_key", "start_idx", "end_idx", "timestamp_start", "timestamp_end"], ["consolidation_score"], f"k <= {RECENT}",
    )
    out["follow_through"] = sql.select(
        [*sig, "las AS (SELECT series_key, arg_max(zone, end_idx) AS z FROM zone GROUP BY 1)",
         """nea AS (SELECT s.*, z, f.high, f.low FROM sgn s JOIN feat f USING (series_key, rn) JOIN las USING (series_key)
  WHERE s.close > 0 AND s.rn BETWEEN z.start_idx - z.duration AND z.end_idx + 60)""",
         """out AS (SELECT *, CASE WHEN rn > z.end_idx THEN 'after' ELSE 'history' END AS part,
  max(high) FILTER (WHERE rn BETWEEN z.start_idx AND z.end_idx) OVER (PARTITION BY series_key) AS resistance,
  min(low) FILTER (WHERE rn BETWEEN z.start_idx AND z.end_idx) OVER (PARTITION BY series_key) AS support,
  rn > z.end_idx AND probability >= 0.55 AND direction <> 0 AS shown FROM nea)""",
         """ou2 AS (SELECT *, (resistance + support) / 2 AS midline, CASE WHEN shown THEN direction END AS marker,
  CASE WHEN shown THEN probability END AS marker_probability FROM out)"""],
        "ou2", [*KEYS, "part", "marker"], ["close", "resistance", "support", "midline", "marker_probability"],
    )
    out["brief"] = (
        "WITH " + ",\n".join([*sig, LATEST_SQL, SNAPSHOT])
        + f""" SELECT series_key, {BRIEF_STATE}
  FROM lts JOIN sna USING (series_key)"""
    )
    by_class = """fsc0 AS (SELECT origin, fold, c, count(*) FILTER (WHERE fold_target = c) AS n,
  count(*) FILTER (WHERE direction = c) AS said, count(*) FILTER (WHERE direction = c AND fold_target = c) AS hit
  FROM tol CROSS JOIN (VALUES (1), (-1)) AS k(c) WHERE fold_target IN (-1, 1) GROUP BY ALL),
fsc1 AS (SELECT origin, fold, sum(n * coalesce(2 * hit / nullif(said + n, 0), 0)) / sum(n) AS f1,
  sum(n * coalesce(hit / nullif(said, 0), 0)) / sum(n) AS precision, sum(hit) / sum(n) AS recall FROM fsc0 GROUP BY ALL HAVING sum(said) > 0),
fsc2 AS (SELECT origin, fold, coalesce(avg(direction * future_return) / (stddev_samp(direction * future_return) + 1e-10) * sqrt(252), 0) AS sharpe
  FROM tol WHERE fold_target IN (-1, 1) GROUP BY ALL),
scf AS (SELECT * FROM fsc1 JOIN fsc2 USING (origin, fold))"""
    out["fold_scores"] = sql.select(
        [*sql.fold_signals(ACTIVE, *MOVING), by_class],
        "scf", ["origin", "fold::INT AS fold"], ["f1", "precision", "recall", "sharpe"],
    )
    out["model_result"] = sql.select(
        [*sql.fold_signals(ACTIVE, *MOVING),
         """out AS (SELECT count(*) AS model_sample_count, avg((direction <> 0)::INT) AS model_coverage,
  avg((direction = fold_target)::INT) FILTER (WHERE direction <> 0) AS model_answered_accuracy,
  avg((up_probability - (fold_target = 1)::INT) ** 2) AS model_brier FROM tol WHERE fold_target IN (-1, 1))"""],
        "out", [], [f"model_{x}" for x in ("sample_count", "coverage", "answered_accuracy", "brier")],
    )
    out["latest_breakout"] = sql.select([*own, sql.latest_breakout(ACTIVE)], "out", ["series_key", "rn", "zone_end", "direction"], ["probability"])
    out["bar_spacing"] = sql.select(
        [*sql.bars(*BY_TYPE), f"gap AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) {sql.ROW})) / 1000 AS gap FROM num)",
         "out AS (SELECT series_key, quantile_cont(gap, 0.5) * 0.8 AS bar_width_ms FROM gap GROUP BY 1)"],
        "out", ["series_key"], ["bar_width_ms"],
    )
    out["plot_window"] = (
        "WITH " + ",\n".join(sql.bars(*BY_TYPE))
        + " SELECT series_key, ts, rn, close FROM (SELECT *, max(ts) OVER (PARTITION BY series_key) AS last FROM num) WHERE ts >= last - INTERVAL 7 DAYS"
    )
    out |= _trial_oracles()
    strict = [*moving, *sql.scored(STRICT), sql.thresholds(STRICT), f"zone AS (SELECT {ZONE_COLUMNS} FROM com JOIN thr USING (series_key) WHERE scored AND score > threshold)"]
    out["thresholds"] = sql.select(
        [*strict, """out AS (SELECT series_key, threshold, count(*) FILTER (WHERE scored AND score > threshold) AS zones,
  count(*) FILTER (WHERE scored) AS windows FROM com JOIN thr USING (series_key) GROUP BY ALL)"""],
        "out", ["series_key", "zones", "windows"], ["threshold"],
    )
    out["redetected_zones"] = sql.select(
        strict, "zone", ["series_key", "start_idx", "end_idx", "duration", "sutte_divergence_signal"], ZONES
    )
    zoned = sql.breakouts(STRICT)
    zoned[0] = "zon AS (SELECT com.* FROM com JOIN thr USING (series_key) WHERE scored AND score > threshold)"
    out["redetected_signals"] = sql.select([*strict, *zoned], "sgn", [*KEYS, "direction"], ["probability"])
    out["plot_points"] = sql.select(
        [*moving, *sql.scored(ACTIVE),
         f"""lin AS (SELECT *, floor(rn * {PIXELS} / n)::INT AS pixel FROM (SELECT series_key, rn, n, ts, 'close' AS line, close AS value FROM com
  UNION ALL SELECT series_key, rn, n, ts, 'score', score FROM com WHERE scored) WHERE value IS NOT NULL)""",
         """pts AS (SELECT *, rn = min(rn) OVER p OR rn = max(rn) OVER p OR row_number() OVER (PARTITION BY series_key, line, pixel ORDER BY value, rn) = 1
  OR row_number() OVER (PARTITION BY series_key, line, pixel ORDER BY value DESC, rn) = 1 AS kept FROM lin
  WINDOW p AS (PARTITION BY series_key, line, pixel))"""],
        "pts", [*KEYS, "line", "pixel"], ["value"], "kept",
    )
    out["full_brief"] = _full_brief_oracle([*strict, *zoned])
    closed = sql.features(*BY_TYPE, everything=False)
    closed[0] = closed[0].removesuffix(")") + f""" HAVING time_bucket(INTERVAL '{BY_TYPE[0]}', ts) + INTERVAL '{BY_TYPE[0]}' <= (SELECT max(ts) FROM events) - INTERVAL '{DELAY}')"""
    out["streamed_signals"] = sql.select(
        [*closed, *sql.scored(ACTIVE, gate=False), sql.live_breakouts(ACTIVE),
         "liv AS (SELECT c.* EXCLUDE (score), CASE WHEN scored THEN score END AS score, zone_end, probability, o.direction FROM com c JOIN out o USING (series_key, rn))"],
        "liv", [*KEYS, "divergence_signal", "zone_end", "direction"], ["score", "probability"],
    )
    ret = f"ret AS (SELECT *, close / nullif(lag(close) {sql.ROW}, 0) - 1 AS r, n - 1 - rn AS age FROM num)"
    reg = """reg0 AS (SELECT series_key, stddev_pop(r) FILTER (WHERE age < 20) AS regime_recent_vol, stddev_pop(r) AS regime_baseline_vol,
  sqrt(sum(exp(-ln(2) * age / 20) * r * r) FILTER (WHERE age < 20) / sum(exp(-ln(2) * age / 20)) FILTER (WHERE age < 20)) AS regime_recent_ewm_vol,
  sqrt(sum(exp(-ln(2) * age / 20) * r * r) / sum(exp(-ln(2) * age / 20))) AS regime_baseline_ewm_vol
  FROM ret WHERE r IS NOT NULL AND age < 80 GROUP BY 1),
reg1 AS (SELECT *, regime_recent_vol / (regime_baseline_vol + 1e-10) AS regime_vol_ratio,
  regime_recent_ewm_vol / (regime_baseline_ewm_vol + 1e-10) AS regime_ewm_vol_ratio FROM reg0),
reg2 AS (SELECT *, (regime_vol_ratio >= 1.5 OR regime_vol_ratio <= 0.67 OR regime_ewm_vol_ratio >= 1.5 OR regime_ewm_vol_ratio <= 0.67)::INT::DOUBLE
  AS regime_shift_flag FROM reg1),
reg AS (UNPIVOT reg2 ON COLUMNS(* EXCLUDE (series_key)) INTO NAME metric VALUE value)"""
    out["regime"] = sql.select([*sql.bars(*BY_TYPE), ret, reg], "reg", ["series_key", "metric"], ["value"])
    names = ", ".join(metrics.INSTABILITY)

    def unsteady(source: str) -> str:
        frame = "OVER (PARTITION BY series_key, col ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
        return f"""ins0 AS (SELECT series_key, rn, col, v FROM (SELECT series_key, rn, {names} FROM {source}) UNPIVOT (v FOR col IN ({names}))),
ins1 AS (SELECT series_key, rn, col, CASE WHEN count(v) {frame} >= 5 THEN stddev_samp(v) {frame} END AS d FROM ins0),
ins2 AS (SELECT *, row_number() OVER (PARTITION BY series_key, col ORDER BY rn DESC) AS k FROM ins1 WHERE d IS NOT NULL),
ins AS (SELECT series_key, col || '_instability' AS metric, avg(d) AS value FROM ins2 WHERE k <= 20 GROUP BY ALL)"""

    out["feature_instability"] = sql.select(
        [*sql.features(*BY_TYPE), unsteady("feat")], "ins", ["series_key", "metric"], ["value"]
    )
    # The features of the metrics are more than those that scores need: both chains make bars, so one is renamed.
    long = sql.features(*MOVING)
    long[-1] = long[-1].replace("feat AS", "wide AS", 1)
    steady = "WITH " + ",\n".join([*long, unsteady("wide")]) + "\nSELECT * FROM ins"
    zoned = ", ".join(
        f"coalesce(avg({c}), 0) AS {n}" for n, c in (
            ("mean_consolidation_score", "consolidation_score"), ("mean_attention_context_score", "attention_context_score"),
            ("mean_periodic_context_score", "periodic_context_score"), ("mean_scale_anchor_score", "scale_anchor_score"),
            ("mean_sutte_score", "sutte_score"), ("mean_interaction_score", "interaction_score"),
            ("mean_sutte_divergence_confidence", "sutte_divergence_confidence"),
        )
    )
    run = f"""met0 AS (SELECT series_key, count(consolidation_score)::DOUBLE AS total_consolidations, {zoned}
  FROM (SELECT DISTINCT series_key FROM feat) LEFT JOIN zone USING (series_key) GROUP BY 1),
met1 AS (SELECT *, direction * (lead(close, 10) {sql.ROW} / nullif(close, 0) - 1) AS gain, CASE WHEN probability > 0 THEN probability END AS pos FROM sgn),
met2 AS (SELECT series_key, count(*) FILTER (WHERE direction <> 0)::DOUBLE AS breakout_signals,
  count(*) FILTER (WHERE probability > 0.7)::DOUBLE AS high_prob_signals, count(*) FILTER (WHERE direction = 1)::DOUBLE AS up_breakout_signals,
  count(*) FILTER (WHERE direction = -1)::DOUBLE AS down_breakout_signals, count(*) FILTER (WHERE direction = 0)::DOUBLE AS neutral_signal_bars,
  coalesce(sum(direction) / nullif(count(*) FILTER (WHERE direction <> 0), 0), 0)::DOUBLE AS signal_bias, coalesce(avg(pos), 0) AS mean_probability,
  coalesce(stddev_samp(pos), 0) AS prob_std, coalesce(max(pos), 0) AS max_probability, coalesce(min(pos), 0) AS min_probability,
  avg(gain) AS simulated_mean_return, stddev_samp(gain) AS simulated_std_return,
  coalesce(avg(gain) / (stddev_samp(gain) + 1e-10) * sqrt(252), 0) AS simulated_sharpe, coalesce(avg((gain > 0)::INT), 0) AS simulated_win_rate,
  product(1 + gain) - 1 AS simulated_total_return FROM met1 GROUP BY 1),
met AS (SELECT series_key, metric, value FROM met0 UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (series_key))))),
mes AS (SELECT series_key, metric, value FROM met2 UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (series_key))))),
mei AS ({steady}),
mea AS (SELECT * FROM met UNION ALL SELECT * FROM mes UNION ALL SELECT * FROM reg UNION ALL SELECT * FROM mei)"""
    out["run_metrics"] = sql.select([*sig, ret, reg, run], "mea", ["series_key", "metric"], ["value"])
    return out


ORACLES = _oracles()
