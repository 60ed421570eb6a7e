"""Every registered query against its SQL oracle, or, without one, that it runs over its tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.compare import SF_DIR, SMOKE_DIR, assert_same
from tidemark.operators import breakout, calibration, detector, report
from tidemark.plans import queries
from tidemark.plans.params import CALIBRATION_BINS, CALIBRATION_MIN_SAMPLES, COMPONENTS
from tidemark.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    sf_dir = SMOKE_DIR if name.endswith("_anchored") else SF_DIR
    assert assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


@pytest.fixture(scope="module")
def scored(spark):
    return queries.scored(spark, SF_DIR, queries.ACTIVE, queries.MOVING).persist()


def test_the_tables_ask_something_of_every_step(spark, scored):
    """Windows are accepted and rejected, bars break out both ways and calibration has samples in every bin."""
    windows = scored.where("scored")
    above = windows.where(F.col("score") > queries.ACTIVE.threshold).count()
    assert 0.2 < above / windows.count() < 0.8
    told = queries.fold_told(spark, SF_DIR).persist()
    for direction in (-1, 0, 1):
        assert told.where(f"direction = {direction}").count() >= 100
    usable = calibration.usable(told).persist()
    assert usable.count() >= 4 * CALIBRATION_MIN_SAMPLES
    assert {r["hit"] for r in usable.select("hit").distinct().collect()} == {0.0, 1.0}
    # Some probabilities are exactly 1, so the last edges may be one.
    edges = {round(x, 9) for x in usable.agg(F.percentile("p", F.array(*[F.lit(i / CALIBRATION_BINS) for i in range(CALIBRATION_BINS + 1)]))).first()[0]}
    assert calibration.bins(usable).where("n > 0").count() == len(edges) - 1 >= 5
    told.unpersist()
    usable.unpersist()
    plain = QUERIES["breakout_signals"](spark, SF_DIR)
    mapped = QUERIES["calibrated_signals"](spark, SF_DIR).withColumnRenamed("probability", "q")
    moved = plain.join(mapped, ["series_key", "rn"]).where("probability > 0 AND abs(probability - q) > 1e-3")
    assert moved.count() > 100


def test_every_component_has_many_values(scored):
    """No component is a constant or its fallback; every label of the divergence occurs."""
    windows = scored.where("scored")
    told = windows.select(*[F.count_distinct(F.round(f"c_{c}", 6)).alias(c) for c in COMPONENTS]).first()
    assert all(told[c] > 50 for c in COMPONENTS), told
    assert windows.where("sutte_raw <> 0.5").count() > 2_000
    labels = {r["divergence_signal"]: r["count"] for r in windows.groupBy("divergence_signal").count().collect()}
    assert set(labels) == {"NEUTRAL", "TRUST", "FADE"} and min(labels.values()) > 100


def test_breakouts_are_told_with_and_against_the_candles(scored):
    """Zones of all three labels give probabilities, so the shape of a zone moves them both ways."""
    labels = scored.select("series_key", (F.col("rn") - 1).alias("zone_end"), "divergence_signal", "divergence")
    told = breakout.zone_bars(scored, queries.ACTIVE).where("probability IS NOT NULL").join(labels, ["series_key", "zone_end"])
    counts = {r["divergence_signal"]: r["count"] for r in told.groupBy("divergence_signal").count().collect()}
    assert set(counts) == {"NEUTRAL", "TRUST", "FADE"} and min(counts.values()) > 50
    assert told.where("divergence = direction").count() > 50 and told.where("divergence = -direction").count() > 50


def test_some_series_are_detected_again(spark):
    told = {r["series_key"]: r for r in QUERIES["thresholds"](spark, SF_DIR).collect()}
    lowered = [r for r in told.values() if r["threshold"] < queries.STRICT.threshold]
    assert lowered and len(lowered) < len(told) and all(r["zones"] > 0 for r in told.values())


def test_trials_answer_and_differ(spark):
    told = [r["objective"] for r in QUERIES["trial_objectives"](spark, SF_DIR).collect()]
    assert len(told) == queries.TRIALS and sum(v > -1 for v in told) * 2 >= len(told) and len(set(told)) > len(told) / 2
    strength = {r["parameter"]: r["importance"] for r in QUERIES["importance"](spark, SF_DIR).collect()}
    assert len(strength) == 18 and all(0 < v <= 1 for v in strength.values())


def test_labels_of_the_other_naming(spark):
    """The earlier names of the labels stand for the same windows."""
    made = queries.context_of(spark, SF_DIR, *queries.MOVING, queries.ACTIVE)
    old = detector.score_windows(made, queries.ACTIVE, labels="aligned_divergent").select("series_key", "rn", F.col("divergence_signal").alias("old"))
    new = detector.score_windows(made, queries.ACTIVE).select("series_key", "rn", "divergence_signal")
    pairs = {tuple(r) for r in new.join(old, ["series_key", "rn"]).select("divergence_signal", "old").distinct().collect()}
    assert pairs == {("NEUTRAL", "NEUTRAL"), ("TRUST", "ALIGNED"), ("FADE", "DIVERGENT")}


def test_the_wide_heatmap_is_the_heatmap(spark):
    timed = queries.timed(spark, SMOKE_DIR, queries.ACTIVE, queries.MOVING).persist()
    long = {(r["series_key"], r["day"], r["hour"]): r["mean_score"] for r in report.heatmap(timed).collect()}
    wide = report.heatmap_wide(timed)
    assert wide.columns == ["series_key", "day", *map(str, range(24))]
    cells = {(r["series_key"], r["day"], h): r[str(h)] for r in wide.collect() for h in range(24) if r[str(h)] is not None}
    assert cells == long and cells
    timed.unpersist()
