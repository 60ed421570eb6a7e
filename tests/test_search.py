"""Trials as rows equal trials one by one; the model-based search finds more than chance; importance over its trials."""

from __future__ import annotations

import random
from dataclasses import asdict, replace
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR
from tidemark.operators import search as tuning
from tidemark.operators import validation
from tidemark.plans import queries
from tidemark.plans.params import SEARCH, Params
from tidemark.sources.bars import owned


@pytest.fixture(scope="module")
def made(spark):
    return owned(queries.context_of(spark, SMOKE_DIR, "2 hours", None, queries.WIDEST)).persist()


@pytest.fixture(scope="module")
def settings():
    return queries.trial_settings()


def shown(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_trials_as_rows_equal_one_by_one(made, settings):
    """Different lengths of every frame in one job: each trial's signals are those of its setting alone."""
    some = [replace(settings[0], lookback=5, max_hold=30), settings[1], replace(settings[2], lookback=50, max_hold=5, min_bars=3)]
    columns = ["fold", "old_rn", "probability", "direction", "target", "fold_target", "future_return"]
    together = tuning.trial_signals(made, some).persist()
    for i, p in enumerate(some):
        alone = validation.fold_signals(made, p)
        assert shown(together.where(f"trial = {i}").select(columns).collect()) == shown(alone.select(columns).collect())
    together.unpersist()


@pytest.mark.parametrize("kind", ["brier", "blended"])
def test_a_hundred_trials_are_one_job(spark, made, kind):
    rng = random.Random(1)
    many = [tuning.setting(tuning.draw(rng)) for _ in range(100)]
    found = tuning.valued(made, many, kind=kind)
    for i in (0, 17, 99):
        told = validation.fold_signals(made, many[i])
        rows = (validation.fold_metrics if kind == "brier" else validation.fold_scores)(told).collect()
        expected = validation.objective([r.asDict() for r in rows], kind)
        assert found[i] == pytest.approx(expected, abs=1e-9)
    assert len(set(found)) > 1


def bowl(settings):
    """An objective that differs everywhere: how near a setting is to one place."""
    best = Params(lookback=33, max_hold=8, threshold=0.2, steepness=4.0, range_threshold=2.5)
    out = []
    for p in settings:
        gaps = [(getattr(p, k) - getattr(best, k)) / (SEARCH[k][1] - SEARCH[k][0]) for k in ("lookback", "max_hold", "threshold", "steepness", "range_threshold")]
        out.append(-sum(g * g for g in gaps))
    return out


def test_the_model_beats_chance_and_repeats_itself():
    def best(method, seed):
        return max(v for _, v in tuning.search(None, 60, seed=seed, method=method, evaluate=bowl)[1])

    assert median(best("parzen", s) for s in range(15)) > median(best("random", s) for s in range(15))
    later = [v for _, v in tuning.search(None, 60, seed=3, evaluate=bowl)[1][tuning.STARTUP :]]
    first = [v for _, v in tuning.search(None, 60, seed=3, method="random", evaluate=bowl)[1]]
    assert median(later) > median(first)
    assert tuning.search(None, 25, seed=3, evaluate=bowl) == tuning.search(None, 25, seed=3, evaluate=bowl)
    for p, _ in tuning.search(None, 60, seed=5, evaluate=bowl)[1]:
        assert all(SEARCH[k][0] <= getattr(p, k) <= SEARCH[k][1] for k in SEARCH if k != "weight")
        assert sum(p.weight(c) for c in queries.COMPONENTS) == pytest.approx(1)


def test_a_density_integrates_to_one():
    for name, values in (("threshold", [0.1, 0.11, 0.4]), ("weight_hurst", []), ("steepness", [1.0, 5.0, 5.0])):
        parzen = tuning.Parzen(name, values)
        grid = np.linspace(parzen.low, parzen.high, 20_001)
        assert np.trapezoid([parzen.density(x) for x in grid], grid) == pytest.approx(1, abs=1e-3)


def test_importance_of_constant_columns_is_zero(spark):
    rows = [(1.0, 5.0, float(i), -0.2 - 0.01 * i) for i in range(12)]
    trials = spark.createDataFrame(rows, "a double, b double, c double, objective double")
    got = {r["parameter"]: r["importance"] for r in validation.importance(trials, ["a", "b", "c"]).collect()}
    assert got == {"a": 0, "b": 0, "c": pytest.approx(1)}
    flat = validation.importance(trials.withColumn("objective", F.lit(-1.0)), ["a", "c"]).collect()
    assert [r["importance"] for r in flat] == [0, 0]


def test_given_weights_leave_out_the_candle_weight():
    p = validation.with_weights(Params(), contraction=0.5, range=0.25)
    assert p.weight_sutte == 0 and sum(asdict(p)[f"weight_{c}"] for c in queries.COMPONENTS) == pytest.approx(1)
    assert p.weight_contraction == 2 * p.weight_range
    assert validation.with_weights(Params(), sutte=0.125) == Params().normalised()
