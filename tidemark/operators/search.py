"""Parameter search: settings as rows, so that any number of trials is one job, and what to try next.

A trial is a copy of every series whose rows carry the setting in columns.  Frames
whose length is a setting are ranges over row numbers measured in that length
(functions/frames.py), so detector, predictor, folds and metrics are the operators
that serve one setting, run once over all trials.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.validation import (
    fold_metrics,
    fold_scores,
    folds,
    future_return,
    out_of_fold,
    stability_penalty,
)
from tidemark.plans.params import COMPONENTS, CV_SPLITS, EPSILON, SEARCH, SEED, Params
from tidemark.sources.bars import chunked, halo, owned

WHOLE = ("lookback", "lookforward", "min_bars", "max_hold")
#: Trials drawn at random before the model is asked, trials of a batch, and draws that each is the best of.
STARTUP, BATCH, DRAWS = 10, 10, 24
#: The share of trials that counts as good, and how many do at most.
GOOD_SHARE, GOOD_MOST = 0.1, 25


class RowSettings:
    """The setting of each row as columns; what must be known for all rows is that of the widest."""

    def __init__(self, widest: Params) -> None:
        self.reach, self.hold_rows, self.widest = widest.reach, widest.hold_rows, widest

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"p_{name}")

    def weight(self, component: str) -> Column:
        return F.col(f"p_weight_{component}")


def widest(settings: Sequence[Params]) -> Params:
    """A setting whose frames are at least as long as any of theirs."""
    return replace(settings[0], lookback=max(p.lookback for p in settings), max_hold=max(p.max_hold for p in settings))


def eachsetting(features: DataFrame, settings: Sequence[Params]) -> DataFrame:
    """Every row once for each setting: adds trial and the setting's columns; series_key becomes key@trial."""
    kinds = {f.name: "int" if f.name in WHOLE else "double" for f in fields(Params)}
    shape = ", ".join(["trial: int", *[f"p_{c}: {kind}" for c, kind in kinds.items()]])
    rows = [{"trial": i, **{f"p_{c}": v for c, v in asdict(p).items()}} for i, p in enumerate(settings)]
    given = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>")
    out = features.withColumn("_s", F.explode(given)).select("*", "_s.*").drop("_s")
    return out.withColumn("series_key", F.concat_ws("@", "series_key", F.col("trial").cast("string")))


def trial_signals(features: DataFrame, settings: Sequence[Params], splits: int = CV_SPLITS) -> DataFrame:
    """validation.fold_signals() of all settings at once, with trial; origin is key@trial."""
    most = widest(settings)
    rows = RowSettings(most)
    tried = chunked(eachsetting(features, settings), 0, most.max_hold)
    whole = tried.withColumn("future_return", future_return(rows.max_hold))
    whole = owned(whole.withColumn("target", F.signum("future_return").cast("int")))
    return out_of_fold(folds(whole, splits), rows, halo(most), ("trial", "p_max_hold"))


def trial_metrics(features: DataFrame, settings: Sequence[Params], splits: int = CV_SPLITS, kind: str = "brier") -> DataFrame:
    """fold_metrics() (brier) or fold_scores() (blended) of all settings, with trial."""
    told = trial_signals(features, settings, splits)
    found = fold_metrics(told) if kind == "brier" else fold_scores(told)
    return found.select(
        F.element_at(F.split("origin", "@"), -1).cast("int").alias("trial"),
        F.regexp_replace("origin", "@[0-9]+$", "").alias("origin"),
        *[c for c in found.columns if c != "origin"],
    )


def objectives(metrics: DataFrame, trials: int, kind: str = "brier") -> DataFrame:
    """(trial, objective) of trial_metrics(): the mean over series of what objective() is for one; -1 without labelled rows."""
    if kind == "brier":
        answered = F.avg("coverage") > EPSILON
        value = F.when((F.count("*") >= 2) & answered, -F.avg("brier")).otherwise(-1.0)
    else:
        score = 0.3 * F.col("f1") + 0.3 * F.col("sharpe") + 0.2 * (F.col("precision") + F.col("recall"))
        scores = F.transform(F.sort_array(F.collect_list(F.struct("fold", score.alias("s")))), lambda x: x["s"])
        penalty = F.udf(lambda x: float(stability_penalty(x)), "double")  # of some five numbers
        value = F.when(F.count("*") >= 2, F.avg(score) - 0.15 * penalty(scores)).otherwise(-1.0)
    by_series = metrics.groupBy("trial", "origin").agg(value.alias("value"))
    found = by_series.groupBy("trial").agg(F.avg("value").alias("objective"))
    every = metrics.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial"))
    return every.join(found, "trial", "left").na.fill(-1.0, ["objective"])


def valued(features: DataFrame, settings: Sequence[Params], splits: int = CV_SPLITS, kind: str = "brier") -> list[float]:
    """The objective of each setting: one job, one row for each setting to the driver."""
    found = objectives(trial_metrics(features, settings, splits, kind), len(settings), kind)
    return [r["objective"] for r in found.orderBy("trial").collect()]


def _range(name: str) -> tuple[float, float]:
    return SEARCH["weight"] if name.startswith("weight_") else SEARCH[name]


def setting(values: dict[str, float]) -> Params:
    """The setting of drawn values, with weights that sum to one."""
    return Params(**{k: round(v) if k in WHOLE else v for k, v in values.items()}).normalised()


NAMES = (*(k for k in SEARCH if k != "weight"), *(f"weight_{c}" for c in COMPONENTS))


def draw(rng: random.Random) -> dict[str, float]:
    """Random values within the search ranges."""
    return {k: rng.randint(*_range(k)) if k in WHOLE else rng.uniform(*_range(k)) for k in NAMES}


class Parzen:
    """The density of one parameter's values: a kernel at each, as wide as the gap to its neighbours, and one over the range."""

    def __init__(self, name: str, values: Sequence[float]) -> None:
        low, high = (float(x) for x in _range(name))
        edge = 0.5 if name in WHOLE else 0.0
        self.low, self.high = low - edge, high + edge
        span = self.high - self.low
        at = sorted(values)
        around = [self.low, *at, self.high]
        least = span / min(100, len(at) + 2)
        wide = [min(span, max(least, around[i] - around[i - 1], around[i + 1] - around[i])) for i in range(1, len(at) + 1)]
        self.kernels = [*zip(at, wide, strict=True), ((self.low + self.high) / 2, span)]

    def density(self, x: float) -> float:
        total = 0.0
        for centre, width in self.kernels:
            inside = self._below((self.high - centre) / width) - self._below((self.low - centre) / width)
            total += math.exp(-0.5 * ((x - centre) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
        return total / len(self.kernels)

    @staticmethod
    def _below(z: float) -> float:
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))

    def draw(self, rng: random.Random) -> float:
        centre, width = rng.choice(self.kernels)
        while not self.low <= (x := rng.gauss(centre, width)) <= self.high:
            pass
        return x


def propose(tried: Sequence[tuple[dict, float]], rng: random.Random, draws: int = DRAWS) -> dict[str, float]:
    """Values that are likely among good trials and not among the others, each parameter by itself."""
    ranked = sorted(tried, key=lambda t: -t[1])
    n = min(math.ceil(GOOD_SHARE * len(ranked)), GOOD_MOST)
    out = {}
    for name in NAMES:
        good, rest = (Parzen(name, [v[name] for v, _ in part]) for part in (ranked[:n], ranked[n:]))
        low, high = _range(name)
        found = [min(max(round(x), low), high) if name in WHOLE else x for x in (good.draw(rng) for _ in range(draws))]
        out[name] = max(found, key=lambda x: good.density(x) / rest.density(x))
    return out


def search(
    features: DataFrame,
    trials: int,
    splits: int = CV_SPLITS,
    kind: str = "brier",
    seed: int = SEED,
    method: str = "parzen",
    batch: int = BATCH,
    evaluate: Callable[[list[Params]], list[float]] | None = None,
) -> tuple[Params, list[tuple[Params, float]]]:
    """The best setting found, and every trial in order; each batch of trials is one job.

    random: all trials are drawn at once.  parzen: the first STARTUP are; then each batch is asked of
    the trials before it.  Cut or cache features before: every batch reads them.
    """
    rng = random.Random(seed)
    evaluate = evaluate or (lambda settings: valued(features, settings, splits, kind))
    tried: list[tuple[dict, float]] = []
    while len(tried) < trials:
        left = trials - len(tried)
        if method == "random":
            asked = [draw(rng) for _ in range(left)]
        elif len(tried) < STARTUP:
            asked = [draw(rng) for _ in range(min(STARTUP, left))]
        else:
            asked = [propose(tried, rng) for _ in range(min(batch, left))]
        tried += zip(asked, evaluate([setting(v) for v in asked]), strict=True)
    told = [(setting(values), objective) for values, objective in tried]
    return max(told, key=lambda t: t[1])[0], told
