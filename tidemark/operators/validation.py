"""Rolling-origin validation: folds, targets, fold metrics, objective and importance."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import lead, ratio
from tidemark.operators.breakout import signals
from tidemark.operators.detector import score_windows
from tidemark.plans.params import (
    COMPONENTS,
    CV_SPLITS,
    CV_TRAIN_MULTIPLIER,
    EPSILON,
    Params,
)
from tidemark.sources.bars import chunked, halo, owned, reaching


def fold_bounds(n: int, splits: int = CV_SPLITS, multiplier: int = CV_TRAIN_MULTIPLIER) -> list[tuple]:
    """(fold, first training row, first validation row, end) of each fold; ValueError if n is too small."""
    if n <= splits + multiplier:
        raise ValueError(f"{n} rows are too few for {splits} folds")
    width = max(1, n // (splits + multiplier))
    train = n - width * splits
    return [
        (k, k * width, k * width + train, n if k == splits - 1 else (k + 1) * width + train)
        for k in range(splits)
    ]


def folds(bars: DataFrame, splits: int = CV_SPLITS, multiplier: int = CV_TRAIN_MULTIPLIER) -> DataFrame:
    """Rows of numbered bars dealt into folds: adds fold, validation and the old place (old_rn, old_n).

    Each fold becomes a series of its own (series_key, rn, n), so one job runs
    all of them. Series that are too short have no folds.
    """
    width = F.floor(F.col("n") / (splits + multiplier))
    train = F.col("n") - width * splits
    each = F.transform(
        F.sequence(F.lit(0), F.lit(splits - 1)),
        lambda k: F.struct(
            k.alias("fold"),
            (k * width).alias("first"),
            (k * width + train).alias("val"),
            F.when(k == splits - 1, F.col("n")).otherwise((k + 1) * width + train).alias("end"),
        ),
    )
    inside = F.filter(each, lambda f: (F.col("rn") >= f["first"]) & (F.col("rn") < f["end"]))
    out = bars.where(F.col("n") > splits + multiplier).select("*", F.explode(inside).alias("_f"))
    return out.select(
        F.concat_ws("#", "series_key", F.col("_f.fold").cast("string")).alias("series_key"),
        (F.col("rn") - F.col("_f.first")).alias("rn"),
        (F.col("_f.end") - F.col("_f.first")).alias("n"),
        F.col("series_key").alias("origin"),
        F.col("_f.fold").cast("int").alias("fold"),
        (F.col("rn") >= F.col("_f.val")).alias("validation"),
        F.col("rn").alias("old_rn"),
        *[c for c in bars.columns if c not in ("series_key", "rn", "n", "chunk", "owned")],
    )


def future_return(k: int | Column) -> Column:
    """Relative change of close over the next k rows; null at the end of a series."""
    return ratio(lead("close", k), F.col("close")) - 1


def direction_targets(bars: DataFrame, horizon: int) -> DataFrame:
    """Adds future_return and target (its sign) to chunked bars."""
    df = reaching(bars, after=horizon).withColumn("future_return", future_return(horizon))
    return df.withColumn("target", F.signum("future_return").cast("int"))


def up_probability(p: Column, direction: Column) -> Column:
    """Probability of a rise: p of an upward signal, 1 - p of a downward one, else a half."""
    clipped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(direction > 0, clipped).when(direction < 0, 1 - clipped).otherwise(0.5)


def fold_signals(features: DataFrame, params: Params, splits: int = CV_SPLITS) -> DataFrame:
    """Out-of-fold signals of numbered features: detector and predictor run anew in every fold.

    Features are not made anew; the target is that of the whole series, and
    fold_target that of the fold alone (null near its end).
    """
    whole = owned(direction_targets(chunked(features, 0, params.max_hold), params.max_hold))
    return out_of_fold(folds(whole, splits), params, halo(params))


def out_of_fold(dealt: DataFrame, params: Params, reach: tuple[int, int], kept: tuple[str, ...] = ()) -> DataFrame:
    """The signals of rows dealt into folds, with fold_target, up_probability and the kept columns."""
    extra = ["series_key", "rn", "origin", "fold", "old_rn", "validation", "future_return", "target"]
    told = signals(score_windows(chunked(dealt.drop(*extra[2:]), *reach), params), params)
    extra += kept
    return (
        told.join(dealt.select(*extra), ["series_key", "rn"])
        .where("validation")
        .withColumns(
            {
                "fold_target": F.when(F.col("rn") + params.max_hold < F.col("n"), F.col("target")),
                "up_probability": up_probability(F.col("probability"), F.col("direction")),
            }
        )
    )


def brier(p: Column, target: Column) -> Column:
    return F.avg(F.pow(p - (target == 1).cast("double"), 2))


def f1_weighted() -> list[Column]:
    """Sums from which weighted F1, precision and recall follow, over active rows of two classes."""
    active = (F.col("direction") != 0) & F.col("label").isNotNull()
    return [
        F.count_if(active & (F.col("label") == a) & (F.col("direction") == b)).alias(f"_{x}{y}")
        for a, x in ((1, "u"), (-1, "d"))
        for b, y in ((1, "u"), (-1, "d"))
    ]


def fold_metrics(told: DataFrame) -> DataFrame:
    """Brier score, coverage, accuracy, F1 and Sharpe-like ratio of each fold's labelled rows."""
    rows = told.withColumn("label", F.col("fold_target")).where("label IN (-1, 1)")
    active = F.col("direction") != 0
    gain = F.when(active, F.col("direction") * F.col("future_return"))
    out = rows.groupBy("origin", "fold").agg(
        F.count("*").alias("labelled"),
        brier(F.col("up_probability"), F.col("label")).alias("brier"),
        F.avg(active.cast("double")).alias("coverage"),
        F.avg(F.when(active, (F.col("direction") == F.col("label")).cast("double"))).alias("accuracy"),
        F.avg(gain).alias("_mean"),
        F.stddev_samp(gain).alias("_std"),
        *f1_weighted(),
    )

    def of_class(hit: str, miss: str, extra: str) -> tuple[Column, Column]:
        tp, fn, fp = (F.col(c) for c in (hit, miss, extra))
        return tp + fn, F.coalesce(F.try_divide(2 * tp, 2 * tp + fn + fp), F.lit(0.0))

    (n_u, f_u), (n_d, f_d) = of_class("_uu", "_ud", "_du"), of_class("_dd", "_du", "_ud")
    p_u = F.coalesce(F.try_divide(F.col("_uu"), F.col("_uu") + F.col("_du")), F.lit(0.0))
    p_d = F.coalesce(F.try_divide(F.col("_dd"), F.col("_dd") + F.col("_ud")), F.lit(0.0))
    return out.select(
        "origin",
        "fold",
        "labelled",
        "brier",
        "coverage",
        F.coalesce("accuracy", F.lit(0.0)).alias("answered_accuracy"),
        F.coalesce(F.try_divide(n_u * f_u + n_d * f_d, n_u + n_d), F.lit(0.0)).alias("active_f1"),
        F.coalesce(F.try_divide(n_u * p_u + n_d * p_d, n_u + n_d), F.lit(0.0)).alias("active_precision"),
        F.coalesce(F.col("_mean") / (F.col("_std") + EPSILON) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias(
            "active_sharpe"
        ),
    )


def fold_scores(told: DataFrame) -> DataFrame:
    """What the blended objective reads: F1, precision, recall and Sharpe-like ratio over all labelled rows of a fold.

    A row without a direction is a miss of its class and a return of 0; folds without any direction are left out.
    """
    rows = told.withColumn("label", F.col("fold_target")).where("label IN (-1, 1)")
    d, y = F.col("direction"), F.col("label")
    gain = d * F.col("future_return")
    counts = {
        f"_{kind}{name}": F.count_if(test)
        for side, name in ((1, "u"), (-1, "d"))
        for kind, test in (("hit", (d == side) & (y == side)), ("said", d == side), ("is", y == side))
    }
    out = rows.groupBy("origin", "fold").agg(
        *[c.alias(k) for k, c in counts.items()], F.avg(gain).alias("_mean"), F.stddev_samp(gain).alias("_std")
    )

    def weighted(of) -> Column:
        """The mean over both classes, by their rows."""
        parts = [F.col(f"_is{x}") * F.coalesce(of(x), F.lit(0.0)) for x in "ud"]
        return F.try_divide(parts[0] + parts[1], F.col("_isu") + F.col("_isd"))

    return out.where("_saidu + _saidd > 0").select(
        "origin",
        "fold",
        weighted(lambda x: F.try_divide(2 * F.col(f"_hit{x}"), F.col(f"_said{x}") + F.col(f"_is{x}"))).alias("f1"),
        weighted(lambda x: F.try_divide(f"_hit{x}", f"_said{x}")).alias("precision"),
        weighted(lambda x: F.try_divide(f"_hit{x}", f"_is{x}")).alias("recall"),
        F.coalesce(F.col("_mean") / (F.col("_std") + EPSILON) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
    )


def objective(metrics: list[dict], kind: str = "brier") -> float:
    """What the search maximises, from the folds of one series (as dictionaries).

    brier (of fold_metrics): minus the mean Brier score; -1 if no row is answered.  blended (of
    fold_scores): F1, Sharpe and the mean of precision and recall, less a penalty for unsteady
    folds.  -1 with fewer than two folds.
    """
    if len(metrics) < 2:
        return -1.0
    if kind == "brier":
        answered = sum(m["coverage"] for m in metrics) / len(metrics)
        return -sum(m["brier"] for m in metrics) / len(metrics) if answered > EPSILON else -1.0
    scores = [
        0.3 * m["f1"] + 0.3 * m["sharpe"] + 0.2 * (m["precision"] + m["recall"])
        for m in sorted(metrics, key=lambda m: m["fold"])
    ]
    return sum(scores) / len(scores) - 0.15 * stability_penalty(scores)


def stability_penalty(scores: list[float]) -> float:
    """How far fold scores fall below their mean and how they decline, relative to their size."""
    n = len(scores)
    mean = sum(scores) / n
    down = (sum(min(0.0, s - mean) ** 2 for s in scores) / n) ** 0.5
    ordered = sorted(scores)
    place = 0.25 * (n - 1)
    low = int(place)
    p25 = ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * (place - low)
    slope = 0.0
    if n >= 3:
        mid = (n - 1) / 2
        slope = sum((i - mid) * s for i, s in enumerate(scores)) / sum((i - mid) ** 2 for i in range(n))
    size = max(sum(map(abs, scores)) / n, abs(mean), 1.0) + EPSILON
    fall = 0.35 * down + 0.25 * max(0.0, mean - p25) + 0.20 * max(0.0, mean - min(scores))
    return (fall + 0.20 * max(0.0, -slope)) / size


def importance(trials: DataFrame, parameters: list[str]) -> DataFrame:
    """(parameter, importance): absolute correlation with the objective; 0 where one is constant."""

    def strength(p: str) -> Column:
        spread = F.stddev_pop(p) * F.stddev_pop("objective")
        return F.coalesce(F.abs(F.try_divide(F.covar_pop(p, "objective"), spread)), F.lit(0.0))

    found = trials.agg(*[strength(p).alias(p) for p in parameters])
    return found.unpivot([], parameters, "parameter", "importance").orderBy(
        F.desc("importance"), "parameter"
    )


def with_weights(params: Params, **weights: float) -> Params:
    """The setting with other weights; a candle weight that is not given is 0."""
    given = {f"weight_{c}": weights.get(c, 0.0 if c == "sutte" else params.weight(c)) for c in COMPONENTS}
    return replace(params, **given).normalised()
