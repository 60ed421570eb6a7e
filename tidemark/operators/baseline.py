"""A logistic baseline for every fold at once, and the comparison with the model.

Newton steps for all (series, fold) models run as one aggregation each: rows
give the sums of the gradient and the Hessian, grouped with partial
aggregation, and only those few numbers are solved in a pandas function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.quantiles import quantiles
from tidemark.operators.validation import brier
from tidemark.plans.params import EPSILON

COLUMNS = (
    "hl_range_pct",
    "vol_ratio_20",
    "trend_strength_20",
    "price_position_20",
    "body_to_range_ratio",
    "wick_balance",
    "hurst_20",
    "rsi_20",
)
PENALTY, STEPS = 1.0, 12
KEY = ["origin", "fold"]


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def baseline(dealt: DataFrame, horizon: int, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(origin, fold, rn, up_probability, direction) of validation rows.

    dealt: folds() of features with target. Medians fill gaps, columns are
    standardised on the training rows, classes are balanced and all weights but
    the constant are penalised. A fold with one class gives that class.
    """
    split = F.min(F.when(F.col("validation"), F.col("rn")))
    bounds = dealt.groupBy(*KEY).agg(split.alias("_split"))
    rows = dealt.join(bounds, KEY)
    train = rows.where("NOT validation AND rn + " + str(int(horizon)) + " < _split AND target IN (-1, 1)")
    long = train.select(*KEY, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(KEY, list(columns), "column", "value")
    medians = cut(
        quantiles(long, [*KEY, "column"], "value", (0.5,))
        .groupBy(*KEY)
        .pivot("column", list(columns))
        .agg(F.first(F.get("quantiles", F.lit(0))))
        .withColumnsRenamed({c: f"_m_{c}" for c in columns})
    )

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(c, f"_m_{c}", F.lit(0.0)) for c in columns})

    stats = filled(train.join(medians, KEY, "left")).groupBy(*KEY).agg(
        *[F.avg(c).alias(f"_a_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
        F.count("*").alias("_n"),
        F.count_if(F.col("target") == 1).alias("_up"),
    )
    known = stats.join(medians, KEY, "left")

    def scaled(df: DataFrame) -> DataFrame:
        df = filled(df.join(known, KEY))
        return df.withColumns(
            {
                f"_x{i}": (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
                for i, c in enumerate(columns)
            }
            | {f"_x{len(columns)}": F.lit(1.0)}
        )

    k = len(columns) + 1
    x = [F.col(f"_x{i}") for i in range(k)]
    up = (F.col("target") == 1).cast("double")
    share = F.when(up == 1, F.col("_up")).otherwise(F.col("_n") - F.col("_up"))
    fitted = scaled(train).withColumns({"_y": up, "_w": F.col("_n") / (2 * share)}).persist()
    models = stats.where("_up > 0 AND _up < _n").select(*KEY, F.array(*[F.lit(0.0)] * k).alias("w"))
    schema = models.schema

    def solve(groups):
        for part in groups:
            for i in part.index:
                w = np.array(part.at[i, "w"], float)
                g = np.array(part.at[i, "g"], float)
                h = np.zeros((k, k))
                h[np.triu_indices(k)] = part.at[i, "h"]
                h = h + np.triu(h, 1).T
                ridge = np.full(k, PENALTY)
                ridge[-1] = 0.0
                part.at[i, "w"] = w + np.linalg.solve(h + np.diag(ridge + 1e-12), g - ridge * w)
            yield part[[*KEY, "w"]]

    for _ in range(STEPS):
        z = _sum([F.get("w", i) * x[i] for i in range(k)])
        p = 1 / (1 + F.exp(-z))
        step = fitted.join(models, KEY).withColumns(
            {"_e": F.col("_w") * (F.col("_y") - p), "_c": F.col("_w") * p * (1 - p)}
        )
        sums = step.groupBy(*KEY).agg(
            F.first("w").alias("w"),
            F.array(*[F.sum(F.col("_e") * x[i]) for i in range(k)]).alias("g"),
            F.array(*[F.sum(F.col("_c") * x[i] * x[j]) for i in range(k) for j in range(i, k)]).alias("h"),
        )
        # One row for each series and fold, written so that steps do not pile up in the plan.
        models = cut(sums.mapInPandas(solve, schema))
    fitted.unpersist()
    z = _sum([F.get("w", i) * x[i] for i in range(k)])
    told = scaled(rows.where("validation")).join(models, KEY, "left")
    alone = (F.col("_up") == F.col("_n")).cast("double")
    p = F.when(F.col("w").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(alone)
    return told.select(
        *KEY, "rn", p.alias("up_probability"), F.when(p >= 0.5, 1).otherwise(-1).alias("direction")
    )


def aggregate_result(told: DataFrame, prefix: str) -> DataFrame:
    """Coverage, accuracy of answers and Brier score over labelled rows of all folds."""
    active = F.col("direction") != 0
    return told.where("label IN (-1, 1)").agg(
        F.count("*").cast("double").alias(f"{prefix}_sample_count"),
        F.coalesce(F.avg(active.cast("double")), F.lit(0.0)).alias(f"{prefix}_coverage"),
        F.coalesce(
            F.avg(F.when(active, (F.col("direction") == F.col("label")).cast("double"))), F.lit(0.0)
        ).alias(f"{prefix}_answered_accuracy"),
        F.coalesce(brier(F.col("up_probability"), F.col("label")), F.lit(1.0)).alias(f"{prefix}_brier"),
    )


def benchmark(told: DataFrame, simple: DataFrame) -> DataFrame:
    """(metric, value) of the model (fold_signals) against the baseline on the same rows."""
    labels = told.select("origin", "fold", "rn", F.col("fold_target").alias("label"))
    model = aggregate_result(told.withColumn("label", F.col("fold_target")), "model")
    other = aggregate_result(simple.join(labels, ["origin", "fold", "rn"]), "baseline")
    both = model.join(F.broadcast(other))  # one row each
    both = both.withColumns(
        {
            "accuracy_delta": F.col("model_answered_accuracy") - F.col("baseline_answered_accuracy"),
            "brier_improvement": F.col("baseline_brier") - F.col("model_brier"),
            "model_beats_baseline": (F.col("model_brier") + EPSILON < F.col("baseline_brier")).cast("double"),
        }
    )
    return both.unpivot([], both.columns, "metric", "value")
