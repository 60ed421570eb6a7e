"""Calibration of probabilities from out-of-fold signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantiles
from tidemark.plans.params import (
    CALIBRATION_BINS,
    CALIBRATION_BLEND,
    CALIBRATION_MIN_SAMPLES,
    EPSILON,
)


def usable(told: DataFrame) -> DataFrame:
    """(p, hit) of the out-of-fold signals that have a direction and a label of the whole series."""
    return told.where("direction <> 0 AND probability > 0 AND target IN (-1, 1)").select(
        F.col("probability").alias("p"), (F.col("direction") == F.col("target")).cast("double").alias("hit")
    )


def bins(samples: DataFrame, count: int = CALIBRATION_BINS) -> DataFrame:
    """Quantile bins of p: (bin, low, high, n, mean_p, hit_rate, blended); the last is closed above."""
    at = tuple(i / count for i in range(count + 1))
    edges = quantiles(samples.select("p"), [], "p", at).select(F.array_sort(F.array_distinct("quantiles")).alias("edges"))
    placed = samples.join(F.broadcast(edges)).select(  # one row of edges
        "p",
        "hit",
        "edges",
        F.least(
            F.size(F.filter("edges", lambda e: e <= F.col("p"))), F.size("edges") - 1
        ).alias("bin"),
    )
    rate = (1 - CALIBRATION_BLEND) * F.avg("p") + CALIBRATION_BLEND * F.avg("hit")
    return placed.where("bin > 0").groupBy("bin").agg(
        F.first(F.get("edges", F.col("bin") - 1)).alias("low"),
        F.first(F.get("edges", F.col("bin"))).alias("high"),
        F.count("*").alias("n"),
        F.avg("p").alias("mean_p"),
        F.avg("hit").alias("hit_rate"),
        rate.alias("blended"),
    )


@dataclass(frozen=True)
class Calibration:
    """A non-decreasing piecewise linear map of [0, 1]."""

    raw: tuple[float, ...]
    calibrated: tuple[float, ...]

    def map(self, p: Column) -> Column:
        """The calibrated value of a probability."""
        x = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        out = F.lit(self.calibrated[-1])
        points = list(zip(self.raw, self.calibrated, strict=True))
        for (a, u), (b, v) in reversed(list(zip(points, points[1:], strict=False))):
            out = F.when(x < b, u + (x - a) * ((v - u) / (b - a))).otherwise(out)
        return F.when(x <= self.raw[0], self.calibrated[0]).otherwise(out)

    def apply(self, told: DataFrame) -> DataFrame:
        """Signals with mapped probabilities; a direction needs more than a half."""
        p = F.when(F.col("probability") > 0, self.map(F.col("probability"))).otherwise(F.col("probability"))
        return told.withColumn("probability", p).withColumn(
            "direction", F.when(F.col("probability") > 0.5, F.col("direction")).otherwise(0)
        )


def fit(samples: DataFrame, count: int = CALIBRATION_BINS) -> Calibration | None:
    """A calibration from usable samples; None with too few of them or too little spread."""
    n = samples.count()
    if n < CALIBRATION_MIN_SAMPLES:
        return None
    made = bins(samples, min(count, n)).orderBy("bin").collect()  # `count` rows at most
    return anchors([(r["mean_p"], r["blended"]) for r in made])


def anchors(points: list[tuple[float, float]]) -> Calibration | None:
    """A monotone curve through the points, carried on to 0 and 1."""
    if len(points) < 2:
        return None
    kept: list[list[float]] = []
    top_x = top_y = 0.0
    for x, y in points:
        top_x, top_y = max(top_x, min(max(x, 0.0), 1.0)), max(top_y, min(max(y, 0.0), 1.0))
        kept.append([top_x, top_y])
    if kept[0][0] > 0:
        kept.insert(0, [0.0, 0.0])
    if kept[-1][0] < 1:
        kept.append([1.0, kept[-1][1]])
    out: list[list[float]] = []
    for x, y in kept:
        if out and abs(x - out[-1][0]) <= EPSILON:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    if len(out) < 2:
        return None
    return Calibration(tuple(x for x, _ in out), tuple(y for _, y in out))
