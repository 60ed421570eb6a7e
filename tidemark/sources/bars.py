"""OHLC bars: from a CSV file, from events, numbered and dealt into chunks.

A long series is not one task: rows are numbered through counts of time
buckets, then dealt into chunks of CHUNK rows that also carry the rows before
and after them which a frame can reach.  Windows partition by (series_key,
chunk); every chunk keeps only the rows it owns.  The chunk column says how many
rows its chunks carry; an operator that reaches further raises ValueError.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.plans.params import LONG, Params

CSV_TIME = "yyyy:MM:dd-HH:mm:ss"
OHLC = ("open", "high", "low", "close")
#: Rows of a chunk.
CHUNK = 16_384
#: Rows before a chunk that features read: three times the longest period is the longest frame.
FEATURE_ROWS = 3 * max(LONG) + 20


def read_bars(
    spark: SparkSession, path: str | Path, series_key: str = "ALL", max_age_hours: float | None = None
) -> DataFrame:
    """Bars of a CSV file with snapshotTime (or date), open, high, low, close.

    Rows with a missing or unreadable cell are dropped.  Raises ValueError for a
    missing column, if no row is left, or if the last bar is older than allowed.
    """
    raw = spark.read.csv(str(path), header=True)
    if "date" in raw.columns and "snapshotTime" not in raw.columns:
        raw = raw.withColumnRenamed("date", "snapshotTime")
    missing = sorted({"snapshotTime", *OHLC} - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    given = F.try_to_timestamp("snapshotTime", F.lit(CSV_TIME))
    fixed = raw.agg(F.count(given).alias("n")).first()["n"]
    ts = given if fixed else F.try_to_timestamp("snapshotTime")
    bars = raw.select(
        F.lit(series_key).alias("series_key"),
        ts.alias("ts"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in OHLC],
    ).na.drop()
    last = bars.agg(F.max("ts").alias("ts"), F.current_timestamp().alias("now")).first()
    if last["ts"] is None:
        raise ValueError("no usable rows")
    if max_age_hours is not None and (last["now"] - last["ts"]).total_seconds() > 3600 * max_age_hours:
        raise ValueError("the bars are stale")
    return bars


def bars_from_events(events: DataFrame, width: str = "1 hour", key: str | None = None) -> DataFrame:
    """Bars of an events table (event_id, ts, value); one series, or one for each value of a column."""
    first = F.struct("ts", "event_id")
    series = F.lit("ALL") if key is None else F.col(key)
    # Grouped by the window itself: its start alone would lose a stream's watermark.
    made = events.groupBy(series.alias("series_key"), F.window("ts", width).alias("_window")).agg(
        F.min_by("value", first).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", first).alias("close"),
        F.count("*").alias("n_events"),
    )
    return made.select("series_key", F.col("_window.start").alias("ts"), "open", "high", "low", "close", "n_events")


@F.pandas_udf(DoubleType())
def _exp(x: pd.Series) -> pd.Series:
    """To the last digit; the JVM's is one off for every tenth number or so."""
    with np.errstate(over="ignore", under="ignore"):
        return np.exp(x)


def walk(events: DataFrame, key: str, start: float = 10.0, step: float = 0.5) -> DataFrame:
    """The events with a price for value: it moves by what each event's value has after the point, up or down, in the order of time.

    Moves are whole 256ths, so sums do not depend on their order.  Those of days are added up first:
    a long series is many groups.
    """
    move = (F.floor(F.col("value") % 1 * 128) - 63.5) / 128
    moves = events.withColumns({"_move": move, "_day": F.date_trunc("day", "ts")})
    days = moves.groupBy(key, "_day").agg(F.sum("_move").alias("_sum"))
    before = W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    starts = days.select(key, "_day", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = W.partitionBy(key, "_day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    so_far = F.col("_before") + F.col("_within")
    return (
        moves.withColumn("_within", F.sum("_move").over(inside))
        .join(starts, [key, "_day"])
        .withColumn("value", start * _exp(step * so_far))
        .drop("_move", "_day", "_within", "_before")
    )


def numbered(bars: DataFrame, bucket: str = "day") -> DataFrame:
    """Adds rn (from 0 in each series) and n (rows of the series).

    Rows are numbered within (series, bucket of time); a bucket's first number comes
    from the counts of those before it, so a long series is many groups.  Bars of
    single ticks want a shorter bucket.
    """
    dated = bars.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    counts = dated.groupBy("series_key", "_bucket").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("series_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "series_key",
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(W.partitionBy("series_key")).alias("n"),
    )
    inside = W.partitionBy("series_key", "_bucket").orderBy("ts", *[c for c in OHLC if c in bars.columns])
    return (
        dated.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, ["series_key", "_bucket"])
        .withColumn("rn", F.col("_start") + F.col("_at"))
        .drop("_bucket", "_start", "_at")
    )


def halo(params: Params) -> tuple[int, int]:
    """Rows before and after a chunk that features, scores, signals and targets of a setting read."""
    return FEATURE_ROWS + params.reach, params.max_hold


def chunked(rows: DataFrame, before: int = FEATURE_ROWS, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Adds chunk and owned: each row goes to its own chunk and to those whose frames reach it."""
    own = F.floor(F.col("rn") / size)
    first = F.greatest(F.floor((F.col("rn") - after) / size), F.lit(0))
    last = F.floor((F.col("rn") + before) / size)
    top = F.floor((F.col("n") - 1) / size)
    return (
        rows.withColumn("chunk", F.explode(F.sequence(first, F.least(last, top))))
        .withMetadata("chunk", {"before": before, "after": after})
        .withColumn("owned", F.col("chunk") == own)
    )


def reaching(rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """The same rows; ValueError if their chunks carry fewer rows than frames would read."""
    held = rows.schema["chunk"].metadata
    if held.get("before", 0) < before or held.get("after", 0) < after:
        raise ValueError(f"chunks must carry {before} rows before and {after} after them: see halo()")
    return rows


def latest(rows: DataFrame, last: int) -> DataFrame:
    """The last rows of each numbered series."""
    return rows.where(F.col("rn") >= F.col("n") - last)


def owned(rows: DataFrame) -> DataFrame:
    """Only the rows that their chunk owns, without the marks of chunks."""
    return rows.where("owned").drop("chunk", "owned")
