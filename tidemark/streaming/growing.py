"""A folder of CSV files that grows, as numbered bars.

Each arrival's readable rows are numbered on from the last number of their series,
so bars that are there already are neither read nor numbered again.  What cannot
be used is kept beside them with its reason and file:

- cells: the line has more or fewer cells than the header;
- time, number: a cell is missing or cannot be read (time first, if both);
- late: the bar is not later than the last one of its series that an earlier
  arrival brought, so it has come again or out of order.

A file whose header names other columns, or in another order, stops the stream.
The table of an arrival and the last number and time of each series are written
under the number of its micro-batch and overwritten if that is run again, so a
restart gives each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.lineage import exists, remove
from tidemark.sources.bars import CSV_TIME, OHLC, numbered

ENDS = "series_key string, last_rn long, last_ts timestamp"


def csv_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The files of a folder as they come: all cells as text, the line of those with too few or many, and the file."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_line"])
    # Without pruning, whether a line has too few cells does not depend on the columns that are asked for.
    reader = spark.readStream.schema(schema).options(header=True, enforceSchema=False, columnPruning=False)
    return reader.option("columnNameOfCorruptRecord", "_line").csv(folder).withColumn("_file", F.col("_metadata.file_path"))


def told(cells: DataFrame, columns: list[str], series: Column) -> DataFrame:
    """(series_key, ts, open, high, low, close, reason, given_time, line, file); reason null: a bar."""
    given = "snapshotTime" if "snapshotTime" in columns else "date"
    ts = F.coalesce(F.try_to_timestamp(given, F.lit(CSV_TIME)), F.try_to_timestamp(given))
    numbers = {c: F.expr(f"try_cast(`{c}` AS double)") for c in OHLC}
    missing = F.greatest(*[n.isNull() | F.isnan(n) for n in numbers.values()])
    reason = (
        F.when(F.col("_line").isNotNull(), "cells").when(ts.isNull() | series.isNull(), "time").when(missing, "number")
    )
    return cells.select(
        series.alias("series_key"),
        ts.alias("ts"),
        *[n.alias(c) for c, n in numbers.items()],
        reason.alias("reason"),
        F.col(given).alias("given_time"),
        F.coalesce("_line", F.to_csv(F.struct(*columns))).alias("line"),
        F.col("_file").alias("file"),
    )


def arrived(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of told() with rn; bars that are not later than the end of their series get a reason instead.

    ends: last_rn and last_ts of each series before this arrival.
    """
    known = rows.join(ends, "series_key", "left")
    late = F.when(F.col("ts") <= F.col("last_ts"), "late")
    known = known.withColumn("reason", F.coalesce("reason", late))
    bars = numbered(known.where("reason IS NULL")).withColumn("rn", F.col("rn") + F.coalesce(F.col("last_rn") + 1, F.lit(0)))
    bad = known.where("reason IS NOT NULL").withColumn("rn", F.lit(None).cast("long"))
    return bars.drop("n").unionByName(bad).drop("last_rn", "last_ts")


def write_growing(
    spark: SparkSession, folder: str, path: str, checkpoint: str, key: str | None = None, once: bool = False
) -> StreamingQuery:
    """Number the bars of a growing folder into the table at path; one series, or one for each value of a column.

    Raises ValueError if the first file lacks a column.
    """
    columns = spark.read.csv(folder, header=True).columns
    times = {"snapshotTime", "date"} & set(columns)
    missing = {*OHLC, *([key] if key else [])} - set(columns) | (set() if times else {"snapshotTime"})
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    series = F.col(key) if key else F.lit("ALL")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ends, before = session.createDataFrame([], ENDS), f"{path}/ends/{number - 1}"
        if exists(session, before):
            ends = session.read.schema(ENDS).parquet(before)
        out = f"{path}/rows/batch={number}"
        arrived(told(batch, columns, series), ends).write.mode("overwrite").parquet(out)
        new = session.read.parquet(out).where("reason IS NULL").select("series_key", F.col("rn").alias("last_rn"), F.col("ts").alias("last_ts"))
        last = ends.unionByName(new).groupBy("series_key").agg(F.max("last_rn").alias("last_rn"), F.max("last_ts").alias("last_ts"))
        last.write.mode("overwrite").parquet(f"{path}/ends/{number}")
        remove(session, f"{path}/ends/{number - 2}")

    writer = csv_stream(spark, folder, columns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")


def read_growing(spark: SparkSession, path: str) -> DataFrame:
    """The bars so far: series_key, ts, open, high, low, close, rn and n, as numbered() gives them."""
    bars = _rows(spark, path).where("reason IS NULL").select("series_key", "ts", *OHLC, "rn")
    return bars.join(bars.groupBy("series_key").agg(F.count("*").alias("n")), "series_key")


def read_unusable(spark: SparkSession, path: str) -> DataFrame:
    """What could not be used so far: series_key, reason, given_time, line and file."""
    return _rows(spark, path).where("reason IS NOT NULL").select("series_key", "reason", "given_time", "line", "file")
