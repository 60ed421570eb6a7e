"""Live scores and breakouts of every closed bar of a stream, with state.

Each series keeps the bars that a frame can reach, and how many bars it has had
(transformWithState); so the state is bounded by the setting and never by the
length of the stream.  A micro-batch gets its new bars with those before them, and
the same operators score them that score whole series.  The last zone that may
act is older than any frame: it is written for each batch beside its result, from
the version of the batch before.  Both are overwritten if a batch is run again, so
a restart gives each bar once.

A series' new bars of one micro-batch are held by one task: bound a batch by the
files of a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.breakout import against, recent_volatility, zone_column
from tidemark.operators.detector import score_windows
from tidemark.operators.features import context_features
from tidemark.plans.params import Params
from tidemark.sources.bars import OHLC, chunked, halo

#: The state store that keeps lists and values by name.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "rn long, at long, open double, high double, low double, close double"
NAMES = ["rn", "at", *OHLC]


class Tail(StatefulProcessor):
    """Numbers the bars of a series and hands out the new ones after the last `keep` before them."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.bars = handle.getListState("bars", BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at", ignore_index=True)
        n = self.count.get()[0] if self.count.exists() else 0
        held = pd.DataFrame(list(self.bars.get()) if self.bars.exists() else [], columns=NAMES)
        new = new.assign(rn=range(n, n + len(new)))[NAMES]
        both = new if held.empty else pd.concat([held, new], ignore_index=True)
        self.count.update((n + len(new),))
        self.bars.put(list(both.tail(self.keep).itertuples(index=False, name=None)))
        yield both.assign(series_key=key[0], fresh=both["rn"] >= n)[["series_key", *NAMES, "fresh"]]

    def close(self) -> None:
        pass


def tails(bars: DataFrame, params: Params) -> DataFrame:
    """(series_key, rn, ts, open, high, low, close, fresh): each batch's new bars and those before them."""
    keep = halo(params)[0] + params.min_bars
    keyed = bars.select("series_key", F.unix_micros("ts").alias("at"), *OHLC)
    kept = keyed.groupBy("series_key").transformWithStateInPandas(
        Tail(keep), f"series_key string, {BAR}, fresh boolean", "Append", "None"
    )
    return kept.withColumn("ts", F.timestamp_micros("at")).drop("at")


def live_signals(rows: DataFrame, known: DataFrame, params: Params) -> DataFrame:
    """Score and breakout of each new bar, as if it were the last of its series, and the zone that may act on the next.

    rows: of tails(), of one batch; known: (series_key, known_zone) up to the batch before.
    """
    series = W.partitionBy("series_key")
    counted = rows.withColumns(
        {"n": F.max("rn").over(series) + 1, "first": F.min(F.when(F.col("fresh"), F.col("rn"))).over(series)}
    )
    scored = score_windows(context_features(chunked(counted, halo(params)[0])), params, gate=False)
    bars = recent_volatility(scored, params).where("owned")
    # A zone needs some bars ahead, so those of the last bars of the batch before may act only now.
    ahead = max(params.min_bars, 1) if params.lookforward >= params.min_bars else None
    fits = F.col("rn") >= F.col("first") - params.min_bars
    zone = F.when(fits & F.lit(ahead is not None), zone_column(params))
    upto = series.orderBy("rn").rowsBetween(W.unboundedPreceding, 1 - (ahead or 1))
    acting = bars.withColumn("_z", F.last(zone, ignorenulls=True).over(upto)).where("fresh")
    found = acting.join(known, "series_key", "left").withColumn("z", F.coalesce("_z", "known_zone"))
    p, d = against(F.col("z"), params)
    return found.select(
        "series_key",
        "ts",
        "rn",
        "n",
        F.when(F.col("scored"), F.col("score")).alias("score"),
        "divergence_signal",
        F.col("z.end").alias("zone_end"),
        p.alias("probability"),
        d.alias("direction"),
        "z",
    )


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_signals(bars: DataFrame, params: Params, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the live signals of a stream of closed bars to the Parquet table at path/signals."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        shape = "end: bigint, hold: bigint, hi: double, lo: double, vol: double, bias: double, signal: string, divergence: double, confidence: double"
        known = session.createDataFrame([], f"series_key string, known_zone struct<{shape}>")
        at, fs = _fs(session, f"{path}/zones/{number - 1}")
        if fs.exists(at):
            known = session.read.schema(known.schema).parquet(str(at))
        out = f"{path}/signals/batch={number}"
        live_signals(batch, known, params).write.mode("overwrite").parquet(out)
        told = session.read.parquet(out)
        last = told.where("rn = n - 1").select("series_key", F.col("z").alias("known_zone"))
        older = known.join(last, "series_key", "left_anti")
        older.unionByName(last).write.mode("overwrite").parquet(f"{path}/zones/{number}")
        old, fs = _fs(session, f"{path}/zones/{number - 2}")
        fs.delete(old, True)

    writer = tails(bars, params).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """What write_signals() has written so far."""
    return spark.read.option("basePath", f"{path}/signals").parquet(f"{path}/signals").drop("batch", "n", "z")
