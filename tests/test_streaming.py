"""Bars of a stream are those of the batch, whatever the order of files, but for events that are too late."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR
from tidemark.operators.breakout import latest_breakouts
from tidemark.operators.detector import live_window
from tidemark.operators.features import context_features
from tidemark.plans.queries import ACTIVE
from tidemark.sources.bars import bars_from_events, chunked, halo, numbered
from tidemark.streaming.bars import score_each_batch, stream_bars, write_bars
from tidemark.streaming.signals import read_signals, write_signals

COLUMNS = ["series_key", "ts", "open", "high", "low", "close", "n_events"]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def in_days(events, path: str) -> None:
    """One file for each day, in order, so that each is a micro-batch."""
    days = [r["day"] for r in events.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]
    for day in days[:8]:
        events.where(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(path)


def as_set(df):
    return {tuple(r) for r in df.select(COLUMNS).collect()}


@pytest.mark.parametrize("key", [None, "event_type"])
def test_closed_bars_match_the_batch(spark, events, tmp_path, key):
    source = str(tmp_path / "events")
    in_days(events, source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "bars")
    query = write_bars(stream_bars(stream, "1 hour", key), out, str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(120)
    got = as_set(spark.read.parquet(out))
    whole = as_set(bars_from_events(spark.read.parquet(source), "1 hour", key))
    last = max(b[1] for b in whole)
    assert got <= whole
    assert {b for b in whole if b[1] < last} <= got | {b for b in whole if b[1].date() == last.date()}


def test_each_batch_is_scored_once(spark, events, tmp_path):
    source, seen = str(tmp_path / "events"), []
    in_days(events, source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = score_each_batch(
        stream_bars(stream), lambda bars, k: seen.extend(r["ts"] for r in bars.collect()), str(tmp_path / "c"), once=True
    )
    query.awaitTermination(120)
    assert seen and len(seen) == len(set(seen))


def test_live_signals_are_those_of_the_batch_at_every_bar(spark, events, tmp_path):
    """The stream is stopped and started again with each third of the days; its state goes on."""
    days = [r["day"] for r in events.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]
    source, out, checkpoint = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    for k in range(3):
        events.where(F.to_date("ts").isin(days[k * len(days) // 3 : (k + 1) * len(days) // 3])).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        query = write_signals(stream_bars(stream, "3 hours", "event_type"), ACTIVE, out, checkpoint, once=True)
        query.awaitTermination(300)
    told = read_signals(spark, out).persist()
    assert told.count() == told.select("series_key", "rn").distinct().count() > 500
    assert told.where("zone_end IS NOT NULL").count() > 100 and told.where("direction <> 0").count() > 5
    bars = numbered(bars_from_events(events, "3 hours", "event_type")).persist()
    for rn in (2, 17, 63, 101, 140):
        so_far = bars.where(F.col("rn") <= rn).withColumn("n", F.least("n", F.lit(rn + 1)))
        live = live_window(context_features(chunked(so_far, *halo(ACTIVE))), ACTIVE)
        expected = {r["series_key"]: (r["score"], r["divergence_signal"]) for r in live.where(f"rn = {rn}").collect()}
        got = told.where(f"rn = {rn} AND score IS NOT NULL").collect()
        assert {r["series_key"]: (pytest.approx(r["score"], abs=1e-9), r["divergence_signal"]) for r in got} == expected
        last = [r for r in latest_breakouts(so_far, ACTIVE).collect() if r["rn"] == rn]
        expected = {r["series_key"]: (r["zone_end"], r["probability"], r["direction"]) for r in last}
        got = told.where(f"rn = {rn} AND zone_end IS NOT NULL").collect()
        assert {r["series_key"]: (r["zone_end"], pytest.approx(r["probability"], abs=1e-9), r["direction"]) for r in got} == expected
    told.unpersist()
    bars.unpersist()
