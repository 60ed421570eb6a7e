"""OHLC bars of an event stream, and live scores of the bars so far.

Bars are a windowed aggregation behind a watermark: the state holds one row for
each open (series, window), so it is bounded by the delay allowed to events and
never by the length of the stream.  Closed bars are appended to a table; each
micro-batch then scores the latest window of every series from the bars that a
window can reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.bars import bars_from_events

DELAY = "10 minutes"


def stream_bars(events: DataFrame, width: str = "1 hour", key: str | None = None, delay: str = DELAY) -> DataFrame:
    """Bars of a stream of (event_id, ts, value); events later than the delay are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return bars_from_events(timed, width, key)


def write_bars(bars: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed bars to a Parquet table; a restart goes on from the checkpoint, exactly once."""
    writer = bars.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_each_batch(
    bars: DataFrame, score: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Call score(closed bars of the batch, batch number) for every micro-batch."""
    writer = bars.writeStream.outputMode("append").foreachBatch(score)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
