"""Report tables: what a dashboard shows, as small DataFrames, and a static page of them."""

from __future__ import annotations

import html
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.frames import lag
from tidemark.functions.quantiles import quantiles
from tidemark.plans.params import COMPONENTS, DISPLAY_THRESHOLD, Params
from tidemark.sources.bars import chunked, owned

FOLLOW_BARS = 60
logger = logging.getLogger("tidemark")


def timed_zones(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """Zones with the times of their first and last bar."""
    first = bars.select("series_key", F.col("rn").alias("start_idx"), F.col("ts").alias("timestamp_start"))
    last = bars.select("series_key", F.col("rn").alias("end_idx"), F.col("ts").alias("timestamp_end"))
    return zones.join(first, ["series_key", "start_idx"]).join(last, ["series_key", "end_idx"])


def plot_window(bars: DataFrame, days: int, tail: int = 500) -> DataFrame:
    """Bars of the last days of each series; its last `tail` bars if those are too few to show."""
    last = bars.groupBy("series_key").agg(F.max("ts").alias("_last"))
    cut = F.col("_last") - F.expr(f"INTERVAL {int(days)} DAYS")
    marked = bars.join(last, "series_key").withColumn("_in", F.col("ts") >= cut)
    counts = marked.where("_in").groupBy("series_key").agg(F.count("*").alias("_k"))
    return (
        marked.join(counts, "series_key")
        .where(F.when(F.col("_k") >= 2, F.col("_in")).otherwise(F.col("rn") >= F.col("n") - tail))
        .drop("_last", "_in", "_k")
    )


def recent_zones(timed: DataFrame, since, limit: int) -> DataFrame:
    """The last `limit` zones of each series that reach beyond a time."""
    last = W.partitionBy("series_key").orderBy(F.desc("end_idx"))
    return (
        timed.where(F.col("timestamp_end") >= since)
        .withColumn("_k", F.row_number().over(last))
        .where(F.col("_k") <= limit)
        .drop("_k")
    )


def heatmap(timed: DataFrame) -> DataFrame:
    """Mean score of the zones that end in each hour of each day."""
    return timed.groupBy(
        "series_key", F.to_date("timestamp_end").alias("day"), F.hour("timestamp_end").alias("hour")
    ).agg(F.avg("consolidation_score").alias("mean_score"), F.count("*").alias("zones"))


def heatmap_wide(timed: DataFrame) -> DataFrame:
    """heatmap() with a column for each hour; null where no zone ends."""
    return heatmap(timed).groupBy("series_key", "day").pivot("hour", list(range(24))).agg(F.first("mean_score"))


def event_frame(timed: DataFrame) -> DataFrame:
    """One row for each end time: score and components of the zone detected last."""
    columns = (
        "consolidation_score",
        "attention_context_score",
        "periodic_context_score",
        "scale_anchor_score",
        "sutte_score",
        "interaction_score",
    )
    last = F.max_by(F.struct(*columns), "end_idx").alias("z")
    return timed.groupBy("series_key", "timestamp_end").agg(last).select("series_key", "timestamp_end", "z.*")


def latest_signal(told: DataFrame, threshold: float = DISPLAY_THRESHOLD) -> DataFrame:
    """Counts of signals above and below the display threshold and the latest of each."""
    d, p = F.col("direction"), F.col("probability")
    active = (d != 0) & (p >= threshold)

    def of(x, ok):
        return F.max_by(F.when(ok, x), F.when(ok, F.col("rn")))

    out = told.groupBy("series_key").agg(
        F.count_if(active & (d == 1)).alias("active_up_count"),
        F.count_if(active & (d == -1)).alias("active_down_count"),
        F.count_if(d == 1).alias("raw_up_count"),
        F.count_if(d == -1).alias("raw_down_count"),
        of(d, active).alias("_d"),
        of(p, active).alias("_p"),
        of(F.col("ts"), active).alias("_t"),
        F.coalesce(of(d, d != 0), F.lit(0)).alias("latest_raw_direction"),
        F.coalesce(of(p, d != 0), F.lit(0.0)).alias("latest_raw_probability"),
        of(F.col("ts"), d != 0).alias("latest_raw_ts"),
    )
    seen = F.when(F.col("_d").isNotNull(), "active").when(F.col("latest_raw_direction") != 0, "subthreshold")
    return out.select(
        "series_key",
        seen.otherwise("none").alias("visibility"),
        F.coalesce("_d", F.lit(0)).alias("direction"),
        F.coalesce("_p", F.lit(0.0)).alias("probability"),
        F.col("_t").alias("signal_ts"),
        "active_up_count",
        "active_down_count",
        "raw_up_count",
        "raw_down_count",
        "latest_raw_direction",
        "latest_raw_probability",
        "latest_raw_ts",
    )


#: Columns of zones that a snapshot reads; the times may be missing.
SNAPSHOT = ("start_idx", "end_idx", "duration", "consolidation_score", "timestamp_start", "timestamp_end")


def zone_snapshot(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """The last zone of each series, its window in words, how many bars follow it and how mature that makes it."""
    sizes = bars.groupBy("series_key").agg(F.count("*").alias("n"))
    last = zones.groupBy("series_key").agg(
        F.max_by(F.struct(*[c for c in SNAPSHOT if c in zones.columns]), "end_idx").alias("z")
    )
    window = F.lit("No completed accepted window")
    if "timestamp_end" in zones.columns:
        start, end = (F.date_format(f"z.timestamp_{x}", "yyyy-MM-dd HH:mm") for x in ("start", "end"))
        window = F.coalesce(F.concat(start, F.lit(" to "), end), window)
    after = F.greatest(F.col("n") - F.col("z.end_idx") - 1, F.lit(0))
    return sizes.join(last, "series_key", "left").select(
        "series_key",
        F.when(F.col("z").isNotNull(), "yes").otherwise("no").alias("available"),
        F.coalesce("z.duration", F.lit(0)).alias("duration"),
        F.coalesce(after, F.lit(0)).alias("post_bars"),
        F.coalesce("z.consolidation_score", F.lit(0.0)).alias("score"),
        F.when(F.col("z").isNull(), "None")
        .when(after >= 8, "Developed")
        .when(after >= 4, "Forming")
        .when(after >= 1, "Early")
        .otherwise("Unconfirmed")
        .alias("maturity"),
        window.alias("window"),
    )


def brief(signal: DataFrame, zone: DataFrame) -> DataFrame:
    """The state of each series in words, from latest_signal() and zone_snapshot()."""
    up, raw = F.col("direction") > 0, F.col("latest_raw_direction")
    none = F.col("available") == "no"
    active, below = F.col("visibility") == "active", F.col("visibility") == "subthreshold"
    inside = F.col("post_bars") == 0
    lean = F.when(raw > 0, "Up lean").when(raw < 0, "Down lean").otherwise("Undecided")
    return signal.join(zone, "series_key").select(
        "series_key",
        F.when(none, "No active setup")
        .when(active, F.when(up, "Breaking up").otherwise("Breaking down"))
        .when(inside, "Still consolidating")
        .when(below, "Waiting for confirmation")
        .otherwise("Recent zone, no trigger")
        .alias("setup_state"),
        F.when(none, "neutral")
        .when(active, F.when(up, "support").otherwise("risk"))
        .when(inside | below, "watch")
        .otherwise("neutral")
        .alias("stance_tone"),
        F.when(none, "No zone")
        .when(active, "Confirmed")
        .when(inside, "Inside zone")
        .when(below, "Below trigger")
        .otherwise("No trigger")
        .alias("trust_label"),
        F.when(none, "No").when(active | inside, "Yes").otherwise("Recent").alias("consolidation_answer"),
        F.when(none, "None")
        .when(active, F.when(up, "Up").otherwise("Down"))
        .when(inside | below, lean)
        .otherwise("None")
        .alias("breakout_side"),
        "maturity",
        "post_bars",
    )


#: What the brief says in each state of a series.
HEADLINES = {
    "none": "No accepted consolidation is active right now.",
    "active": "Yes. The latest accepted consolidation is breaking {side}.",
    "inside": "Yes. Price is still inside the latest accepted consolidation.",
    "below": "The latest consolidation has ended, but the breakout is not confirmed above {threshold}.",
    "quiet": "A recent consolidation exists, but there is no current breakout signal.",
}
SUMMARIES = {
    "none": "The detector does not currently have a live zone to trade from.",
    "active": "Confirmed {label} at {p} on {time}. Price has moved beyond the latest accepted zone.",
    "inside": "The current raw lean is {raw_label} at {raw_p}, but it is still below the {threshold} confirmation threshold.",
    "inside_quiet": "No directional breakout signal is active yet.",
    "below": "The latest raw signal is {raw_label} at {raw_p} on {raw_time}.",
    "quiet": "The model has no active directional read from the latest accepted zone.",
}
LABELS = {1: "up breakout", -1: "down breakout"}
VERDICTS = {1: "Better by {gain} Brier", -1: "Worse by {gain} Brier", 0: "Tied on Brier", None: "Unavailable"}


def _filled(template: str, **parts: Column) -> Column:
    """The text with columns in its braces."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text), parts[name]]
    return F.concat(*out, F.lit(rest))


def full_brief(signal: DataFrame, zone: DataFrame, metrics: DataFrame, improvement: float | None = None) -> DataFrame:
    """brief() with its sentences and the rows of its summary, one column each.

    metrics: (series_key, metric, value) of run_metrics(); improvement: how much lower the Brier score is than the
    baseline's, if that was measured.
    """
    state = brief(signal, zone)
    sharpe = metrics.where("metric = 'simulated_sharpe'").select("series_key", F.col("value").alias("_sharpe"))
    told = (
        state.join(signal, "series_key")
        .join(zone.select("series_key", "available", "duration", "score", "window"), "series_key")
        .join(sharpe, "series_key", "left")
    )
    raw = F.col("latest_raw_direction") != 0
    none, active = F.col("available") == "no", F.col("visibility") == "active"
    inside, below = F.col("post_bars") == 0, F.col("visibility") == "subthreshold"
    threshold = F.format_string("%.0f%%", F.lit(DISPLAY_THRESHOLD * 100))

    def label(direction: Column) -> Column:
        return F.when(direction > 0, LABELS[1]).otherwise(LABELS[-1])

    parts = {
        "side": F.when(F.col("direction") > 0, "up").otherwise("down"),
        "threshold": threshold,
        "label": label(F.col("direction")),
        "p": F.format_string("%.1f%%", F.col("probability") * 100),
        "time": F.date_format("signal_ts", "yyyy-MM-dd HH:mm"),
        "raw_label": label(F.col("latest_raw_direction")),
        "raw_p": F.format_string("%.1f%%", F.col("latest_raw_probability") * 100),
        "raw_time": F.date_format("latest_raw_ts", "yyyy-MM-dd HH:mm"),
    }

    def by_state(of: dict, quiet_inside: str) -> Column:
        lines = {k: _filled(v, **parts) for k, v in of.items()}
        still = F.when(raw, lines["inside"]).otherwise(lines[quiet_inside])
        return F.when(none, lines["none"]).when(active, lines["active"]).when(inside, still).when(below, lines["below"]).otherwise(lines["quiet"])

    lean = F.when(raw & (inside | below), F.concat(parts["raw_p"], F.lit(" raw")))
    seen = F.when(raw & (inside | below), parts["raw_time"])
    missing = F.lit("n/a")
    sign = None if improvement is None else (improvement > 0) - (improvement < 0)
    verdict = VERDICTS[sign].format(gain=f"{abs(improvement or 0):.4f}")
    return told.select(
        *state.columns,
        by_state(HEADLINES, "inside").alias("headline"),
        by_state(SUMMARIES, "inside_quiet").alias("summary"),
        F.when(none, missing).when(active, parts["p"]).otherwise(F.coalesce(lean, missing)).alias("confidence_label"),
        F.when(none, missing).when(active, parts["time"]).otherwise(F.coalesce(seen, missing)).alias("latest_signal_time"),
        F.when(none, missing).otherwise(F.format_string("%.3f", "score")).alias("zone_score"),
        F.when(none, missing).otherwise(F.format_string("%d bars", "duration")).alias("zone_duration"),
        F.when(none, missing).otherwise(F.col("post_bars").cast("string")).alias("post_zone_bars"),
        F.concat_ws(" / ", "active_up_count", "active_down_count").alias("active_breakout_mix"),
        F.concat_ws(" / ", "raw_up_count", "raw_down_count").alias("raw_breakout_mix"),
        threshold.alias("display_threshold"),
        F.format_string("%.2f", F.coalesce("_sharpe", F.lit(0.0))).alias("simulated_sharpe"),
        F.lit(verdict).alias("benchmark_verdict"),
        F.col("window").alias("latest_zone_window"),
    )


def component_table(zones: DataFrame, params: Params) -> DataFrame:
    """Mean of each component over the zones, its weight and its part in the score."""
    columns = {
        "contraction": 1 - F.least(F.col("volatility_ratio"), F.lit(1.0)),
        "position": F.col("mean_reversion_strength"),
        "attention": F.col("attention_context_score"),
        "periodic": F.col("periodic_context_score"),
        "scale": F.col("scale_anchor_score"),
        "sutte": F.col("sutte_score"),
    }
    means = zones.groupBy("series_key").agg(*[F.avg(c).alias(k) for k, c in columns.items()])
    weights = F.create_map(*[F.lit(x) for c in COMPONENTS for x in (c, params.weight(c))])
    told = means.unpivot(["series_key"], list(columns), "component", "mean")
    weight = F.element_at(weights, F.col("component"))
    return told.select(
        "series_key", "component", "mean", weight.alias("weight"), (F.col("mean") * weight * 100).alias("contribution")
    )


def bar_spacing(bars: DataFrame) -> DataFrame:
    """Width of a drawn bar in milliseconds: four fifths of the median spacing."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lag("ts").cast("timestamp"))
    gaps = owned(chunked(bars, before=1).withColumn("gap", gap / 1000))
    return quantiles(gaps, ["series_key"], "gap", (0.5,)).select(
        "series_key", (F.get("quantiles", F.lit(0)) * 0.8).alias("bar_width_ms")
    )


def forecast_payload(live: DataFrame, breakout: DataFrame, regime: DataFrame, params: Params) -> DataFrame:
    """(series_key, payload): the forecast of each series' last bar as JSON, nulls kept.

    A series consolidates if its live score exceeds the threshold. The interval
    is the probability alone and outcomes of similar setups are left empty, as
    nothing measures them.
    """
    rows = live.join(breakout, "series_key", "left").join(regime, "series_key", "left")
    on = F.col("score") > params.threshold
    p = F.coalesce("probability", F.lit(0.0))
    side = F.when(F.col("direction") > 0, "up").when(F.col("direction") < 0, "down").otherwise("none")
    width = F.col("zone_high") - F.col("zone_low")
    shift = F.coalesce(F.col("regime_shift_flag") == 1, F.lit(False))
    payload = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("now"),
        F.struct(
            on.alias("active"),
            F.col("score"),
            F.array("zone_low", "zone_high").alias("zone"),
            (F.col("rn") - 1 - F.coalesce("zone_end", F.lit(-1))).alias("bars_since_last"),
            F.try_divide(F.col("close") - F.col("zone_low"), width).alias("position_in_zone"),
        ).alias("consolidation"),
        F.when(
            on,
            F.struct(
                side.alias("direction"),
                p.alias("probability"),
                F.lit(params.max_hold).alias("horizon_bars"),
                F.array(p, p).alias("confidence_interval"),
                F.lit("breakout").alias("source"),
            ),
        ).alias("forecast"),
        F.when(shift, F.array(F.lit("volatility regime shift"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.struct(
            shift.alias("regime_shift_detected"),
            F.when(p >= DISPLAY_THRESHOLD, "high").when(p > 0, "low").otherwise("none").alias("model_confidence"),
            F.lit(0).alias("similar_historical_setups"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("similar_outcomes"),
        ).alias("context"),
    )
    return rows.select("series_key", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def follow_through(zones: DataFrame, bars: DataFrame, told: DataFrame, ahead: int | None = FOLLOW_BARS) -> DataFrame:
    """The bars around the last zone of each series that a chart of what followed it shows.

    They begin one length of the zone before it and end `ahead` bars after it (None: at the end
    of the series); bars without a positive close are left out.  part is history or after; a
    marker (1 or -1) stands on later bars whose signal is shown.
    """
    last = zones.groupBy("series_key").agg(F.max_by(F.struct("start_idx", "end_idx", "duration"), "end_idx").alias("z"))
    near = bars.join(last, "series_key").where(
        (F.col("rn") >= F.col("z.start_idx") - F.col("z.duration")) & (F.col("close") > 0)
    )
    if ahead is not None:
        near = near.where(F.col("rn") <= F.col("z.end_idx") + max(1, ahead))
    # Few rows of a series are near its last zone, unless all bars after it are asked for.
    inside = F.col("rn").between(F.col("z.start_idx"), F.col("z.end_idx"))
    levels = near.groupBy("series_key").agg(
        F.max(F.when(inside, F.col("high"))).alias("resistance"), F.min(F.when(inside, F.col("low"))).alias("support")
    )
    later = F.col("rn") > F.col("z.end_idx")
    shown = later & (F.col("probability") >= DISPLAY_THRESHOLD) & (F.col("direction") != 0)
    signals = told.select("series_key", "rn", "probability", "direction")
    return (
        near.join(levels, "series_key")
        .join(signals, ["series_key", "rn"], "left")
        .select(
            "series_key",
            "ts",
            "rn",
            F.when(later, "after").otherwise("history").alias("part"),
            "close",
            "resistance",
            "support",
            ((F.col("resistance") + F.col("support")) / 2).alias("midline"),
            F.when(shown, F.col("direction")).alias("marker"),
            F.when(shown, F.col("probability")).alias("marker_probability"),
        )
    )


def log_metrics(told: DataFrame, level: int = logging.INFO) -> int:
    """Writes metrics (series_key, metric, value) to the log, in order; how many there were."""
    n = 0
    for r in told.orderBy("series_key", "metric").toLocalIterator():
        logger.log(level, "%s %s %s", r["series_key"], r["metric"], "none" if r["value"] is None else f"{r['value']:.4f}")
        n += 1
    return n


def write_page(path: str | Path, title: str, tables: dict[str, DataFrame], rows: int = 200) -> Path:
    """A static page of small tables, `rows` rows of each at most; the page says where a table has more."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        shown = df.limit(rows + 1).toPandas()
        more = f"<p>The first {rows} rows.</p>" if len(shown) > rows else ""
        parts.append(f"<h2>{html.escape(name)}</h2>" + shown.head(rows).to_html(index=False) + more)
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(parts), encoding="utf-8")
    return out


def span_label(seconds: float) -> str:
    """A span of time in its two greatest units, such as '2d 3h'."""
    left, parts = int(seconds // 60), []
    for size, unit in ((1440, "d"), (60, "h"), (1, "m")):
        n, left = divmod(left, size)
        if n:
            parts.append(f"{n}{unit}")
    return " ".join(parts[:2]) or "0m"
