"""Charts as SVG from tables that Spark has made small: at most four points for each pixel column.

A chart is drawn from what a few thousand pixels can show, whatever the number of
bars: each pixel column of a line keeps its first and last row and its extrema, so
the drawn line covers what all rows would cover.
"""

from __future__ import annotations

import html
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, MARGIN = 800, 160, 24
UP, DOWN, LINE, SHADE = "#2a7f62", "#b3423a", "#30506e", "#d9e2ec"


def downsampled(rows: DataFrame, column: str, pixels: int = WIDTH) -> DataFrame:
    """(series_key, pixel, rn, ts, value): of each pixel column the first, last, lowest and highest row, each once.

    rows: series_key, rn, n, ts and the column; rows without a value are left out.  Of equal values the first counts.
    """
    pixel = F.floor(F.col("rn") * pixels / F.col("n")).cast("int").alias("pixel")
    known = rows.where(F.col(column).isNotNull()).select("series_key", pixel, "rn", "ts", F.col(column).alias("value"))
    row = F.struct("rn", "ts", "value")
    kept = F.array_distinct(
        F.array(
            F.min_by(row, "rn"),
            F.max_by(row, "rn"),
            F.min_by(row, F.struct("value", "rn")),
            F.max_by(row, F.struct(F.col("value"), -F.col("rn"))),
        )
    )
    return known.groupBy("series_key", "pixel").agg(kept.alias("_k")).select("series_key", "pixel", F.inline("_k"))


def _scale(low: float, high: float, size: float):
    span = (high - low) or 1.0
    return lambda v: round(MARGIN + size - (v - low) / span * size, 1)


def line_panel(
    title: str, points: Iterable[tuple[float, float]], n: int, shades: Sequence[tuple[int, int]] = (), marks: Sequence[tuple] = ()
) -> str:
    """A line through (rn, value) of n rows, over shaded spans of rows, with marks (rn, value, direction)."""
    points = sorted(points)
    values = [v for _, v in points] or [0.0]
    low, high = min(values), max(values)
    y = _scale(low, high, HEIGHT)

    def x(rn: float) -> float:
        return round(MARGIN + rn * WIDTH / max(n, 1), 1)

    body = [f'<rect x="{x(a)}" y="{MARGIN}" width="{max(round(x(b + 1) - x(a), 1), 0.5)}" height="{HEIGHT}" fill="{SHADE}"/>' for a, b in shades]
    body.append(f'<polyline fill="none" stroke="{LINE}" points="{" ".join(f"{x(rn)},{y(v)}" for rn, v in points)}"/>')
    body += [f'<circle cx="{x(rn)}" cy="{y(v)}" r="3" fill="{UP if d > 0 else DOWN}"/>' for rn, v, d in marks]
    return _panel(title, body, f"{low:.4g} to {high:.4g}")


def bar_panel(title: str, bars: Sequence[tuple[str, float]]) -> str:
    """A bar for each (name, value)."""
    most = max([abs(v) for _, v in bars] or [1.0]) or 1.0
    step = WIDTH / max(len(bars), 1)
    body = []
    for i, (name, v) in enumerate(bars):
        tall = round(abs(v) / most * (HEIGHT - MARGIN), 1)
        left = round(MARGIN + i * step, 1)
        body.append(f'<rect x="{left}" y="{round(HEIGHT - tall, 1)}" width="{round(step * 0.8, 1)}" height="{tall}" fill="{UP if v >= 0 else DOWN}"/>')
        body.append(f'<text x="{left}" y="{HEIGHT + MARGIN}">{html.escape(name)} {v:.3g}</text>')
    return _panel(title, body)


def heat_panel(title: str, cells: Sequence[tuple[str, int, float]]) -> str:
    """A square for each (day, hour, value from 0 to 1), days from top to bottom."""
    days = sorted({d for d, _, _ in cells})
    tall, wide = HEIGHT / max(len(days), 1), WIDTH / 24
    body = [
        f'<rect x="{round(MARGIN + hour * wide, 1)}" y="{round(MARGIN + days.index(day) * tall, 1)}" width="{round(wide, 1)}" height="{round(tall, 1)}" '
        f'fill="{LINE}" fill-opacity="{min(max(v, 0.0), 1.0):.3f}"/>'
        for day, hour, v in sorted(cells)
    ]
    return _panel(title, body, f"{days[0]} to {days[-1]}" if days else "none")


def _panel(title: str, body: Sequence[str], note: str = "") -> str:
    size = f"0 0 {WIDTH + 2 * MARGIN} {HEIGHT + 2 * MARGIN}"
    head = f'<text x="{MARGIN}" y="16">{html.escape(title)}{f" ({html.escape(note)})" if note else ""}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{size}" font-size="11">{head}{"".join(body)}</svg>'


def dashboard(series: str, scored: DataFrame, zones: DataFrame, told: DataFrame, heat: DataFrame, components: DataFrame, brief: DataFrame, shown: float) -> str:
    """The page of one series: its brief, and panels of price, score, probability, hours and components.

    scored: scored windows; zones, told: of the same run; heat, components, brief: report tables.
    """
    of = F.col("series_key") == series
    one = scored.where(of)
    n = (one.agg(F.max("n").alias("n")).first()["n"] or 0) if one.columns else 0
    # Zones of neighbouring rows overlap: of each pixel column the first and last row that any covers are drawn.
    at = F.floor(F.col("end_idx") * WIDTH / max(n, 1))
    spans = zones.where(of).groupBy(at.alias("pixel")).agg(F.min("start_idx").alias("a"), F.max("end_idx").alias("b"))
    shades = sorted((r["a"], r["b"]) for r in spans.collect())

    def line(rows: DataFrame, column: str) -> list[tuple]:
        return [(r["rn"], r["value"]) for r in downsampled(rows, column).collect()]

    signals = told.where(of)
    strong = signals.where((F.col("direction") != 0) & (F.col("probability") >= shown))
    best = strong.groupBy(F.floor(F.col("rn") * WIDTH / max(n, 1)).alias("pixel")).agg(
        F.max_by(F.struct("rn", "close", "direction"), F.struct("probability", "rn")).alias("m")
    )
    marks = sorted((r["m"]["rn"], r["m"]["close"], r["m"]["direction"]) for r in best.collect())
    panels = [
        line_panel("Price, zones and breakouts", line(one, "close"), n, shades, marks),
        line_panel("Consolidation score", line(one.where("scored"), "score"), n),
        line_panel("Breakout probability", line(signals, "probability"), n),
        heat_panel("Mean score by hour", [(str(r["day"]), r["hour"], r["mean_score"]) for r in heat.where(of).orderBy(F.desc("day")).limit(60 * 24).collect()]),
        bar_panel("Components", [(r["component"], r["contribution"]) for r in components.where(of).orderBy("component").collect()]),
    ]
    facts = brief.where(of).drop("series_key").first()
    rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in (facts.asDict() if facts else {}).items())
    title = html.escape(f"Consolidation of {series}")
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><table>{rows}</table>{''.join(panels)}"


def write_dashboard(path: str | Path, *args, **kwargs) -> Path:
    """dashboard() as a file."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(dashboard(*args, **kwargs), encoding="utf-8")
    return out
