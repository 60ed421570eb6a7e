"""Lines keep what a pixel can show; a page holds its brief and five panels."""

from __future__ import annotations

import random
import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR
from tidemark.functions.lineage import cut
from tidemark.operators import breakout, charts, detector, metrics, report
from tidemark.plans import queries


@pytest.mark.parametrize(("n", "pixels"), [(1, 10), (7, 10), (1_000, 10), (997, 64)])
def test_each_pixel_keeps_its_ends_and_extrema(spark, n, pixels):
    rng = random.Random(n)
    rows = [("a", i, n, i, float(rng.randint(-9, 9)) if rng.random() < 0.9 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, rn long, n long, ts long, v double")
    by_pixel: dict[int, list] = {}
    for _, rn, _, _, v in rows:
        if v is not None:
            by_pixel.setdefault(rn * pixels // n, []).append((rn, v))
    expected = set()
    for pixel, own in by_pixel.items():
        low, high = min(own, key=lambda r: (r[1], r[0])), min(own, key=lambda r: (-r[1], r[0]))
        expected |= {(pixel, *r) for r in (own[0], own[-1], low, high)}
    got = charts.downsampled(df.repartition(3), "v", pixels).collect()
    assert {(r["pixel"], r["rn"], r["value"]) for r in got} == expected and len(got) == len(expected)


def test_no_rows(spark):
    df = spark.createDataFrame([], "series_key string, rn long, n long, ts long, v double")
    assert charts.downsampled(df, "v").count() == 0
    for panel in (charts.line_panel("none", [], 0), charts.bar_panel("none", []), charts.heat_panel("none", [])):
        ElementTree.fromstring(panel)


def test_a_page_of_a_series(spark, tmp_path):
    params = queries.ACTIVE
    df = cut(queries.scored(spark, SMOKE_DIR, params, queries.MOVING))
    zones, told = detector.zones(df, params), breakout.signals(df, params)
    timed = report.timed_zones(zones, df.select("series_key", "rn", "ts"))
    facts = report.full_brief(
        report.latest_signal(told), report.zone_snapshot(timed, df), metrics.long_form(metrics.signal_metrics(told)), 0.0125
    )
    args = ("click", df, zones, told, report.heatmap(timed), report.component_table(zones, params), facts, 0.55)
    page = charts.write_dashboard(tmp_path / "page.html", *args).read_text()
    assert page == charts.dashboard(*args)  # the same page each time
    panels = [ElementTree.fromstring(x) for x in re.findall(r"<svg.*?</svg>", page)]
    assert len(panels) == 5 and "Better by 0.0125 Brier" in page and "click" in page
    line = next(x for x in panels[0].iter() if x.tag.endswith("polyline"))
    bars = df.where("series_key = 'click'").count()
    assert len(line.get("points").split()) <= min(4 * charts.WIDTH, bars)
    assert facts.where(F.col("headline").isNull() | F.col("summary").isNull()).count() == 0


def test_a_page_of_tables_says_where_it_stops(spark, tmp_path):
    page = report.write_page(tmp_path / "t.html", "t", {"few": spark.range(3), "many": spark.range(30)}, rows=10).read_text()
    assert page.count("The first 10 rows.") == 1
