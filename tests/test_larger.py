"""Queries against their SQL on the largest tables, to every digit that they return: prices move over forty powers of ten there."""

from __future__ import annotations

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR, duck_rows, spark_rows
from tidemark.plans.queries import ORACLES, QUERIES, events
from tidemark.sources.bars import walk

LARGE_DIR = "/root/testdata/sf0.1"
NAMES = [
    "breakout_signals",
    "event_frame",
    "heatmap",
    "calibrated_signals",
    "component_table",
    "fold_signals",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle_to_every_digit(spark, name):
    names, ours = spark_rows(QUERIES[name](spark, LARGE_DIR))
    columns, theirs = duck_rows(ORACLES[name], LARGE_DIR)
    assert names == columns and len(ours) == len(theirs)
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not odd, f"{len(odd)} of {len(ours)} rows differ, first {odd[:2]} of {names}"


#: Queries on six times these events at the same times, where prices fall far below 1e-50.
SIXFOLD = ["calibrated_signals", "component_table", "fold_signals", "heatmap"]


@pytest.fixture(scope="module")
def sixfold_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sixfold")
    duckdb.sql(f"""COPY (SELECT e.* REPLACE (event_id + k * 100000 AS event_id)
  FROM '{LARGE_DIR}/events.parquet' e CROSS JOIN generate_series(0, 5) AS g(k)) TO '{folder}/events.parquet'""")
    return str(folder)


def in_units_of_the_window(query: str) -> str:
    """The same forecast by algebra; determinants of products of six prices are 0 below about 1e-50, these are not."""
    told, n = re.subn(r"covar_pop\(h\.(\w+), h\.(\w+)\)", r"covar_pop(h.\1 / r.span, h.\2 / r.span)", query)
    assert n and n % 9 == 0  # nine for each anchor
    return told


@pytest.mark.parametrize("name", SIXFOLD)
def test_small_prices_match_the_oracle_whose_determinants_do_not_underflow(spark, sixfold_dir, name):
    names, ours = spark_rows(QUERIES[name](spark, sixfold_dir))
    columns, theirs = duck_rows(in_units_of_the_window(ORACLES[name]), sixfold_dir)
    assert names == columns and len(ours) == len(theirs)
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not odd, f"{len(odd)} of {len(ours)} rows differ, first {odd[:2]} of {names}"


def test_walked_prices_are_right_to_the_last_digit(spark):
    told = walk(events(spark, SMOKE_DIR), "event_type").select("event_id", F.col("value").alias("price"))
    so_far: dict[str, float] = {}
    for r in events(spark, SMOKE_DIR).join(told, "event_id").orderBy("ts", "event_id").collect():
        so_far[r["event_type"]] = so_far.get(r["event_type"], 0.0) + (math.floor(r["value"] % 1 * 128) - 63.5) / 128
        assert r["price"] == 10 * math.exp(0.5 * so_far[r["event_type"]])
