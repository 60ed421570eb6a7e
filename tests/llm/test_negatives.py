"""Hard negatives against a plain version, on ties, repeated rows and many blocks and digits."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, wanted=10, low=30, high=90):
    """Every anchor against every row, sorted in Python."""
    fine = [
        (i, [math.floor(256 * float(x)) for x in v], y)
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, vector, label) in enumerate(fine):
        if anchor is None or anchor % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v, strict=False)), i is None, i or 0, i, y)
            for b, (i, v, y) in enumerate(fine)
            if b != a
        ]
        scored.sort(key=lambda r: r[:3])
        for p, _, _, positive, _ in [r for r in scored if r[4] == label][:positives]:
            fit = [r for r in scored if r[4] != label and low * -p <= 100 * -r[0] <= high * -p]
            out += [(anchor, positive, k, r[3], -p, -r[0]) for k, r in enumerate(fit[:wanted], 1)]
    return out


def same(df, expected):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, expected))
    assert expected


def made(n, dim, spread, seed, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(-spread, spread + 1, dim) / 256).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def narrow(monkeypatch):
    """Few rows at a time and small digits: many batches and passes."""
    monkeypatch.setattr(negatives, "DIGIT", 3)
    monkeypatch.setattr(negatives, "ROWS", 7)


@pytest.mark.parametrize(("spread", "block"), [(1, 1_024), (60, 4)])
def test_ties_and_blocks(spark, narrow, spread, block):
    """Scores of a few values tie at every place; scores of many need several digits."""
    rows = made(260, 6, spread, spread)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    same(negatives.hard_negatives(df, every=20, block=block), plain(rows, every=20))


def test_odd_rows(spark, narrow):
    rows = made(90, 5, 20, 9)
    hot = (20, [0.2, 0.1, 0.0, 0.1, 0.2], 1)
    rows += [hot] * 60 + [(41, hot[1], 2)] * 60  # anchors and negatives that repeat
    rows += [
        (100, None, 1), (120, [0.1] * 5, None), (140, [None] * 5, 1), (160, [math.nan] * 5, 1), (180, [math.inf] * 5, 1),
        (None, [0.2, 0.1, 0.0, 0.1, 0.3], 1), (None, [0.1, 0.1, 0.0, 0.1, 0.1], 2), (200, [], 1), (220, [0.1, 0.2], 1),
        (240, [0.1] * 5, 77), (260, [-0.1] * 5, 1), (280, [0.1] * 9, 2), (-20, [0.1] * 5, 0), (300, [0.0] * 5, 0),
    ]
    clashing = {c: F.lit(-1) for c in ("window", "digit", "score", "copies", "hash", "rank", "place")}
    df = spark.createDataFrame(rows, ROWS).withColumns(clashing).repartition(4)
    same(negatives.hard_negatives(df, every=20, block=3), plain(rows, every=20))


def test_no_rows_and_no_anchors(spark):
    for rows in ([], [(1, [0.1, 0.2], 1), (2, [0.1, 0.2], 2)], [(100, [0.1, 0.2], 1)], [(None, None, None)]):
        found = negatives.hard_negatives(spark.createDataFrame(rows, ROWS))
        assert found.count() == 0 and found.columns[0] == "anchor_id"


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 64) * 400_000).clip(-5e5, 5e5).astype(np.float32).tolist(), i % 2) for i in range(40)]
    same(negatives.hard_negatives(spark.createDataFrame(rows, ROWS), every=10), plain(rows, every=10))


def test_a_window_sends_no_more_counts_than_it_wants_rows(spark):
    rows = made(4_000, 8, 60, 4, labels=2)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    vectors = np.array([[math.floor(256 * np.float32(x)) for x in rows[0][1]]])
    anchors = negatives.Anchors([0], np.array([rows[0][2]]), vectors, [1])
    one = negatives.Windows(False, np.array([[40_000]]), np.array([[80_001]]), np.array([[10]]))
    counts = negatives.counted(df.select("vec_id", F.col("label").cast("long"), "embedding"), anchors, one, 0)
    assert 10 <= counts.agg(F.sum("n")).first()[0] and counts.count() <= 30
