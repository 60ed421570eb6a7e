"""Centroid clustering against a plain version, on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SMOKE_DIR
from tidemark.llm import centroids

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, k=40, rounds=5, dim=64, seed=2):
    """Every vector against every centroid, in Python's own whole numbers."""
    fine = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    fine.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in fine[:k]]

    def assigned():
        out = []
        for _, v in fine:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle]
            out.append((gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        found = assigned()
        for c in range(len(middle)):
            own = [v for (_, v), (at, _) in zip(fine, found, strict=True) if at == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assigned()
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    inertia = [sum(d for c, d in found if c == j) for j in range(len(middle))]
    return [(i, c, d, inertia[c], sum(inertia), hashes[c]) for (i, _), (c, d) in zip(fine, found, strict=True)]


def same(df, expected):
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, expected))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    fine = [(i, rng.normal(0, 0.2, 64).tolist(), 1) for i in range(150)]
    fine += [(200, fine[0][1], 1)] * 40  # a vector that many rows repeat, under one id
    fine += [(None, fine[3][1], None), (7, fine[7][1], 1), (300, [0.0] * 64, 1), (301, [-300.25] * 64, 2)]
    broken = [
        (400, None, 1), (401, [], 1), (402, [1.0] * 63, 1), (403, [1.0] * 65, 1),
        (404, [None] + [1.0] * 63, 1), (405, [math.nan] + [1.0] * 63, 1), (406, [math.inf] + [1.0] * 63, 1),
    ]
    df = spark.createDataFrame([*fine, *broken], ROWS)
    clashing = {c: F.lit(-1) for c in ("cluster", "distance", "hash", "v", "n", "sums", "place")}
    rows = [(r[0], r["embedding"]) for r in df.collect()]
    same(centroids.clustered(df.withColumns(clashing).repartition(5)), plain(rows))


def test_ties_go_to_the_smaller_number(spark):
    """Whole vectors on a grid: many distances are equal, many centroids repeat."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-1, 2, 8) / 256).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    same(centroids.clustered(df, k=20, rounds=3, dim=8), plain([r[:2] for r in rows], 20, 3, 8))


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 100] * 64, 0) for i in range(3)]
    same(centroids.clustered(spark.createDataFrame(rows, ROWS)), plain([r[:2] for r in rows]))
    none = centroids.clustered(spark.createDataFrame([], ROWS))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_the_annulus_leaves_out_centroids_and_no_result(spark):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 4_000, 2_000)
    vectors = np.floor(rng.normal(0, 1, (2_000, 16)) * 10 + sizes[:, None]).astype(np.int64)
    middle = vectors[:200]
    cluster, distance, computed = centroids.nearest(vectors, middle)
    gaps = ((vectors[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
    assert (cluster == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
    assert computed < 0.2 * gaps.size


def test_components_beyond_exact_products_raise(spark):
    df = spark.createDataFrame([(i, [1e9] * 64, 0) for i in range(3)], ROWS)
    with pytest.raises(Exception, match="no exact 64-bit products"):
        centroids.clustered(df).collect()


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/embeddings.parquet")
    same(centroids.clustered(df), plain([(r["vec_id"], r["embedding"]) for r in df.collect()]))
