"""Every link of fingerprints within the radius is found: all pairs of a larger table, and hot fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.compare import SF_DIR
from tests.llm.test_operators import table
from tidemark.llm import common, simhash


def least_reachable(ids: np.ndarray, prints: np.ndarray) -> dict[int, int]:
    """The least id reachable from each row, by comparing all pairs of rows."""
    group = np.arange(len(ids))
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= simhash.RADIUS)
        joined = np.unique(group[near])
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    return {int(d): int(ids[group == g].min()) for d, g in zip(ids, group, strict=True)}


def test_all_pairs_of_ten_thousand_documents(spark):
    rows = simhash.near_duplicates(table(spark, "documents", SF_DIR.replace("0.01", "0.1"))).collect()
    ids, prints = np.array([r["doc_id"] for r in rows]), np.array([r["fp"] for r in rows])
    expected = least_reachable(ids, prints)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert sum(c != d for d, c in expected.items()) > 100


def test_a_third_of_all_rows_in_one_group(spark, monkeypatch):
    """A hot fingerprint and a component with very many links are dealt out and lose nothing."""
    monkeypatch.setattr(common, "LEAST_SLICE", 20)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, "" if i % 3 == 0 else " ".join(words[i % 7 :]) if i % 3 == 1 else f"own {i} text {i * i} here") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(docs).withColumn("blank", F.col("fp") == 0).collect()
    ids, prints = np.array([r["doc_id"] for r in got]), np.array([r["fp"] for r in got])
    assert len(got) == 1_500 and {r["doc_id"]: r["component_id"] for r in got} == least_reachable(ids, prints)
    assert all(r["component_id"] == 0 for r in got if r["blank"])
