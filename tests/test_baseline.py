"""The logistic baseline against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators.baseline import baseline

HORIZON, SPLIT = 5, 150


def plain(x, y, known):
    """Up-probabilities of all rows from a balanced, penalised regression on the known ones."""
    fill = np.nanmedian(x[known], axis=0)
    x = np.where(np.isnan(x), fill, x)
    mean, dev = x[known].mean(axis=0), x[known].std(axis=0)
    z = np.column_stack([(x - mean) / np.where(dev > 0, dev, 1), np.ones(len(x))])
    a, b = z[known], (y[known] == 1).astype(float)
    weight = len(b) / (2 * np.where(b == 1, b.sum(), len(b) - b.sum()))
    w, ridge = np.zeros(3), np.array([1.0, 1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w + np.linalg.solve(hess, a.T @ (weight * (b - p)) - ridge * w)
    return 1 / (1 + np.exp(-z @ w))


@pytest.mark.parametrize("one_class", [False, True])
def test_baseline_matches_numpy(spark, one_class):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (200, 2))
    y = np.where(x[:, 0] + rng.normal(0, 1, 200) > 0.4, 1, -1)
    y[::17] = 0
    if one_class:
        y = np.abs(y)
    x[::13, 1] = np.nan
    rows = [
        ("ALL", 0, i, i >= SPLIT, int(y[i]), float(x[i, 0]), None if np.isnan(x[i, 1]) else float(x[i, 1]))
        for i in range(200)
    ]
    dealt = spark.createDataFrame(rows, "origin string, fold int, rn long, validation boolean, target int, a double, b double")
    got = {r["rn"]: r for r in baseline(dealt, HORIZON, ("a", "b")).collect()}
    known = (np.arange(200) + HORIZON < SPLIT) & (y != 0)
    expected = np.ones(200) if one_class else plain(x, y, known)
    assert sorted(got) == list(range(SPLIT, 200))
    assert all(abs(got[i]["up_probability"] - expected[i]) < 1e-6 for i in got)
    assert all(got[i]["direction"] == (1 if expected[i] >= 0.5 else -1) for i in got)
