"""Centres, scales and likeness of histories against numpy's own medians and quantiles."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import context
from tidemark.plans.params import CONTEXT_CLIP, EPSILON, IQR_TO_STD, MAD_TO_STD


def plain_scale(values: np.ndarray) -> tuple[float, float]:
    x = values[~np.isnan(values)]
    if not len(x):
        return 0.0, 1.0
    q1, centre, q3 = np.percentile(x, (25, 50, 75))
    scale = max((q3 - q1) / IQR_TO_STD, MAD_TO_STD * np.median(np.abs(x - centre)))
    if scale > EPSILON:
        return centre, scale
    return centre, x.std() if x.std() > EPSILON else 1.0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 40, 161, 400])
def test_scales_of_histories_with_gaps_ties_and_constants(size):
    rng = np.random.default_rng(size)
    histories = rng.normal(0, 1, (6, 30, size))
    histories[1] = np.round(histories[1])
    histories[2] = 0.25
    histories[3, :, 1:] = 0.25  # one value alone differs
    histories[4][rng.random((30, size)) < 0.4] = np.nan
    histories[5, :10] = np.nan
    centre, scale = context.robust_scale(histories)
    for c in range(6):
        for r in range(30):
            assert (centre[c, r], scale[c, r]) == pytest.approx(plain_scale(histories[c, r]), abs=1e-12)


def test_scores_take_the_oldest_of_ties():
    rng = np.random.default_rng(2)
    history = np.round(rng.normal(0, 1, (3, 20, 50)), 1)
    history[2] = np.nan
    signature = rng.random((20, 50))
    signature[:5, :30] = np.nan
    reference = np.round(rng.normal(0, 1, (3, 20)), 1)
    weights = np.array([1.0, 0.5, 2.0])
    (got,) = context.match_scores(history, signature, reference, [(weights, 6, 0.3)])
    for r in range(20):
        known = [i for i in range(50) if not np.isnan(signature[r, i])]
        distance = np.zeros(len(known))
        for c in range(3):
            centre, scale = plain_scale(history[c, r, known])
            near = lambda x, centre=centre, scale=scale: np.clip((np.nan_to_num(x) - centre) / scale, -CONTEXT_CLIP, CONTEXT_CLIP)
            distance += weights[c] * np.abs(near(history[c, r, known]) - near(reference[c, r]))
        like = np.exp(-np.round(distance / weights.sum(), 12) / 0.3)
        first = sorted(range(len(known)), key=lambda i: (-like[i], i))[:6]
        expected = sum(like[i] * signature[r, known[i]] for i in first) / sum(like[i] for i in first)
        assert got[r] == pytest.approx(expected, abs=1e-12)
