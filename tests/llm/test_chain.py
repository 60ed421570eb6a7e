"""The line chain: forward-backward against enumeration, and training texts of any length."""

from __future__ import annotations

from itertools import product

import numpy as np

from tidemark.llm import quality_crf

LABELS = "doc_id long, quality int, toxic int"


def enumerated(score, moves):
    """P(good) of each line and expected counts of moves, over all labelings of one chain."""
    good, counts, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for labels in product((0, 1), repeat=len(score)):
        weight = np.exp(sum(s / 2 if y else -s / 2 for s, y in zip(score, labels, strict=True)))
        for a, b in zip(labels, labels[1:], strict=False):
            weight *= np.exp(moves[a, b])
        total += weight
        good += weight * np.array(labels)
        for a, b in zip(labels, labels[1:], strict=False):
            counts[a, b] += weight
    return good / total, counts / total


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 9, rng.integers(1, 5))
        score, moves = rng.normal(0, 3, lengths.sum()), rng.normal(0, 1, (2, 2))
        good, counts = quality_crf.forward_backward(score, lengths, moves)
        parts = np.split(score, np.cumsum(lengths)[:-1])
        expected = [enumerated(p, moves) for p in parts]
        assert np.allclose(good, np.concatenate([e[0] for e in expected]), atol=1e-12)
        assert np.allclose(counts, sum(e[1] for e in expected), atol=1e-10)


def test_bad_lines_late_in_a_text_are_learned(spark):
    """Texts differ only after more lines than one chain, or eight, hold."""
    fine, bad = "A plain line of words stands here.\n", "### BUY $$$ NOW !!! ###\n"
    rows = [(i, fine * 450 + (fine if i % 2 else bad) * 200) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(80)], LABELS)
    chain = quality_crf.train(docs, labels)
    score = chain.document_scores([fine * 650, fine * 450 + bad * 200])
    assert score[0] > 0.5 > score[1]


def test_long_lines_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "x" * 1_000_000), (3, "a b.\n" * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0, "clash", 5), (2, 0, 1, None, 6), (3, 1, 0, "", 7)], LABELS + ", text string, label int")
    rows = quality_crf.quality(docs, quality_crf.train(docs, labels)).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
