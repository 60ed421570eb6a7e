"""One row of each group of near copies stays, also without ids and among rows that share one."""

from __future__ import annotations

from tests.llm import brute
from tests.llm.test_operators import multiset
from tidemark.llm import simhash

WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS)
NEAR = [" ".join([*WORDS, *(["tail"] * k)]) for k in range(1, 4)]
OTHER = " ".join(reversed(WORDS))


def test_one_row_of_each_group_stays(spark):
    prints = [brute.fingerprint(t) for t in (LONG, *NEAR, OTHER)]
    assert brute.components(prints) == [0, 0, 0, 0, 4] and len(set(prints)) > 2
    rows = [(None, t) for t in NEAR] + [(7, LONG), (7, NEAR[0]), (9, NEAR[1]), (7, OTHER), (None, OTHER)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [r["doc_id"] for r in kept] == [7, 7]
    assert sum(r["text"] == OTHER for r in kept) == 1
    nameless = spark.createDataFrame([(None, t) for t in (*NEAR, LONG, OTHER, OTHER)], "doc_id long, text string")
    kept = [r["text"] for r in simhash.keep_first(nameless).collect()]
    assert len(kept) == 2 and OTHER in kept


def test_the_least_id_of_another_group_keeps_no_row(spark):
    rows = [(1, LONG), (2, OTHER), (1, NEAR[0]), (2, NEAR[1]), (3, OTHER)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert multiset(map(tuple, kept)) == multiset([(1, LONG), (2, OTHER)])
