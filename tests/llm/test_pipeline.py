"""The corpus pipeline: each stage against a plain version, and odd documents through all of it."""

from __future__ import annotations

import shutil

import corpus_pipeline
from tests.compare import SMOKE_DIR
from tests.llm import brute
from tests.llm.test_operators import DOCS, ODD, check_packed, multiset
from tidemark.llm import secret_scan, toxicity
from tidemark.llm.common import table


def test_stages_are_in_the_order_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "secret_scan",
        "best_fit_packing",
    ]


def test_run_matches_a_plain_version(spark):
    docs = table(spark, SMOKE_DIR, "documents")
    grammar = toxicity.train(docs, table(spark, SMOKE_DIR, "labels"))
    items = [tuple(r) for r in table(spark, SMOKE_DIR, "benchmark").select("item_id", "text").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    rows = [r for r in rows if grammar.scores([r[1]])[0] < toxicity.THRESHOLD]
    roots = brute.components([brute.fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    rows = [r for r in rows if not brute.contamination(r[1], items)[-1]]
    rows = [(d, secret_scan.redacted(t)) for d, t in rows]
    got = corpus_pipeline.run(spark, SMOKE_DIR).collect()
    assert 0 < len(rows) < docs.count()
    check_packed(spark, got, rows)


def test_odd_documents_pass_through_every_stage(spark, tmp_path):
    folder = tmp_path / "sf"
    folder.mkdir()
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMOKE_DIR}/{name}.parquet", folder)
    spark.createDataFrame(ODD, DOCS).write.parquet(str(folder / "documents.parquet"))
    docs = table(spark, str(folder), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(folder))
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), str(folder)).count() == 0
    got = corpus_pipeline.run(spark, str(folder)).select("doc_id").distinct().collect()
    assert multiset(r["doc_id"] for r in got) == multiset([1, 2, 5, 6, 7, 8, 9, None])


def test_only_the_last_result_is_left(spark):
    from pathlib import Path

    from tidemark.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    had = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SMOKE_DIR).count() > 0
    new = [p for p in set(folder.iterdir()) - had if p.name.split("-")[0] in ("pipeline", "rows", "pieces", "shard")]
    assert [[q.name for q in p.iterdir()] for p in new] == [["4-best_fit_packing"]]


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from tidemark.llm import common

    class Conf:
        def get(self, key, default):
            return default

    class Folder:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Folder)}))})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(type("Session", (), {"sparkContext": Context}))
