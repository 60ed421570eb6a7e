"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
sys.modules["tidemark.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") for k in e.queries() if k[2:3].isdigit())
assert "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(encoding="utf-8")
