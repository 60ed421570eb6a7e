"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet and reads it again as the next stage's docs.  All but
the last return the columns of documents.  What a stage wrote for itself, and
its own result once the next stage has read it, are removed.

Defined results: a null text counts as an empty one in every stage and stays a
null (all null, empty and blank texts are near copies of each other, so one
row of them is left); rows with a null doc_id are documents like any other; of
rows that repeat one is left; an empty table gives no pieces; columns of docs
whose names the operators use are kept as they are up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, packing, secret_scan, simhash, toxicity
from tidemark.llm.common import remove, scratch_removed, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the grammar rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, that with the least doc_id (null last)."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with too large a share of benchmark words go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are replaced by a mark; the document stays."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of token ids (ids: unsigned 32-bit, little-endian) with their sequence and offset."""
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with scratch_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, before)
        before = path
    return docs
