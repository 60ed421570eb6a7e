"""The training-data queries: one for each operator, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontamination, licenses, line_rules, negatives, url_filter
from tidemark.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        "contaminated",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["end"])), ",").alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_crf import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import judged_urls

    return judged_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_rules import judged

    return judged(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import NARROW, pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), with_ids=True)).select(*NARROW, "sequence_id", "offset")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.expr(negatives.CHANGED_SQL).alias("label")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", changed))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_url_filter": op7_url_filter,
    "op8_secrets": op8_secrets,
    "op9_line_rules": op9_line_rules,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_mixing": op12_mixing,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE,
    "op6_licenses": licenses.oracle(),
    "op7_url_filter": url_filter.oracle(),
    "op9_line_rules": line_rules.ORACLE,
    "op11_centroids": centroids.oracle(),
    "op13_negatives": negatives.ORACLE,
}
