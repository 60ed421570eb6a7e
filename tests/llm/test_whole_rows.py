"""Sharding and packing give out the documents and the token ids themselves."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import SMOKE_DIR
from tests.llm.test_operators import DOCS, ODD, check_packed, check_shards, multiset
from tidemark.llm import packing, sharding, simhash


def test_shards_hold_whole_documents(spark):
    copies = [(None, "same", lang, "a", 4) for lang in ("en", "de", None, "en")] * 20
    docs = spark.createDataFrame([*ODD, *copies], DOCS).repartition(3)
    rows = sharding.shard(docs).collect()
    check_shards(rows, [r[:2] for r in [*ODD, *copies]])
    assert multiset(tuple(r)[:5] for r in rows) == multiset([*ODD, *copies])
    assert sorted(r["place"] for r in rows) == list(range(len(rows)))


def test_packed_pieces_hold_their_ids(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    check_packed(spark, rows, [r[:2] for r in ODD])
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(packing.pieces(docs.limit(0), with_ids=True)).count() == 0


INTERNAL = ("_row", "_ROW_", "_bytes", "_crc32", "_no_text", "_place", "_part", "_at", "_found", "_parts", "first", "root", "row", "bucket", "number")


def test_columns_named_like_those_inside_are_kept(spark):
    docs = spark.createDataFrame(ODD, DOCS).select("*", *[F.concat(F.lit(f"mine {c} "), F.coalesce("text", F.lit("none"))).alias(c) for c in INTERNAL])
    whole = multiset(tuple(r) for r in docs.collect())
    shards = sharding.shard(docs).drop("size", "text_crc32", "place", "shard", "slot")
    assert multiset(tuple(r) for r in shards.select(docs.columns).collect()) == whole
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and set(multiset(tuple(r) for r in kept.collect())) <= set(whole)
    pieces = packing.pieces(docs)
    mine = pieces.select("*", *[F.concat(F.lit(f"mine {c} "), F.col("ids_crc32")).alias(c) for c in (*INTERNAL, "Sequence_id")])
    packed = packing.pack(mine).select("doc_id", "piece", "ids_crc32", *INTERNAL)
    assert multiset(map(tuple, packed.collect())) == multiset(map(tuple, mine.select(packed.columns).collect()))


def test_the_pipeline_gives_out_ids(spark):
    rows = corpus_pipeline.run(spark, SMOKE_DIR).collect()
    assert rows and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
