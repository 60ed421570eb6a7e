"""Reproducible shuffle and sharding by a Feistel permutation, in DataFrame operations only.

Documents get a row key and are written once, compressed, to the shared folder.
Their narrow rows (key, doc_id, size, crc32) are numbered globally: they are
dealt by a hash into as many buckets as a bucket has rows (the square root of
their number) and numbered within their bucket, and a bucket's rows start after
those of the buckets before it.  The numbers are joined to the documents by the
row key.  A Feistel network
over mixed radices a x b >= n, walked along its cycle until it falls below n,
permutes the numbers 0 .. n-1.  The place p of a row gives shard p mod k and
slot p div k, so shards differ by one row at most and slots have no gaps.

Rows with the same doc_id, size and checksum are counted for each writing task
before they are numbered, so copies cost one narrow row a task.  The places that
they have together are reproducible; which of them has which follows the order
in which they are read.

Defined results: a null text has size 1 and the checksum of no bytes; a null
doc_id is numbered like any other; other columns are kept.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_names, scratch

SHARDS = 8
SEED = 2_024
ROUNDS = 6
#: Walks longer than this fail loudly; one is less likely than b ** -WALKS.
WALKS = 64
_PRIME = 2_147_483_647


def _mix(value: Column, key: Column) -> Column:
    """A pseudo-random number below 2 ** 31 from one below 2 ** 31, in 64-bit arithmetic."""
    x = (value * F.lit(1_103_515_245) + key) % F.lit(_PRIME)
    x = x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(48_271) % F.lit(_PRIME)
    return x.bitwiseXOR(F.shiftright(x, 13))


def radices(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and a * b - n < b."""
    b = max(1, math.isqrt(max(0, n - 1)) + 1)
    return max(1, -(-n // b)), b


def feistel(value: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the network over a * b numbers; a bijection of them."""
    a, b = radices(n)

    def turn(state: Column, key: Column) -> Column:
        # Both halves move in turn: the left by a function of the right and the other way round.
        left = (state["l"] + _mix(state["r"], key)) % F.lit(a)
        right = (state["r"] + _mix(left, key + 1)) % F.lit(b)
        return F.struct(left.alias("l"), right.alias("r"))

    keys = F.array(*[F.lit((seed * 7_919 + i * 104_729) % _PRIME).cast("long") for i in range(rounds)])
    start = F.struct(
        F.floor(value / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r")
    )
    return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(value: Column, n: int, seed: int = SEED) -> Column:
    """The place of a number below n: the network is walked until it is below n."""
    a, b = radices(n)
    walks = min(WALKS, a * b - n)
    place = feistel(value, n, seed)
    if walks:
        place = F.aggregate(
            F.sequence(F.lit(1), F.lit(walks)),
            place,
            lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed)),
        )
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("a walk was too long")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row with all its columns, and size, text_crc32, place, shard and slot (replaced where docs has them)."""
    spark = docs.sparkSession
    path = scratch(spark, "shard")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    names = ("_row", "_bytes", "_crc32", "_no_text", "_place")
    row, size, crc, none, spot = free_names(docs, *names)
    docs.withColumns(
        {
            row: F.monotonically_increasing_id(),
            size: F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")),
            crc: F.crc32(data),
            none: F.col("text").isNull(),
        }
    ).write.parquet(path)
    kept = spark.read.parquet(path)
    key = ["doc_id", "_bytes", "_crc32", "_no_text", "_part"]
    # The high bits of a row's key are the task that wrote it: no group is larger than a task's rows.
    own_names = [F.col(c).alias(n) for c, n in zip((row, size, crc, none), names, strict=False)]
    narrow = kept.select("doc_id", *own_names, F.shiftright(row, 33).alias("_part"))
    groups = cut(narrow.groupBy(*key).agg(F.count("*").alias("copies"), F.min("_row").alias("_row")))
    total = groups.agg(F.sum("copies").alias("n")).first()["n"] or 0
    buckets = math.isqrt(total) + 1
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_crc32"), F.lit(buckets)).cast("int"))
    # The square root of the number of rows comes to the driver and is broadcast.
    held = groups.groupBy("bucket").agg(F.sum("copies").alias("n")).orderBy("bucket").collect()
    starts = accumulate((r["n"] for r in held), initial=0)
    base = spark.createDataFrame([(r["bucket"], at) for r, at in zip(held, starts, strict=False)], "bucket int, base long")
    groups = groups.join(F.broadcast(base), "bucket")
    before = F.sum("copies").over(W.partitionBy("bucket").orderBy(*key)) - F.col("copies")
    first = groups.withColumn("first", F.col("base") + before)
    several = first.where("copies > 1").select("first", *[F.col(c).alias(f"of{c}") for c in key])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of{c}")) for c in key])
    copy = F.row_number().over(W.partitionBy("first").orderBy("_row")) - 1
    numbers = first.where("copies = 1").select("_row", F.col("first").alias("number")).unionByName(
        narrow.join(several, same).select("_row", (F.col("first") + copy).alias("number"))
    )
    places = numbers.select(F.col("_row").alias(row), permuted(F.col("number"), total, seed).alias(spot))
    own = [c for c in docs.columns if c.lower() not in ("size", "text_crc32", "place", "shard", "slot")]
    return kept.join(places, row).select(
        *own,
        (F.col(size) + 1).alias("size"),
        F.col(crc).alias("text_crc32"),
        F.col(spot).alias("place"),
        (F.col(spot) % shards).cast("int").alias("shard"),
        F.floor(F.col(spot) / shards).cast("long").alias("slot"),
    )
