"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are 64-bit SimHashes of 3-word shingles.  All pairs of distinct
fingerprints within a Hamming radius are found exactly: fingerprints are tiled
by the population counts of their four 16-bit segments, a pair of tiles is
skipped when those counts differ by more than the radius in sum (each unit of
difference needs a differing bit), and the other pairs are compared whole with
numpy exclusive-or and bit counts.  A pair of tiles gives a spanning forest of
its links rather than every link, so a group of n near copies costs n rows.
Groups are connected components of those links, found by star contraction.
Both the comparison and what is shuffled for it grow with the square of the
number of distinct fingerprints once tiles have several parts; the shuffle less
by the size of a tile.

Defined results: null or blank text has fingerprint zero; rows with equal text
share a fingerprint; a null doc_id never names a component unless the whole
component has none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_AZ, cut, free_names, joined_evenly, rows_of, scratch, small_batches

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints in one tile at most; a larger tile is dealt into several.
TILE_ROWS = 32_768
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
_PART = 1 << 18


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of one text as a signed 64-bit integer; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *accumulate(len(t) + 1 for t in tokens)]
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:], strict=False)
        ]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        part = np.array(hashes[i : i + _PART], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, fp): the fingerprint of every row's whole text; no shuffle."""
    small_batches(docs.sparkSession)
    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = next(rows_of(iter([batch]), "text"))
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*kinds, "fp long"]))


def _segment_counts(fp: str) -> list:
    mask = (1 << SEGMENT_BITS) - 1
    return [
        F.bit_count(F.shiftrightunsigned(F.col(fp), i * SEGMENT_BITS).bitwiseAND(F.lit(mask)))
        for i in range(SEGMENTS)
    ]


def _tile_key(counts: list):
    key = F.lit(0)
    for c in counts:
        key = key * (SEGMENT_BITS + 8) + c + 4
    return key


def _neighbour_steps(radius: int) -> list[int]:
    """Differences of tile keys within the radius, one of each opposite pair, and 0."""
    base = SEGMENT_BITS + 8
    steps = []
    for move in product(range(-radius, radius + 1), repeat=SEGMENTS):
        if sum(map(abs, move)) <= radius:
            step = 0
            for m in move:
                step = step * base + m
            steps.append(step)
    return sorted(s for s in steps if s >= 0)


def close_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a tile (b is None) or between two tiles."""
    rest = a if b is None else b
    shift = 0 if b is None else len(a)
    nodes = a if b is None else np.concatenate([a, b])
    group = np.arange(len(nodes))
    links = []
    step = max(1, (1 << 20) // max(1, len(rest)))
    for lo in range(0, len(a), step):
        near = np.bitwise_count(a[lo : lo + step, None] ^ rest[None, :]) <= radius
        for i in np.nonzero(near.sum(axis=1) > (b is None))[0]:
            js = shift + np.nonzero(near[i])[0]
            found, first = np.unique(group[js], return_index=True)
            mine = group[lo + i]
            new = found != mine
            if new.any():
                links += [(int(nodes[lo + i]), int(nodes[j])) for j in js[first[new]]]
                group[np.isin(group, found)] = mine
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect whatever distinct fingerprints lie within the radius.

    Tiles hold at most about TILE_ROWS fingerprints and every pair of tiles is
    a row of its own, so no task holds more than two tiles of a pair at a time.
    """
    keyed = distinct.select("fp", _tile_key(_segment_counts("fp")).alias("tile"))
    # At most 17 ** SEGMENTS tiles exist, whatever the input.
    sizes = keyed.groupBy("tile").agg(
        F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts")
    )
    sizes = cut(sizes)
    dealt = keyed.join(sizes, "tile").select(
        "tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp", "parts"
    )
    tiles = dealt.groupBy("tile", "part").agg(
        F.collect_list("fp").alias("fps"), F.first("parts").alias("parts")
    )
    tiles = cut(tiles)
    steps = F.array(*[F.lit(s) for s in _neighbour_steps(radius)])
    near = sizes.select(F.col("tile").alias("to"), F.col("parts").alias("to_parts"))
    left = (
        tiles.select("tile", "part", F.explode(steps).alias("step"), "fps")
        .withColumn("to", F.col("tile") + F.col("step"))
        .join(near, "to")
        .withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
        .where((F.col("step") > 0) | (F.col("part") <= F.col("to_part")))
        .select("to", "to_part", F.col("fps").alias("a"), "tile", "part")
    )
    right = tiles.select(
        F.col("tile").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("b")
    )
    pairs = left.join(right, ["to", "to_part"]).select(
        "a", "b", ((F.col("tile") == F.col("to")) & (F.col("part") == F.col("to_part"))).alias("own")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
                own = batch.column(2)[i].as_py()
                b = None if own else batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                out += close_links(a, b, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())],
                ["a", "b"],
            )

    return pairs.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links.

    Large-star and small-star steps alternate until the links no longer change.
    A node with very many links, as the root of a large component, is dealt out
    over several tasks.
    """
    edges = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links"))
        large = (
            joined_evenly(both, cut(low), ["u"], "links", F.col("v"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = cut(large.where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")))
        joined = joined_evenly(large, least, ["u"], "links", F.col("v"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if seen == (now["n"], now["x"]):
            break
        seen = (now["n"], now["x"])
    else:
        raise RuntimeError("components did not settle")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def rooted_prints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds root, which names a fingerprint's component, to rows of distinct fp."""
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return cut(rooted.select(*distinct.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    rooted = rooted_prints(distinct, radius)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("prints"))
    by_print = joined_evenly(rooted, cut(named), ["root"], "prints", F.col("fp")).select("fp", "copies", "component_id")
    # Rows that share a fingerprint are told apart by their place in what was checkpointed.
    rows = prints.withColumn("_at", F.monotonically_increasing_id())
    return joined_evenly(rows, cut(by_print), ["fp"], "copies", F.col("_at")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    It is the one with the least doc_id (null last); among rows that share it, the first read.
    """
    spark = docs.sparkSession
    path = scratch(spark, "rows")
    (row,) = free_names(docs, "_row")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    prints = fingerprints(rows, (row, "doc_id"))
    distinct = cut(prints.groupBy("fp").agg(F.min(place).alias("first")))
    kept = rooted_prints(distinct, radius).groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)
