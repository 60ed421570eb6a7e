"""Hard negatives of anchor and positive pairs by distributed radix selection of scores.

Scores are whole inner products.  A window is an anchor, a range of scores and the
rows it may take: those of its label (to find its positives) or of other labels
(its negatives, one window for each positive).  Each task scores its rows against
a block of anchors with one matrix product and counts, for each window, how many
scores fall into each bucket of the leading digit; the buckets' sums locate the
one that holds the k-th score.  The next pass counts the next digit within that
bucket, until a bucket is one score.  Then one more pass gathers the rows above
it, and of the rows at it the least ids.

A task sends no bucket below the one in which its own counts reach k, since the
k-th score of all rows cannot lie lower; so a window costs at most k counts, and
at the end at most 2 k rows, for each task, however many rows tie or repeat.

Anchors are a share of all rows: they are taken in blocks of bounded size, each
against all rows, which are read from their table again in every pass.  Equal
anchors are one anchor with a count.

Defined results: rows with a null label, a null vector, or any component that is
null or not finite take no part; vectors of unequal length are compared as if the
shorter ended in zeros; a null vec_id is no anchor and comes after all others among
equal scores; rows that repeat are rows of their own, as positives, as negatives
and as anchors; an anchor without other rows of its label, and a positive without
rows in its range of scores, have no result; an empty table gives no rows.  Other
columns are dropped.  Components beyond 524,288 raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.vectors import SCALE, quantised, whole

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is at least so many and at most so many hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a block, bits of a digit, and rows that are scored together.
BLOCK, DIGIT, ROWS = 1_024, 10, 512
_NO_ID = np.iinfo(np.int64).max
RESULT = """anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"""


@dataclass
class Windows:
    """Windows in layers of one for each anchor: arrays of (layers, anchors)."""

    same: bool
    top: np.ndarray  # the highest score of the open bucket
    size: np.ndarray  # scores in it
    need: np.ndarray  # rows that are still to be found in it; 0: the window is closed


@dataclass
class Anchors:
    ids: list
    labels: np.ndarray
    vectors: np.ndarray
    copies: list[int]


def _scores(column: pa.Array, anchors: Anchors) -> np.ndarray:
    """(anchors, rows): exact, by floating point where no sum can leave 53 bits."""
    rows = quantised(column, anchors.vectors.shape[1])
    largest = max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(anchors.vectors).max(initial=0)))
    if largest * rows.shape[1] < 2**53:
        return (anchors.vectors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return anchors.vectors @ rows.T


def _scored(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, scores and whether labels are the anchor's, for a few rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            ids = part.column(0).fill_null(_NO_ID).to_numpy()
            yield ids, _scores(part.column(2), anchors), anchors.labels[:, None] == part.column(1).to_numpy()[None, :]


def counted(rows: DataFrame, anchors: Anchors, windows: Windows, shift: int) -> DataFrame:
    """(window, digit, n): how many scores of each open bucket have a digit, counted from the top."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, windows))
    n_digits = int(((windows.size.max(initial=1) - 1) >> shift) + 1)
    schema = pa.schema([("window", pa.int32()), ("digit", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, open_ = held.value
        layers, n = open_.top.shape
        found = np.zeros((layers, n * n_digits), np.int64)
        for _, scores, same in _scored(batches, given):
            wanted = same if open_.same else ~same
            for layer in range(layers):
                below = open_.top[layer][:, None] - scores
                at, row = np.nonzero((below >= 0) & (below < open_.size[layer][:, None]) & wanted)
                slot = at * n_digits + (below[at, row] >> shift)
                found[layer] += np.bincount(slot, minlength=n * n_digits)
        found = found.reshape(layers * n, n_digits)
        before = np.cumsum(found, axis=1) - found
        window, digit = np.nonzero((found > 0) & (before < open_.need.reshape(-1, 1)))
        if len(window):
            sent = [window.astype(np.int32), digit.astype(np.int32), found[window, digit]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sent], schema=schema)

    return rows.mapInArrow(count, "window int, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))


def _narrowed(rows: DataFrame, anchors: Anchors, windows: Windows, shift: int) -> Windows:
    """The windows with the bucket that holds the last row wanted; all their rows where there are fewer."""
    spark = rows.sparkSession
    shape = windows.top.shape
    needs = spark.createDataFrame(
        [(i, int(k)) for i, k in enumerate(windows.need.reshape(-1).tolist()) if k], "window int, need long"
    )
    upto = F.sum("n").over(W.partitionBy("window").orderBy("digit"))
    placed = counted(rows, anchors, windows, shift).withColumn("upto", upto).join(F.broadcast(needs), "window")
    hit = placed.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    top, size, need = (x.reshape(-1).copy() for x in (windows.top, windows.size, windows.need))
    left = np.ones(len(top), bool)
    for r in hit.select("window", "digit", (F.col("need") - F.col("upto") + F.col("n")).alias("need")).collect():
        w = r["window"]
        left[w] = False
        end = top[w] - size[w]
        top[w] -= r["digit"] << shift
        size[w], need[w] = min(1 << shift, top[w] - end), r["need"]
    # Too few rows in the window: its end is below its lowest score, and there all are wanted.
    top[left], size[left], need[left] = top[left] - size[left], 0, 0
    return Windows(windows.same, *(x.reshape(shape) for x in (top, size, need)))


def gathered(rows: DataFrame, anchors: Anchors, highest: np.ndarray, last: Windows) -> DataFrame:
    """(window, vec_id, score) of all rows above each window's last score, and of those at it the least ids of each task."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, highest, last))
    schema = pa.schema([("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, high, end = held.value
        layers, n = end.top.shape
        need = end.need.reshape(-1)
        least = np.full(layers * n, _NO_ID)  # the greatest of the ids kept, once there are enough
        ties = np.zeros((0, 2), np.int64)
        for ids, scores, same in _scored(batches, given):
            wanted = same if end.same else ~same
            windows, found, values, tied = [], [], [], []
            for layer in range(layers):
                at, row = np.nonzero((scores > end.top[layer][:, None]) & (scores <= high[layer][:, None]) & wanted)
                windows.append(layer * n + at)
                found.append(ids[row])
                values.append(scores[at, row])
                at, row = np.nonzero((scores == end.top[layer][:, None]) & (end.need[layer] > 0)[:, None] & wanted)
                nearer = ids[row] <= least[layer * n + at]
                tied.append(np.column_stack([layer * n + at[nearer], ids[row[nearer]]]))
            yield _rows(np.concatenate(windows), np.concatenate(found), np.concatenate(values), schema)
            if sum(map(len, tied)):
                ties = np.concatenate([ties, *tied])
                ties = ties[np.lexsort((ties[:, 1], ties[:, 0]))]
                first = np.searchsorted(ties[:, 0], ties[:, 0], "left")
                place = np.arange(len(ties)) - first
                ties = ties[place < need[ties[:, 0]]]
                place = np.arange(len(ties)) - np.searchsorted(ties[:, 0], ties[:, 0], "left")
                full = place == need[ties[:, 0]] - 1
                least[ties[full, 0]] = ties[full, 1]
        yield _rows(ties[:, 0], ties[:, 1], end.top.reshape(-1)[ties[:, 0]], schema)

    return rows.mapInArrow(gather, "window int, vec_id long, score long")


def _rows(windows: np.ndarray, ids: np.ndarray, scores: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(windows.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def selected(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """(window, vec_id, score, place): the first k rows of each window by score, then id."""
    highest = windows.top.copy()
    shift = DIGIT * max(0, math.ceil(math.log2(max(2, windows.size.max(initial=1))) / DIGIT) - 1)
    while windows.need.any() and shift >= 0:
        windows = _narrowed(rows, anchors, windows, shift)
        shift -= DIGIT
    first = F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return gathered(rows, anchors, highest, windows).withColumn("place", first).where(F.col("place") <= k)


def _pairs(rows: DataFrame, anchors: Anchors, bound: int, k: int) -> dict[int, list[tuple]]:
    """The first k other rows (id, score) of each anchor's label, by the place of the anchor."""
    shape = (1, len(anchors.ids))
    whole_range = Windows(True, np.full(shape, bound), np.full(shape, 2 * bound + 1), np.full(shape, k + 1))
    found: dict[int, list[tuple]] = {}
    for r in selected(rows, anchors, whole_range, k + 1).orderBy("window", "place").collect():  # at most k + 1 an anchor
        found.setdefault(r["window"], []).append((r["vec_id"], r["score"]))
    own = (anchors.vectors * anchors.vectors).sum(axis=1).tolist()
    for i, pairs in found.items():
        # The anchor is one of the rows: of those with its id and its score any one may be taken for it.
        itself = (anchors.ids[i], own[i])
        if itself in pairs:
            pairs.remove(itself)
        del pairs[k:]
    return found


def _of_block(rows: DataFrame, anchors: Anchors, norm: float, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    """The hard negatives of one block of anchors; None if no positive has any range of scores."""
    spark = rows.sparkSession
    own = np.sqrt((anchors.vectors.astype(float) ** 2).sum(axis=1).max(initial=0))
    bound = math.ceil(norm * own * (1 + 1e-9)) + 1  # no score is beyond the product of two norms
    pairs = _pairs(rows, anchors, bound, positives)
    shape = (positives, len(anchors.ids))
    top, size, facts = np.zeros(shape, np.int64), np.zeros(shape, np.int64), []
    for i, found in pairs.items():
        for layer, (positive, score) in enumerate(found):
            least, most = -(-low * score // 100), high * score // 100
            if most >= least:
                top[layer, i], size[layer, i] = most, most - least + 1
                facts.append((layer * shape[1] + i, anchors.ids[i], positive, score, anchors.copies[i]))
    if not facts:
        return None
    windows = Windows(False, top, size, np.where(size > 0, negatives, 0))
    chosen = selected(rows, anchors, windows, negatives)
    told = spark.createDataFrame(facts, "window int, anchor_id long, positive_id long, positive_score long, copies long")
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return chosen.join(F.broadcast(told), "window").select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        each.alias("_copy"),
    ).drop("_copy")


def hard_negatives(
    rows: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`.
    """
    spark = rows.sparkSession
    label = F.col("label").cast("long").alias("label")
    kept = rows.where(F.col("label").isNotNull() & whole("embedding")).select("vec_id", label, "embedding")
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    square = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = math.sqrt(kept.agg(F.max(square).alias("n")).first()["n"] or 0)
    chosen = kept.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "embedding").agg(F.count("*").alias("copies"))
    anchors = cut(chosen.withColumn("hash", F.xxhash64("vec_id", "label", "embedding")))
    blocks = -(-anchors.count() // block)
    done = []
    for b in range(blocks):
        for part in _blocks(anchors, b, blocks, block):
            found = _of_block(kept, part, norm, positives, negatives, low, high)
            if found is not None:
                done.append(found if blocks == 1 else cut(found))
    return reduce(DataFrame.unionByName, done) if done else _none(spark)


def _blocks(anchors: DataFrame, b: int, blocks: int, block: int) -> Iterator[Anchors]:
    """The anchors of one hash bucket, of distinct rows and so of about `block`, in parts of no more."""
    held = anchors.where(F.pmod("hash", F.lit(blocks)) == b).collect()
    for lo in range(0, len(held), block):
        part = held[lo : lo + block]
        dim = max(1, *(len(r["embedding"]) for r in part))
        vectors = quantised(pa.array([r["embedding"] for r in part], pa.list_(pa.float64())), dim)
        yield Anchors([r["vec_id"] for r in part], np.array([r["label"] for r in part]), vectors, [r["copies"] for r in part])


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


#: The labels that the query mines with: those of rows divisible by seven are changed.
CHANGED_SQL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
ORACLE = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, {CHANGED_SQL} AS label,
  list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: coalesce(isfinite(y), false))) = len(embedding)),
s AS MATERIALIZED (SELECT a.row AS arow, a.vec_id AS anchor_id, o.row, o.vec_id, a.label = o.label AS same,
  list_inner_product(a.x, o.x)::BIGINT AS score FROM v a JOIN v o ON a.row <> o.row WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arow ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.arow, p.row ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.arow = p.arow AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
