"""Centroid clustering by annulus search over centroids in the order of their norms.

By the triangle inequality a centroid c can be as near to a vector x as a bound u
only if | |c| - |x| | <= u.  The distance to the centroid whose norm is nearest to
that of x (and to its neighbours in that order) is such a bound; two binary
searches in the sorted norms give the centroids within the annulus, and those
alone are compared exactly, in whole numbers.  Borders are widened by more than
the rounding of norms, so a centroid on the border of an annulus is compared too
and equal distances go to the smaller number.

Each round is one pass over the vectors: a task adds up its vectors by cluster,
so what is shuffled is one row for each cluster and task, however many vectors a
cluster has or how often a vector is repeated.  k x dim sums come to the driver and
k x dim numbers go to the tasks.

Defined results: rows whose vector is null, has another number of components, or
has one that is null or not finite are left out; with fewer vectors than k there
are as many centroids as vectors; an empty table gives no rows; equal vectors
count as often as they stand there; a null vec_id is hashed as an empty text and
kept.  Components beyond 524,288 raise an error.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.common import cut
from tidemark.llm.vectors import SCALE, quantised, whole

CENTROIDS, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: Neighbours in the order of norms, on either side, that the first bound is taken from.
AROUND = 2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance) of each vector, and how many distances were computed."""
    k = len(centroids)
    norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    middle = np.searchsorted(norms, own)
    bound = np.full(len(vectors), np.iinfo(np.int64).max)
    computed = 0
    for step in range(-AROUND, AROUND):
        at = np.clip(middle + step, 0, k - 1)
        bound = np.minimum(bound, squared(vectors, centroids[order[at]]))
        computed += len(vectors)
    u = np.sqrt(bound.astype(float))
    u += 1e-9 * (1 + own + u)
    low, high = np.searchsorted(norms, own - u, "left"), np.searchsorted(norms, own + u, "right")
    cluster, best = np.full(len(vectors), k), np.full(len(vectors), np.iinfo(np.int64).max)
    for place, number in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= place) & (place < high))
        d = squared(vectors[rows], centroids[number])
        computed += len(rows)
        nearer = (d < best[rows]) | ((d == best[rows]) & (number < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], number
    return cluster, best, computed


def start(vectors: DataFrame, k: int = CENTROIDS, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The k vectors whose vec_id comes first by its hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")
    first = vectors.select(F.sha2(text, 256).alias("hash"), numbers).orderBy("hash", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) of each task's vectors, one row for each cluster that it meets."""
    k, dim = centroids.shape
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            numbers = quantised(batch.column(0), dim)
            cluster, _, _ = nearest(numbers, held.value)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(numbers[order], first, axis=0)
            n += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"cluster": met.astype(np.int32), "n": n[met], "sums": sums[met].tolist()}, schema=schema
        )

    return vectors.select("embedding").mapInArrow(add, "cluster int, n long, sums array<long>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; empty ones stay."""
    part = _sums(vectors, centroids).select("cluster", "n", F.posexplode("sums").alias("place", "sum"))
    wide = F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum")
    totals = part.groupBy("cluster", "place").agg(F.sum("n").alias("n"), wide).collect()  # k x dim rows
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["place"]] = int(r["sum"]) // r["n"]
    return out


def clustered(
    rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with a vector.

    rows (vec_id, embedding) are read once for each round and once more; nothing of them is written
    but the narrow result.
    """
    spark = rows.sparkSession
    vectors = rows.where(whole("embedding", dim)).select("vec_id", "embedding")
    centroids = start(vectors, k, dim, seed)
    id_type = rows.schema["vec_id"].dataType
    kinds = [StructField("vec_id", id_type), StructField("cluster", IntegerType()), StructField("distance", LongType())]
    assigned = spark.createDataFrame([], StructType(kinds))
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(vectors, centroids)
        held = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, distance, _ = nearest(quantised(batch.column(1), dim), held.value)
                found = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(found, names=["vec_id", "cluster", "distance"])

        assigned = cut(vectors.mapInArrow(assign, StructType(kinds)))
    wide = F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")
    by_cluster = {r["cluster"]: int(r["sum"]) for r in assigned.groupBy("cluster").agg(wide).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, s, sum(by_cluster.values()), hashes[c]) for c, s in by_cluster.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    """SQL that compares every vector with every centroid."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT row, cluster, distance FROM (SELECT v.row, c.cluster, d.distance,
    row_number() OVER (PARTITION BY v.row ORDER BY d.distance, c.cluster) AS place
    FROM v CROSS JOIN c{i} c CROSS JOIN LATERAL (
      SELECT list_sum(list_transform(v.x, lambda y, i: (y - c.x[i]) * (y - c.x[i])))::BIGINT AS distance) d) WHERE place = 1)"""

    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
  list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: coalesce(isfinite(y), false))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1)::INT AS cluster, x FROM v
  QUALIFY cluster < {k})""",
    ]
    for i in range(rounds):
        steps += [
            assigned(i),
            f"""m{i} AS (SELECT cluster, list(mean ORDER BY place) AS x FROM (
  SELECT cluster, place, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS mean
  FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, {dim} + 1)) AS place FROM a{i} JOIN v USING (row)) GROUP BY ALL) GROUP BY cluster)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x)::BIGINT[] AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))",
        ]
    steps.append(assigned(rounds))
    return (
        "WITH "
        + ",\n".join(steps)
        + f""" SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
  FROM a{rounds} JOIN v USING (row) JOIN c{rounds} c USING (cluster)"""
    )
