"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: whole texts travel in it, so it is far below Spark's default of 10,000.
ARROW_ROWS = 512

#: Bytes that are words after A-Z became a-z: 0-9, a-z and every byte of a non-ASCII character.
ALNUM_WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: DuckDB's text with A-Z lower-cased and every other character left alone; null is empty.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z of UTF-8 bytes and leaves every other byte alone.
LOWER_AZ = bytes.maketrans(_UPPER, _UPPER.lower())
#: Lower-cases A-Z and turns every byte outside ALNUM_WORD_RE into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: A key with more than one in so many of all rows, and at least so many, is dealt out over several tasks.
SLICES, LEAST_SLICE = 2_000, 500
_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark wherever that folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of text, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local session may do without.

    A folder of this machine serves local sessions alone, as in tests: on a cluster executors would not see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir()
    return named or folder.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that an operator reads again."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Removes what scratch() named within the block; results must have been written by its end."""
    before = len(_scratch)
    try:
        yield
    finally:
        for path in _scratch[before:]:
            remove(spark, path)
        del _scratch[before:]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_evenly(
    rows: DataFrame, named: DataFrame, keys: list[str], count: str, spread: Column, total: int | None = None
) -> DataFrame:
    """rows joined to named (one row for each value of keys, which `count` of rows have), whatever the skew.

    total is how many rows there are, at least; they are counted if it is not known.

    A value of more than one in SLICES of the rows is hot: there are at most SLICES of those, so
    they are broadcast, its rows are dealt out by `spread` (which must differ among them and be
    the same in every run) and its row of named is repeated for each part.
    """
    if total is None:
        total = named.agg(F.sum(count).alias("n")).first()["n"] or 0
    size = max(LEAST_SLICE, -(-total // SLICES))
    parts = F.ceil(F.col(count) / size).cast("int")
    hot = named.where(F.col(count) > size).select(*[F.col(k).alias(f"_{k}") for k in keys], parts.alias("_parts"))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys])
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))
    )
    each = F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))))
    repeated = named.withColumn("_part", each).drop(count)
    return dealt.drop("_parts", *[f"_{k}" for k in keys]).join(repeated, [*keys, "_part"]).drop("_part")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(modulus: int, remainder: int):
    """Whether a row's crc32(doc_id as text) leaves this remainder; a null doc_id counts as ''."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "UTF-8")) % modulus) == remainder


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
