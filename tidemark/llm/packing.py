"""Sequence packing by the linear grouping scheme.

Documents become token ids and are cut into pieces only where they are longer
than a sequence.  The plan is made from the histogram of piece lengths alone,
which has no more entries than a sequence has tokens, whatever the input:

1. large lengths are rounded up within groups of equal cardinality;
2. a cutting-stock linear programme over those few sizes (column generation)
   gives configurations and how often each is used;
3. actual pieces take the places of the rounded sizes, the last of a sequence
   the longest that still fits;
4. the rest, largest first, then the small pieces go where they fit best.

The programme is solved for a few bounds of large lengths and numbers of groups and the plan with the
fewest sequences is kept; with large lengths above half a sequence it is never
worse than best-fit-decreasing.  Pieces get their rank within their length
through bucket counts (a length has as many buckets as it has pieces for), so a
length that very many pieces share is never gathered in one task, and a rank
names its sequence and its place there by arithmetic.

Defined results: a null or empty text is the closing id alone; rows that
repeat are packed once each; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_names, scratch, small_batches

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
#: Tried one after the other: lengths above this share of a sequence are large, and so many groups.
SCHEMES = ((1 / 4, 16), (0.4, 16), (0.4, 48), (0.5, 48))
#: Exchanges of configurations without gain after which they are taken as they are.
PATIENCE = 1_000
#: Columns of pieces that places are found from.
NARROW = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Chunks, and words, in each of the two generations whose ids a process keeps.
_CACHE_ENTRIES = 350_000
_BATCH_ROWS = 4096

#: Letters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters stand
#: for themselves, the other bytes for the characters from 256 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

_tokenizers: dict[str, ChunkTokenizer] = {}


class _Kept(dict):
    """Values made where a key is missing; those not asked for again for long are let go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= _CACHE_ENTRIES:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkTokenizer:
    """Ids of texts by a tokenizers file, with the ids of words kept.

    The tokenizer drops white space and never joins what stands on both sides
    of it, so a text's ids are those of its chunks between blanks.  Chunks of
    plain Latin letters are lower-cased and split here by the file's own
    pattern and only new words go to its model; every other chunk goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.plain = re.compile("[!-;=-~À-ÖØ-öø-þ]+")  # no "<": special tokens start with it
        self.tokenize = self.tokenizer.model.tokenize
        self.words = _Kept(self._word)
        self.chunks = _Kept(self._chunk)

    @staticmethod
    def of(name: str) -> ChunkTokenizer:
        if name not in _tokenizers:
            import public_tokenizers

            _tokenizers[name] = ChunkTokenizer(public_tokenizers.path(name))
        return _tokenizers[name]

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.plain.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return self.words[low]
            if low[-1] in ".,!" and low[:-1].isalpha():
                return self.words[low[:-1]] + self.words[low[-1]]
            return b"".join([self.words[w] for w in self.pattern.findall(low)])
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else []
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkTokenizer.of(tokenizer).encode
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + bytes(4)
                for k, a in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * a : 4 * (a + capacity)]
                    owner.append(i)
                    rows.append((k, a, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(cols[0], pa.int32()),
                *(pa.array(c, pa.int64()) for c in cols[1:4]),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids binary" * with_ids)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of sizes that fit in the capacity and are worth most together."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = np.flatnonzero(sizes <= c)
        value = best[c - sizes[fit]] + worth[fit]
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], last[c] = value[k], fit[k]
        else:
            best[c], last[c] = best[c - 1], -1
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] >= 0:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
        else:
            c -= 1
    return out


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> list[tuple[int, np.ndarray]]:
    """(times, counts of sizes): whole uses of the configurations of the linear optimum.

    Configurations are exchanged until none saves anything; as there are few sizes and finitely many
    configurations that ends, but for ties, which PATIENCE exchanges without gain settle.
    """
    basis = np.diag((capacity // sizes).astype(float))
    use = demand / (capacity // sizes)
    best, idle = np.inf, 0
    while idle < PATIENCE:
        if use.sum() < best - 1e-9 * max(1.0, use.sum()):
            best, idle = use.sum(), 0
        idle += 1
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = _best_pattern(sizes, worth, capacity)
        if new @ worth <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        k = int(ratio.argmin())
        use = use - ratio[k] * step
        use[k] = ratio[k]
        use = np.maximum(use, 0)
        basis[:, k] = new
    return [
        (int(u + 1e-9), basis[:, k].astype(int)) for k, u in enumerate(use) if int(u + 1e-9) > 0
    ]


def rounded_sizes(large: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """Pieces of large lengths (length and count, largest first) in groups of equal cardinality, by the size they round up to."""
    ends = np.cumsum([n for _, n in large])
    edges = [int(ends[-1]) * i // groups for i in range(groups + 1)]
    out: dict[int, int] = {}
    for first, end in zip(edges, edges[1:], strict=False):
        if end > first:
            size = large[int(np.searchsorted(ends, first, side="right"))][0]
            out[size] = out.get(size, 0) + end - first
    return out


Bin = tuple[int, int, tuple[tuple[int, int], ...]]  # times, free tokens, (length, pieces) pairs


def _best_fit(bins: list[Bin], rest: dict[int, int], capacity: int) -> list[Bin]:
    """Place the rest, largest first, each where the least space is free that holds it."""
    by_free: dict[int, list[Bin]] = {}
    for b in bins:
        by_free.setdefault(b[1], []).append(b)
    frees = np.zeros(capacity + 1, bool)
    frees[list(by_free)] = True
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fit = np.flatnonzero(frees[length:])
            if len(fit):
                free = int(fit[0]) + length
                times, _, held = by_free[free].pop()
                if not by_free[free]:
                    frees[free] = False
            else:
                free, held = capacity, ()
                times = -(-n // (capacity // length))
            each = min(free // length, n)
            used = min(times, n // each)
            for k, x in ((used, each), (times - used, 0)):
                if k:
                    left = free - x * length
                    by_free.setdefault(left, []).append((k, left, (*held, (length, x)) if x else held))
                    frees[left] = True
            n -= used * each
    return [b for same in by_free.values() for b in same if b[2]]


def substituted(
    left: np.ndarray, sizes: list[int], times: int, least: int, capacity: int
) -> list[Bin]:
    """Sequences of one configuration with actual pieces, taken from left (how many there are of each length).

    A place takes the longest piece that its rounded size holds; the last one the longest that the space
    left holds, be it of another group.  Where a length runs out another kind of sequence begins.
    """
    out: list[Bin] = []
    while times:
        free, held = capacity, {}
        for i, size in enumerate(sizes):
            top = free if i == len(sizes) - 1 else min(free, size)
            fit = np.flatnonzero(left[least : top + 1]) + least
            length = next((n for n in fit[::-1].tolist() if left[n] > held.get(n, 0)), None)
            if length is None:
                break
            held[length] = held.get(length, 0) + 1
            free -= length
        if not held:
            break
        used = min(times, *(int(left[n]) // c for n, c in held.items()))
        out.append((used, free, tuple(held.items())))
        for n, c in held.items():
            left[n] -= used * c
        times -= used
    return out


def plan(
    histogram: dict[int, int],
    capacity: int = SEQUENCE_TOKENS,
    large_share: float = 0.4,
    groups: int = 16,
) -> list[Bin]:
    """Kinds of sequences that together hold each length as often as the histogram says."""
    rest = {n: c for n, c in histogram.items() if c > 0}
    bins: list[Bin] = [(rest.pop(capacity), 0, ((capacity, 1),))] if capacity in rest else []
    least = int(large_share * capacity) + 1
    large = [(n, rest.pop(n)) for n in sorted(rest, reverse=True) if n >= least]
    if large:
        demand = rounded_sizes(large, groups)
        sizes = np.array(sorted(demand, reverse=True))
        left = np.zeros(capacity + 1, np.int64)
        for n, c in large:
            left[n] = c
        for times, counts in configurations(sizes, np.array([demand[s] for s in sizes.tolist()], float), capacity):
            bins += substituted(left, np.repeat(sizes, counts).tolist(), times, least, capacity)
        rest |= {n: int(left[n]) for n in np.flatnonzero(left).tolist()}
    return _best_fit(bins, rest, capacity)


def best_plan(histogram: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> list[Bin]:
    """The plan with the fewest sequences among those of SCHEMES."""
    plans = [plan(histogram, capacity, share, groups) for share, groups in SCHEMES]
    return min(plans, key=lambda bins: sum(b[0] for b in bins))


def places(bins: list[Bin]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, of each run of ranks: where it starts, its first sequence, pieces in each, their offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, _, held in bins:
        offset = 0
        for length, each in held:
            at = ranks.get(length, 0)
            runs.setdefault(length, []).append((at, first, each, offset))
            ranks[length] = at + times * each
            offset += length * each
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack(cut_pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset (replaced where they are) to pieces (doc_id, piece, start, length, ids_crc32 and any others).

    Other columns, as ids, are not moved while places are found: they are joined back by a row key.
    """
    spark = cut_pieces.sparkSession
    more = [c for c in cut_pieces.columns if c.lower() not in (*NARROW, "sequence_id", "offset")]
    (row,) = free_names(cut_pieces, "_row")
    keyed = cut_pieces.select(*NARROW, *more, F.monotonically_increasing_id().alias(row))
    if more:
        path = scratch(spark, "pieces")
        keyed.write.parquet(path)
        whole = spark.read.parquet(path)
        held = whole.select(*NARROW, F.col(row).alias("_row"))
    else:
        held = whole = cut(keyed)
    # A row for each length, so capacity rows at most.
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = spark.sparkContext.broadcast(places(best_plan(histogram, capacity)))
    size = math.isqrt(sum(histogram.values())) + 1  # of a bucket: as many buckets as pieces in one
    parts = spark.createDataFrame([(n, -(-k // size)) for n, k in histogram.items()], "length long, parts int")
    dealt = held.join(F.broadcast(parts), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int")
    )
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket")
    starts = counts.select(
        "length", "bucket", (F.sum("n").over(before) - F.col("n")).alias("before")
    )
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = dealt.join(starts, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(order) - 1
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(ranks), 2), np.int64)
        values, known = ranks.to_numpy(), at.value
        for length, rows in lengths.groupby(lengths).indices.items():
            starts, first, each, offset = known[int(length)]
            run = np.searchsorted(starts, values[rows], side="right") - 1
            whole, inside = np.divmod(values[rows] - starts[run], each[run])
            out[rows, 0] = first[run] + whole
            out[rows, 1] = offset[run] + inside * length
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.select("_row", *NARROW, place("length", "rank").alias("place"))
    if not more:
        return placed.select(*NARROW, "place.sequence_id", "place.offset")
    placed = placed.select(F.col("_row").alias(row), "place.sequence_id", "place.offset")
    return whole.join(placed, row).select(*NARROW, *more, "sequence_id", "offset")
