"""Benchmark decontamination with an FM-index over each shard of training text.

A task gathers its documents into shards of bounded words and bytes and indexes
all words of a shard (a document that is longer lies in several, which overlap
by a window).  Test phrases are searched backward through wavelet-matrix ranks,
all at once; occurrences are located by walking to sampled suffix positions;
their spans are merged for each document.  Documents are never shuffled.

The benchmark is searched in blocks of at most BLOCK_WORDS words (more only if
one item alone has more), and one block is broadcast at a time: each block
after the first costs another pass over the documents, which are written in
between with the spans found so far.

Defined results: a null text or one without words has no words and is clean;
items without words are ignored, items with a null id are named 'null'; rows
that repeat are reported once each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ALNUM_WORD_RE, LOWER_SQL, WORD_BYTES, cut, small_batches

WINDOW_WORDS = 13
#: A document is contaminated if it has a hit and 1 word in so many is hit.
HIT_SHARE = 20
#: Words of benchmark text in a block, and words of a shard that are indexed together.
BLOCK_WORDS = 500_000
SHARD_WORDS = 400_000
#: Bytes of texts that wait for their shard, and of texts that are split into words together.
SHARD_BYTES, SPLIT_BYTES = 1 << 25, 1 << 20
#: Every so many positions of the indexed text a suffix position is kept.
SAMPLE_EVERY = 8
_END = b"\xff"  # no byte of UTF-8: ends a document in a batch's bytes


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Phrases:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        found: dict[tuple, set[str]] = {}
        for name, item in items:
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if item else 0):
                found.setdefault(tuple(item[i : i + size]), set()).add(name)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for p in found for w in p}), 1)}
        self.lengths = np.array([len(p) for p in found], np.int64)
        longest = max(map(len, found), default=0)
        self.symbols = np.zeros((len(found), longest), np.int32)
        for row, p in zip(self.symbols, found, strict=True):
            row[longest - len(p) :] = [self.vocabulary[w] for w in p]
        self.items = [tuple(sorted(x)) for x in found.values()]


class _Numbers(dict):
    """Numbers words from 1 in the order in which they are asked for; the end of a document is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class FMIndex:
    """An FM-index over word ids; 0 separates documents and no phrase has it."""

    def __init__(self, text: np.ndarray, sample_every: int = SAMPLE_EVERY):
        n = len(text)
        order = self._suffixes(text)
        before = text[order - 1]  # the symbol before each suffix; the first has the last, a 0
        self.top = int(text.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        # Wavelet matrix: bit planes from the highest, each stably parted by its bit.
        self.planes = []
        level = before.copy()
        for bit in range(self.top.bit_length() - 1, -1, -1):
            ones = (level >> bit) & 1
            ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            self.planes.append((bit, ranks, n - int(ranks[-1])))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        start = np.zeros(self.top + 2, np.int64)
        counts = np.bincount(level, minlength=self.top + 1)
        # Where each symbol starts in the last level, whose order is by reversed bits.
        at = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1]) if n else np.zeros(0, int)
        start[level[at]] = at
        self.level_start, self.counts = start, counts
        sampled = (order % sample_every == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling; separators count as distinct, in order of place.

        The first key holds as many symbols as fit in 63 bits; then only suffixes
        that still tie are sorted again.
        """
        n, zeros = len(text), text == 0
        m = int(zeros.sum())
        symbol = text.astype(np.int64) + m
        symbol[zeros] = np.arange(m)
        symbol += 1
        bits = int(symbol.max(initial=1)).bit_length()
        step = 63 // bits
        key = symbol.copy()
        for k in range(1, step):
            key <<= bits
            key[: max(0, n - k)] |= symbol[k:]
        order = np.argsort(key)
        places = np.arange(n)

        def firsts(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The place of the first of those that have the same key, in sorted order."""
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            return at[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]

        rank = np.empty(n, np.int64)
        if n:
            rank[order] = firsts(key[order], places)
        tied = places
        while len(tied):
            group = rank[order[tied]]
            again = np.concatenate([group[1:] == group[:-1], [False]])
            tied = tied[again | np.concatenate([[False], again[:-1]])]
            suffixes = order[tied]
            key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n - 1)]
            by_key = np.argsort(key)
            order[tied] = suffixes = suffixes[by_key]
            if len(tied):
                rank[suffixes] = firsts(key[by_key], tied)
            step *= 2
        return order

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the given row of the transform."""
        i = rows.astype(np.int64)
        for bit, ranks, zeros in self.planes:
            ones = ranks[i]
            i = np.where((symbols >> bit) & 1, zeros + ones, i - ones)
        return i - self.level_start[symbols]

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        """The symbol of the transform at each row."""
        i, out = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        for bit, ranks, zeros in self.planes:
            ones = ranks[i]
            one = ranks[i + 1] > ones
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return out

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one suffix row of each right-aligned phrase (0: no symbol)."""
        k = len(symbols)
        lo, hi = np.zeros(k, np.int64), np.full(k, len(self.sampled), np.int64)
        live = np.arange(k)
        for j in range(symbols.shape[1] - 1, -1, -1):
            c = symbols[live, j].astype(np.int64)
            some = (c > 0) & (hi[live] > lo[live])
            live, c = live[some], c[some]
            known = c <= self.top  # a phrase word that the text does not have is above
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix row."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            at = live[done]
            out[at] = self.positions[self.sample_rank[rows[at]]] + steps[at]
            live = live[~done]
            c = self.symbol(rows[live])
            rows[live] = self.first[c] + self.rank(c, rows[live])
            steps[live] += 1
        return out


Found = tuple[list[tuple[int, int]], set[str]]


def occurrences(
    text: np.ndarray, numbers: dict[bytes, int], phrases: Phrases, shard_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every phrase in a text of word numbers (0 ends a document)."""
    top = len(numbers)
    known = np.array([0, *[numbers.get(w, top) for w in phrases.vocabulary]], np.int32)
    symbols = known[phrases.symbols]
    some = np.flatnonzero((symbols < top).all(axis=1))
    overlap = phrases.symbols.shape[1] - 1
    size = -(-len(text) // max(1, len(text) // shard_words))  # less than two shards' words
    places, found = [], []
    for start in range(0, len(text) if len(some) else 0, max(1, size)):
        index = FMIndex(np.concatenate([[0], text[start : start + size + overlap], [0]]).astype(np.int32))
        lo, hi = index.search(symbols[some])
        many = np.maximum(hi - lo, 0)
        rows = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        places.append(index.locate(rows) + start - 1)
        found.append(np.repeat(some, many))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *found])


def _with_found(
    text: np.ndarray, numbers: dict[bytes, int], phrases: Phrases, shard_words: int, before: list[Found]
) -> list[Found]:
    """For each document of the text its spans of hit words and the items that occur, with those known before."""
    ends = np.flatnonzero(text == 0)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place, phrase = occurrences(text, numbers, phrases, shard_words)
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + phrases.lengths[phrase], -1)
    names = [set(items) for _, items in before]
    for row, (spans, _) in enumerate(before):
        for a, b in spans:
            edges[begins[row] + a] += 1
            edges[begins[row] + b] -= 1
    row = np.searchsorted(ends, place)
    for r, p in np.unique(np.column_stack([row, phrase]), axis=0).tolist():
        names[r].update(phrases.items[p])
    hit = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    change = np.flatnonzero(hit[1:] != hit[:-1])
    out: list[Found] = [([], n) for n in names]
    for a, b in change.reshape(-1, 2).tolist():
        r = int(np.searchsorted(ends, a))
        out[r][0].append((a - int(begins[r]), b - int(begins[r])))
    return out


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark's windows in blocks; only one is made at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = words(row["text"])
        if items and size + len(item) > block_words:
            yield Phrases(items, window)
            items, size = [], 0
        items.append(("null" if row["item_id"] is None else str(row["item_id"]), item))
        size += len(item)
    if items:
        yield Phrases(items, window)


def _searched(
    batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_words: int, state: str
) -> Iterator[tuple[pa.RecordBatch, list[int], list[Found]]]:
    """Each batch with the number of words of its rows, and their spans and items.

    A column named state holds what earlier blocks found, if there is one.
    """
    pending: list[tuple[pa.RecordBatch, list[int]]] = []
    texts: list[np.ndarray] = []
    numbers, n_words, n_bytes = _Numbers(), 0, 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[int], list[Found]]]:
        before: list[Found] = []
        for batch, _ in pending:
            at = batch.schema.get_field_index(state)
            known = [None] * batch.num_rows if at < 0 else batch.column(at).to_pylist()
            before += [
                ([(s["first"], s["end"]) for s in k["spans"]], set(k["items"])) if k else ([], set()) for k in known
            ]
        text = np.concatenate([np.zeros(0, np.int32), *texts])
        found = _with_found(text, numbers, phrases, shard_words, before)
        first = 0
        for batch, counts in pending:
            yield batch, counts, found[first : first + batch.num_rows]
            first += batch.num_rows

    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        counts: list[int] = []
        part: list[bytes] = []

        def split(part: list[bytes], counts: list[int]) -> int:
            tokens = (b" " + _END + b" ").join([*part, b""]).split()
            text = np.array(list(map(numbers.__getitem__, tokens)), np.int32)
            texts.append(text)
            counts += (np.diff(np.flatnonzero(text == 0), prepend=-1) - 1).tolist()
            return len(text)

        waiting = 0
        for value in column:
            text = (value.as_py() or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
            part.append(text)
            waiting += len(text)
            if waiting >= SPLIT_BYTES:
                n_words += split(part, counts)
                part, waiting = [], 0
        n_words += split(part, counts) if part else 0
        pending.append((batch, counts))
        n_bytes += batch.nbytes
        if n_words >= shard_words or n_bytes >= SHARD_BYTES:
            yield from flush()
            pending, texts, numbers, n_words, n_bytes = [], [], _Numbers(), 0, 0
    yield from flush()


def _contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and HIT_SHARE * hit >= n_words


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_STATE = pa.struct([("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_STATE_DDL = "struct<spans: array<struct<first: long, end: long>>, items: array<string>>"


def _spans(found: list[Found]) -> list[list[dict]]:
    return [[{"first": a, "end": b} for a, b in spans] for spans, _ in found]


def _through_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, shard_words: int, finish):
    """docs read by finish(batch, n_words, found) -> batch of a schema, after all blocks but the last."""
    spark = docs.sparkSession
    small_batches(spark)
    state = "_found"
    while state in docs.columns:
        state += "_"

    def searched(rows: DataFrame, phrases: Phrases, make, schema) -> DataFrame:
        shared = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, n_words, found in _searched(batches, shared.value, shard_words, state):
                yield make(batch, n_words, found)

        return rows.mapInArrow(run, schema)

    names = docs.columns

    def carry(batch: pa.RecordBatch, _, found: list[Found]) -> pa.RecordBatch:
        told = [{"spans": s, "items": sorted(n)} for s, (_, n) in zip(_spans(found), found, strict=True)]
        arrays = [batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(told, _STATE)], [*names, state])

    blocks = _blocks(benchmark, window, block_words)
    phrases, rows = next(blocks, None) or Phrases([], window), docs
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for following in blocks:
        rows, phrases = cut(searched(rows, phrases, carry, f"{kinds}, `{state}` {_STATE_DDL}")), following
    make, schema = finish
    return searched(rows, phrases, make, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items, items_sha256, contaminated, spans (of words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(batch: pa.RecordBatch, n_words: list[int], found: list[Found]) -> pa.RecordBatch:
        items = [sorted(names) for _, names in found]
        spans = [s for s, _ in found]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        bad = [_contaminated(n, s) for n, s in zip(n_words, spans, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(sha, pa.string()),
                pa.array(bad, pa.bool_()),
                pa.array(_spans(found), pa.list_(_SPAN)),
            ],
            ["doc_id", "n_words", "n_hit", "items", "items_sha256", "contaminated", "spans"],
        )

    schema = (
        f"doc_id {kind}, n_words long, n_hit long, items array<string>, items_sha256 string, "
        "contaminated boolean, spans array<struct<first: long, end: long>>"
    )
    return _through_blocks(docs.select("doc_id", "text"), benchmark, window, block_words, shard_words, (told, schema))


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    names = docs.columns

    def clean(batch: pa.RecordBatch, n_words: list[int], found: list[Found]) -> pa.RecordBatch:
        bad = [_contaminated(n, s) for n, (s, _) in zip(n_words, found, strict=True)]
        kept = batch.filter(pa.array([not b for b in bad], pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))], names)

    return _through_blocks(docs, benchmark, window, block_words, SHARD_WORDS, (clean, docs.schema))


#: DuckDB SQL for op2_decontamination: every window as text, joined to every window of the documents.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER_SQL}, '{ALNUM_WORD_RE}') AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({LOWER_SQL}, '{ALNUM_WORD_RE}') AS ws FROM benchmark
), c AS (
  SELECT item, ws, least({WINDOW_WORDS}, len(ws)) AS k FROM b WHERE len(ws) > 0
), w AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM c)
), p AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)
), h AS (
  SELECT rid, i, p.k, item FROM p JOIN w ON p.k = w.k AND p.phrase = w.phrase
), j AS (
  SELECT DISTINCT rid, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT rid, i, k FROM h)
), g AS (
  SELECT rid, j, j - row_number() OVER (PARTITION BY rid ORDER BY j) AS run FROM j
), s AS (
  SELECT rid, count(*) AS n, min(j) - 1 AS first, max(j) AS last FROM g GROUP BY rid, run
), t AS (
  SELECT rid, sum(n) AS n_hit, string_agg(first || ':' || last, ',' ORDER BY first) AS spans FROM s GROUP BY rid
), n AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {HIT_SHARE} * n_hit >= len(ws), false) AS contaminated,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid) LEFT JOIN n USING (rid)
"""
