"""Document quality from a linear-chain conditional random field over lines.

Every line that has a word is a node with two labels, good and bad.  Its
features are its own and those of the lines before and after it.  The chain is
fitted by conditional likelihood on a bounded number of labelled documents, whose
lines carry their document's label: all lines of their whole texts, in runs of
CHAIN_LINES, from which the executors add up one gradient a step.  A document's
quality is the mean of its lines' forward-backward marginals weighted by their
length, put on the scale of probabilities by a logistic step, which is fitted
on the means of the sample's whole texts.

Defined results: a text without a word (null, empty, blank) scores 0; rows
that repeat are scored once each; only the text is scored; without labels of
both kinds every other text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out, small_batches
from tidemark.llm.training import logistic, sigmoid, training_sample

#: Labelled documents that the model is fitted on, at most; lines of a training chain; gradient steps.
TRAIN_DOCUMENTS = 2000
CHAIN_LINES = 48
ROUNDS = 80
#: Tasks of a gradient step, at most: the documents are few, however many partitions they were found in.
TRAIN_TASKS = 64
THRESHOLD = 0.5

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _PIPE, _MARK = range(8)
_GROUPS = {
    _SPACE: b" \t\r\v\f",
    _UPPER: bytes(range(65, 91)),
    _LOWER: bytes(range(97, 123)),
    _DIGIT: b"0123456789",
    _SYMBOL: b"#*$%&<>@^~_=+\\/{}[]",
    _BANG: b"!",
    _PIPE: b"|",
    _MARK: b".,;:?-'\"()",
}
_CLASS = np.full(256, 8, np.uint8)
for _g, _bytes in _GROUPS.items():
    _CLASS[list(_bytes)] = _g
_HASH = np.random.default_rng(20).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_POWERS = np.random.default_rng(21).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | 1
OWN_FEATURES = 13


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, length, features) of each line that has a word, in order, over all texts."""
    lines: list[bytes] = []
    owner: list[int] = []
    repeated: list[bool] = []
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
            if line and not line.isspace():
                lines.append(line)
                owner.append(i)
                repeated.append(line in seen)
                seen.add(line)
    if not lines:
        return np.zeros(0, int), np.zeros(0), np.zeros((0, 3 * OWN_FEATURES), np.float32)
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    size = np.array([len(x) for x in lines])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kind = _CLASS[data]
    count = {
        g: np.add.reduceat(kind == g, start, dtype=np.int32) for g in range(1, 8)
    }
    word = kind != _SPACE
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    # Hashes of words: bytes times powers of their place, added up from word to word.
    inside = np.repeat(first, np.diff(np.append(first, len(data))))
    place = np.arange(first[0], len(data)) - inside
    part = np.where(word[first[0] :], _HASH[data[first[0] :]] * _POWERS[place & 63], np.uint64(0))
    hashes = np.add.reduceat(part, first - first[0])
    line_of = np.searchsorted(start, first, side="right") - 1
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])])
    n_words = np.bincount(line_of, minlength=len(lines))
    n_same = np.bincount(line_of[same], minlength=len(lines))
    stripped_end = np.array([x.rstrip()[-1:] in b".!?" for x in lines])
    own = np.column_stack(
        [
            np.log1p(size) / 8,
            np.log1p(n_words) / 6,
            np.minimum(size / np.maximum(n_words, 1), 40) / 10,
            count[_UPPER] / size,
            count[_LOWER] / size,
            count[_DIGIT] / size,
            count[_SYMBOL] / np.maximum(n_words, 1),
            count[_BANG] / np.maximum(n_words, 1),
            count[_PIPE] / np.maximum(n_words, 1),
            count[_MARK] / np.maximum(n_words, 1),
            n_same / np.maximum(n_words, 1),
            np.array(repeated),
            stripped_end,
        ]
    ).astype(np.float32)
    owner_ids = np.array(owner)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = owner_ids[1:] == owner_ids[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return owner_ids, size.astype(float), np.hstack([own, before, after])


@dataclass
class Chain:
    """Weights of a chain with labels bad (0) and good (1)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the standardised features and a constant: good against bad
    moves: np.ndarray  # 2 x 2 scores of a label after a label
    scale: tuple[float, float] = (1.0, 0.0)

    def emission(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -20, 20)

    def marginals(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of each line; chains lie one after the other, with these lengths."""
        return forward_backward(score, lengths, self.moves)[0]

    def document_means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The mean P(good) of each text's lines by their length, and which texts have a line."""
        owner, size, x = line_features(texts)
        mean, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
        if len(owner):
            lengths = np.bincount(owner, minlength=len(texts))
            good = self.marginals(self.emission(x), lengths[lengths > 0])
            weight = np.bincount(owner, size, len(texts))
            some = weight > 0
            mean[some] = np.bincount(owner, size * good, len(texts))[some] / weight[some]
        return mean, some

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        mean, some = self.document_means(texts)
        return np.where(some, sigmoid(self.scale[0] * mean + self.scale[1]), 0.0)


def forward_backward(
    score: np.ndarray, lengths: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of the moves over all chains.

    Chains are read side by side, the longest first, so each step handles all
    chains that still have a line.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    n = lengths[order]
    emit = np.exp(np.column_stack([-score / 2, score / 2]))
    step = np.exp(moves)
    longest = int(n[0])
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # chains longer than t
    ahead = np.ones_like(emit)
    back = np.ones_like(emit)
    a = None
    for t in range(longest):
        rows = first[: live[t]] + t
        a = emit[rows] if t == 0 else (a[: live[t]] @ step) * emit[rows]
        a /= a.sum(axis=1, keepdims=True)
        ahead[rows] = a
    counts = np.zeros((2, 2))
    b = np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        rows = first[:k] + t
        grown = np.ones((k, 2))
        grown[: len(b)] = b
        back[rows] = grown
        if t:
            into = emit[rows] * grown
            before = ahead[rows - 1]
            pair = before[:, :, None] * step[None] * into[:, None, :]
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = into @ step.T
            b /= b.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), counts


def added_up(runs: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of make(label of each line, features, lengths of the runs) over all runs: a row from each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            parts = [np.frombuffer(x, np.float32).reshape(-1, 3 * OWN_FEATURES) for x in batch.column(1).to_pylist()]
            if parts:
                lengths = np.array([len(x) for x in parts])
                label = np.repeat(batch.column(0).to_numpy(), lengths)
                total = total + make(label, np.vstack(parts).astype(float), lengths)
        if not np.isscalar(total):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], ["part", "total"])

    told = runs.mapInArrow(add, "part int, total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in sorted(told, key=lambda r: r["part"])), np.zeros(1))


def fit(runs: DataFrame, rounds: int = ROUNDS) -> Chain | None:
    """A chain that makes the labels of the lines likely, by gradient steps (Adam); None without both labels.

    runs: (label, x), one run of lines each.
    """
    d = 3 * OWN_FEATURES

    def moments(y: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        inner = np.ones(len(x), bool)
        inner[np.cumsum(lengths) - lengths] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        return np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0), seen.ravel()])

    told = added_up(runs, moments)
    if len(told) == 1 or not 0 < told[1] < told[0]:
        return None
    n, mean = told[0], told[2 : 2 + d] / told[0]
    spread = np.sqrt(np.maximum(told[2 + d : 2 + 2 * d] / n - mean**2, 0)) + 1e-3
    seen = told[-4:]
    chain = Chain(mean, spread, np.zeros(d + 1), np.zeros((2, 2)))
    m = v = np.zeros(d + 5)
    for k in range(1, rounds + 1):
        shared = runs.sparkSession.sparkContext.broadcast(chain)

        def slopes(y: np.ndarray, x: np.ndarray, lengths: np.ndarray, shared=shared) -> np.ndarray:
            now = shared.value
            good, counts = forward_backward(now.emission(x), lengths, now.moves)
            z = np.clip((x - now.mean) / now.spread, -6, 6)
            return np.concatenate([z.T @ (y - good), [(y - good).sum()], -counts.ravel()])

        slope = added_up(runs, slopes)
        shared.destroy()
        slope[-4:] += seen
        now = np.concatenate([chain.weights, chain.moves.ravel()])
        slope = slope / n - 1e-4 * now
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        now = now + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        chain = Chain(mean, spread, now[:-4], np.clip(now[-4:].reshape(2, 2), -4, 4))
    return chain


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Chain:
    """A chain fitted on labelled rows that are not held out."""
    sample = training_sample(docs, labels, "quality", 3, 1, limit)
    empty = Chain(
        np.zeros(3 * OWN_FEATURES),
        np.ones(3 * OWN_FEATURES),
        np.zeros(3 * OWN_FEATURES + 1),
        np.zeros((2, 2)),
    )
    empty.scale = (0.0, 0.0)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_pylist()
            owner, _, x = line_features(batch.column(1).to_pylist())
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = [
                (label[i], x[k : min(k + CHAIN_LINES, end)].tobytes())
                for i, (first, end) in enumerate(zip(starts, starts[1:], strict=False))
                for k in range(first, end, CHAIN_LINES)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["label", "x"]
            )

    small_batches(docs.sparkSession)
    runs = sample.select((F.col("label") > 0).cast("int"), "text").mapInArrow(chains, "label int, x binary")
    tasks = min(TRAIN_TASKS, docs.sparkSession.sparkContext.defaultParallelism)
    chain = fit(cut(runs.coalesce(max(1, tasks))))
    if chain is None:
        return empty
    shared = sample.sparkSession.sparkContext.broadcast(chain)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, some = shared.value.document_means(batch.column(1).to_pylist())
            told = pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean)], ["label", "mean"])
            yield told.filter(pa.array(some))

    told = sample.select("label", "text").mapInArrow(means, "label int, mean double").collect()
    told = sorted((int(r["label"] > 0), r["mean"]) for r in told)
    a, b = logistic(np.array([[m] for _, m in told]), np.array([y for y, _ in told], float), ridge=1e-3)
    chain.scale = (float(a), float(b))
    return chain


def quality(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted; no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.document_scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
