"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to symbols: insult, threat, target, negation, report or other, by the
lists of the language that most of the text's common words belong to (one
language's target may be another's article).  Small transducers weigh an insult or threat by what stands around it in its
clause (a target strengthens it, a near negation or reported speech weakens
it); they are composed into one machine that reads a clause once in each
direction.  A document's clause scores are summed up by a logistic model.

The insult arcs are whole words and stems (prefixes) learned from a bounded
sample of labelled rows: those that toxic texts have far more often than clean
ones, taken greedily until every toxic text of the sample is covered twice (so
there are never more than two thirds as many as rows in the sample).
The fixed insults below stand beside the learned arcs, and alone where there are no labels.

Defined results: a null, empty or wordless text scores as a text without a
match; rows that repeat are scored once each; only the text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out, small_batches
from tidemark.llm.training import logistic, sigmoid, training_sample

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCUMENTS = 6000
#: An arc is in so many toxic texts at least, and so much likelier there (natural logarithm).
LEAST_TEXTS = 3
LEAST_ODDS = 2.5
#: How many times likelier in toxic texts of the whole sample an arc is to be looked at.
TELLING = 8
STEMS = range(3, 8)
COVER = 2
THRESHOLD = 0.3

# Fixed word lists of the grammar, for each language; insults stand beside those that are learned.
INSULTS = "idiot moron stupid scum loser pathetic worthless trash idiota imbécil idiote imbécile dummkopf"
LISTS = {
    "en": {
        "common": "the and of to in is it that for with are was on as be this at by from have or not",
        "threat": "kill hurt destroy beat shoot stab strangle",
        "target": "you your yours they them their he him she her this these those",
        "negation": "not no never isn aren don doesn wasn without nobody",
        "report": "said says told called quoted wrote writes claimed",
    },
    "de": {
        "common": "der die das und ist nicht ein eine mit von zu den im auf für es dem auch sich ich",
        "threat": "töten töte umbringen schlagen erschießen erstechen vernichten",
        "target": "du dich dir dein deine ihr euch sie ihnen er ihn",
        "negation": "nicht kein keine keinen nie niemals ohne niemand",
        "report": "sagte sagt schrieb schreibt nannte behauptete zitierte",
    },
    "es": {
        "common": "el la los las de que y en un una es por con para se del al lo como más",
        "threat": "matar matarte mato golpear destruir disparar apuñalar",
        "target": "tú tu usted ustedes vosotros ellos ellas él ella ese esos",
        "negation": "no ni sin nunca jamás nadie tampoco",
        "report": "dijo dice escribió escribe llamó afirmó citó",
    },
    "fr": {
        "common": "le la les de des du et en un une est que dans pour pas sur au avec ce il",
        "threat": "tuer tue frapper détruire poignarder abattre massacrer",
        "target": "tu toi vous vos votre ils elles lui elle eux ces",
        "negation": "pas ne jamais aucun aucune sans personne ni",
        "report": "dit disait écrit écrivit appela affirma cita",
    },
}
_SYMBOL = {"threat": "H", "target": "T", "negation": "N", "report": "R"}
SYMBOLS = {
    lang: {w: x for kind, x in _SYMBOL.items() for w in lists[kind].split()} for lang, lists in LISTS.items()
}
#: Every word that could be a threat, whatever the language.
THREATS = frozenset(w for lists in LISTS.values() for w in lists["threat"].split())

WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[.!?;:|\n]+")

_COMMON = {lang: frozenset(lists["common"].split()) for lang, lists in LISTS.items()}

Machine = dict[tuple, tuple]


def _machine(states: int, step, factor) -> Machine:
    return {(s, x): (step(s, x), factor(s, x)) for s in range(states) for x in "IHTNRO"}


#: A target anywhere before strengthens; a threat needs one to count in full.
TARGET = _machine(
    2,
    lambda s, x: 1 if x == "T" else s,
    lambda s, x: (1.25 if s else 1.0) if x == "I" else (1.0 if s else 0.3) if x == "H" else 1.0,
)
#: A negation up to two words before weakens.
NEGATION = _machine(
    3,
    lambda s, x: 2 if x == "N" else max(0, s - 1),
    lambda s, x: 0.6 if s and x in "IH" else 1.0,
)
#: Reported speech in the clause weakens what follows.
REPORT = _machine(
    2, lambda s, x: 1 if x == "R" else s, lambda s, x: 0.6 if s and x in "IH" else 1.0
)


def compose(*machines: Machine) -> tuple[tuple, Machine]:
    """The start and the transitions of machines that read the same symbols; factors multiply."""
    start = (0,) * len(machines)
    out: Machine = {}
    todo = [start]
    while todo:
        state = todo.pop()
        for x in "IHTNRO":
            if (state, x) not in out:
                parts = [m[s, x] for m, s in zip(machines, state, strict=True)]
                after = tuple(p[0] for p in parts)
                out[state, x] = (after, math.prod(p[1] for p in parts))
                todo.append(after)
    return start, out


#: What a clause is read by: forward by all machines, backward for targets that stand later.
START, GRAMMAR = compose(TARGET, NEGATION, REPORT)


def language_of(words: Iterable[str]) -> str:
    """The language of LISTS to whose common words most of the words belong; the first of equals."""
    seen = Counter(words)
    return max(LISTS, key=lambda lang: sum(seen[w] for w in _COMMON[lang]))


def features_of(word: str) -> Iterator[str]:
    """The arcs that read a word: itself and its stems, a star at their end."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield word[:k] + "*"


@dataclass
class Grammar:
    """Weighted arcs and the logistic model over a document's clause scores."""

    arcs: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [1.0, 0.5, 0.5, 0.5, 0.5, -4.0])

    def __post_init__(self):
        self._finder = None

    def __getstate__(self):
        return {"arcs": self.arcs, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, word: str) -> float:
        """The greatest weight of the insult arcs that read the word."""
        return max((self.arcs[f] for f in features_of(word) if f in self.arcs), default=0.0)

    def finder(self):
        """Finds the texts that any arc could match; made once a process."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for a in {*self.arcs, *THREATS}:
                stem = a.removesuffix("*")
                self._finder.add_word(stem, (len(stem), not a.endswith("*")))
            self._finder.make_automaton()
        return self._finder

    def touched(self, low: str) -> bool:
        """Whether an arc matches at the start of a word."""
        n = len(low)
        for end, (size, whole) in self.finder().iter(low):
            a = end - size
            if (a < 0 or not low[a].isalnum()) and not (
                whole and end + 1 < n and low[end + 1].isalnum()
            ):
                return True
        return False

    def clause(self, words: list[str], language: str = "en") -> tuple[float, set[str], int]:
        """Score of a clause, and the matched words and their number."""
        tape, symbols = [], SYMBOLS[language]
        for w in words:
            weight = self.weight(w)
            tape.append(("I" if weight else symbols.get(w, "O"), weight or 1.0, w))
        if not any(x in "IH" for x, _, _ in tape):
            return 0.0, set(), 0
        later, seen = [], 0
        for x, _, _ in reversed(tape):
            seen, factor = TARGET[seen, x]
            later.append(factor)
        state, seen, total = START, 0, 0.0
        for (x, weight, _), after in zip(tape, reversed(later), strict=True):
            state, factor = GRAMMAR[state, x]
            seen, before = TARGET[seen, x]
            if x in "IH":
                total += weight * factor * max(1.0, after / before)
        hits = [w for x, _, w in tape if x in "IH"]
        return total, set(hits), len(hits)

    def features(self, text: str | None) -> list[float]:
        """What the logistic model reads of a whole text."""
        low = (text or "").lower()
        if not low or not self.touched(low):
            return [0.0] * 5
        total = top = 0.0
        distinct: set[str] = set()
        hits = 0
        clauses = [WORD.findall(part) for part in CLAUSE.split(low)]
        language = language_of(w for words in clauses for w in words)
        for words in clauses:
            score, found, n = self.clause(words, language)
            total, top, hits = total + score, max(top, score), hits + n
            distinct |= found
        dense = 6000 * total / (300 + len(low))
        return [math.log1p(x) for x in (total, top, hits, len(distinct), dense)]

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 5)
        w = np.array(self.weights)
        return sigmoid(x @ w[:-1] + w[-1])


def _counts(sample: DataFrame) -> DataFrame:
    """(arc, half, toxic, clean): how many texts of the sample have each arc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[2 * half + (label > 0)].update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
        rows = [(a, k // 2, n * (k % 2), n * (1 - k % 2)) for k, c in seen.items() for a, n in c.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
            ["arc", "half", "toxic", "clean"],
        )

    return (
        sample.select("text", "label", "half")
        .mapInArrow(run, "arc string, half long, toxic long, clean long")
        .groupBy("arc", "half")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _arcs(
    toxic: Counter, clean: Counter, texts: list[set[str]], n_toxic: int, n_clean: int
) -> dict[str, float]:
    """Arcs that cover the toxic texts, the most telling first, and their weights."""
    odds = {
        a: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean[a] + 0.5) / (n_clean + 1))
        for a, t in toxic.items()
        if t >= LEAST_TEXTS
    }
    strong = {a for a, o in odds.items() if o >= LEAST_ODDS}
    holders: dict[str, set[int]] = defaultdict(set)
    for i, arcs in enumerate(texts):
        for a in arcs & strong:
            holders[a].add(i)
    need = [COVER] * len(texts)
    order = sorted(holders, key=lambda a: (-len(holders[a]) * odds[a], -len(a), a))
    out: dict[str, float] = {}
    for a in order:
        gain = sum(need[i] > 0 for i in holders[a])
        # A stem of a chosen arc, or a word of a chosen stem, must tell more than that one.
        stem = a.removesuffix("*")
        related = (o for b, o in out.items() if stem.startswith(s := b.removesuffix("*")) or s.startswith(stem))
        if gain >= LEAST_TEXTS and odds[a] > max(related, default=0.0):
            out[a] = min(8.0, odds[a])
            for i in holders[a]:
                need[i] -= 1
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Grammar:
    """A grammar fitted on labelled rows that are not held out; the fixed one without labels."""
    plain = Grammar(dict.fromkeys(INSULTS.split(), 3.0))
    sample = training_sample(docs, labels, "toxic", 4, 2, limit)
    sizes = {(r["half"], r["label"] > 0): r["n"] for r in sample.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    if sum(n for (_, bad), n in sizes.items() if bad) < LEAST_TEXTS:
        return plain
    size = {bad: sizes.get((0, bad), 0) + sizes.get((1, bad), 0) for bad in (True, False)}
    counted = cut(_counts(sample))
    # Arcs of several toxic texts that tell them from clean ones: the others cannot become part of the grammar.
    strong = (
        counted.groupBy("arc")
        .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where(F.col("t") >= LEAST_TEXTS)
        .where((F.col("t") + 0.5) * (size[False] + 1) > TELLING * (F.col("c") + 0.5) * (size[True] + 1))
        .select("arc")
    )
    count: dict[tuple, Counter] = defaultdict(Counter)
    for r in counted.join(strong, "arc").collect():
        count[r["half"], True][r["arc"]] = r["toxic"]
        count[r["half"], False][r["arc"]] = r["clean"]
    telling = set(count[0, True]) | set(count[1, True])
    shared = sample.sparkSession.sparkContext.broadcast(telling)

    def arcs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arcs = [
                sorted({f for w in set(WORD.findall(t.lower())) for f in features_of(w)} & shared.value)
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arcs, pa.list_(pa.string()))], ["half", "arcs"])

    toxic_texts = [
        (r["half"], set(r["arcs"]))
        for r in sample.where("label > 0").select("half", "text").mapInArrow(arcs_of, "half long, arcs array<string>").collect()
    ]

    def learned(halves: tuple[int, ...]) -> dict[str, float]:
        toxic = sum((count[h, True] for h in halves), Counter())
        clean = sum((count[h, False] for h in halves), Counter())
        n = [sum(sizes.get((h, bad), 0) for h in halves) for bad in (True, False)]
        return _arcs(toxic, clean, [a for h, a in toxic_texts if h in halves], *n)

    # The logistic model is fitted on the half from which its arcs were not learned.
    first = Grammar({**plain.arcs, **learned((0,))})
    carried = sample.sparkSession.sparkContext.broadcast(first)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [carried.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    other = sample.where("half = 1").select("text", "label")
    rows = other.mapInArrow(read, "x array<double>, label int").collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["x"]))
    grammar = Grammar({**plain.arcs, **learned((0, 1))})
    y = np.array([r["label"] > 0 for r in rows], float)
    if 0 < y.sum() < len(y):
        grammar.weights = logistic(np.array([r["x"] for r in rows]), y).tolist()
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted; no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(shared.value.scores(texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
