"""Secret scanning: fixed patterns and a token-efficiency test.

Three patterns name secrets by their shape.  The method adds random strings:
a run of key characters that a public tokenizer's vocabulary splits into very
short tokens (few characters a token) is no language, unless it is a known
digest, a UUID, a number or an identifier whose letter parts the vocabulary
reads as words.  A run is tested whole, then its parts; what remains of it
around a hex string is tested like a run.

Defined results: a null or empty text has no spans; spans count code points
with the end exclusive; rows that repeat are reported once each; other columns
are kept by redact() and ignored by find_secrets().
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
#: The base patterns and the least length of a secret of each kind.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24
#: Every run of hex digits of HEX_LEAST lies within a run of these.
KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A parameter of the test: so few characters a token tell nothing of a shorter string.
KEY_LEAST = 16
#: Where a run that is not random as a whole is split, one after the other.
SEPARATORS = ("/=", "_-")
JOINTS = "/=_-"
LETTERS = re.compile("[A-Za-z]+")
#: A string with fewer characters a token than this is random.
LEAST_CHARS_PER_TOKEN = 2.0
VOCABULARY = "byte_bpe_50k.tiktoken"
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
IDENTIFIER = re.compile("[A-Za-z_/=-]*[0-9]{0,4}|[0-9_+/=-]+")

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tiktoken encoding of a public vocabulary file, made once a process."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[vocabulary]


def _tokens(run: str, vocabulary: str) -> int:
    """How many tokens a whole run takes, however long it is."""
    return len(encoder(vocabulary).encode_ordinary(run))


def _reads_as_words(run: str, vocabulary: str, least: float) -> bool:
    """Whether each letter part is a single letter or takes few tokens of the vocabulary."""
    return all(len(x) == 1 or len(x) >= least * _tokens(x, vocabulary) for x in LETTERS.findall(run))


def _is_known(run: str) -> bool:
    """Whether a run is a digest or a UUID as a whole."""
    return bool(UUID.fullmatch(run) or (DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS))


def is_random(run: str, vocabulary: str = VOCABULARY, least: float = LEAST_CHARS_PER_TOKEN) -> bool:
    """Whether a run of key characters is a random string and no known kind of name."""
    if _is_known(run) or not LETTERS.search(run):
        return False
    if len(run) >= least * _tokens(run, vocabulary):
        return False
    return not (IDENTIFIER.fullmatch(run) and _reads_as_words(run, vocabulary, least))


def random_parts(run: str, at: int, vocabulary: str, separators=SEPARATORS) -> Iterator[tuple[int, int]]:
    """Places of a run that is random as a whole, else of its random parts between separators."""
    if len(run) < KEY_LEAST or _is_known(run):
        return
    if is_random(run, vocabulary):
        yield at, at + len(run)
    elif separators:
        for part in re.finditer(f"[^{separators[0]}]+", run):
            yield from random_parts(part[0], at + part.start(), vocabulary, separators[1:])


def spans(text: str | None, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every secret of a whole text, in order."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    for run in KEY_RUN.finditer(text):
        at = run.start()
        hexes = [m.span() for m in HEX.finditer(run[0]) if m.end() - m.start() >= HEX_LEAST]
        found += [(at + a, at + b, 2) for a, b in hexes]
        # What remains around hex strings is judged without them and what joins it to them.
        edges = [0, *(x for h in hexes for x in h), len(run[0])]
        for k in range(0, len(edges), 2):
            rest = run[0][edges[k] : edges[k + 1]]
            if k:
                rest = rest.lstrip(JOINTS)
            a = edges[k + 1] - len(rest)
            if k + 2 < len(edges):
                rest = rest.rstrip(JOINTS)
            found += [(*x, 3) for x in random_parts(rest, at + a, vocabulary)]
    return sorted((a, k, b) for a, b, k in found)


def _text(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans (text) and secrets (array)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t, vocabulary) for t in batch.column(1).to_pylist()]
            base = [[x for x in f if x[1] < 3] for f in found]
            count = [
                pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)
            ]
            sha = [hashlib.sha256(_text(f).encode()).hexdigest() for f in base]
            all_spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *count,
                    pa.array(sha, pa.string()),
                    pa.array(map(_text, found), pa.string()),
                    pa.array(all_spans, pa.list_(struct)),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string, secrets array<struct<kind: string, start: long, end: long>>",
    )


def redacted(text: str | None, vocabulary: str = VOCABULARY, mark: str = "[SECRET]") -> str | None:
    """The text with every stretch that secrets cover replaced by a mark."""
    if not text:
        return text
    out, at, last = [], 0, -1
    for a, _, b in spans(text, vocabulary):
        if a >= max(at, last):
            out += [text[at:a], mark]
        at = last = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same rows and columns with secrets replaced in text; n_chars follows, if there is one."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, vocabulary), na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out
