"""Plain, slow versions of what the operators return, written from their contracts alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str | None) -> str:
    return (text or "").translate({ord(c): c.lower() for c in UPPER})


def alnum_words(text: str | None) -> list[str]:
    return ALNUM_WORD.findall(lower_az(text))


def contamination(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated of one text."""
    words = alnum_words(text)
    hit: set[int] = set()
    names: set[str] = set()
    places: dict[int, dict[tuple, list[int]]] = {}
    for item_id, item in items:
        item_words = alnum_words(item)
        size = min(window, len(item_words))
        if size and size not in places:
            places[size] = {}
            for j in range(len(words) - size + 1):
                places[size].setdefault(tuple(words[j : j + size]), []).append(j)
        for i in range(len(item_words) - size + 1 if size else 0):
            for j in places[size].get(tuple(item_words[i : i + size]), []):
                hit |= set(range(j, j + size))
                names.add("null" if item_id is None else str(item_id))
    sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(words)


def fingerprint(text: str | None) -> int:
    words = BLANK_WORD.findall(lower_az(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius: int = 3) -> list[int]:
    """For each fingerprint the least place of its component."""
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [("assign", *m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[:3] for x in sorted(found, key=lambda x: (x[1], x[3]))]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def line_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def auc(scores: list[float], labels: list[int]) -> float:
    """Chance that a row of label 1 scores above one of label 0; ties count half."""
    ranked = sorted(zip(scores, labels, strict=True))
    pairs = wins = below = 0.0
    i = 0
    while i < len(ranked):
        j = i
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            j += 1
        same = [y for _, y in ranked[i:j]]
        zeros, ones = same.count(0), len(same) - same.count(0)
        wins += ones * (below + zeros / 2)
        below += zeros
        i = j
    n_one = sum(labels)
    pairs = n_one * (len(labels) - n_one)
    return wins / pairs
