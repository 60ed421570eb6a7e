"""The toxicity grammar: machines in turn, what the finder may skip, and lists for each language."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.llm import toxicity
from tidemark.llm.toxicity import GRAMMAR, NEGATION, REPORT, START, TARGET, Grammar


def test_the_composed_machine_is_its_machines_in_turn():
    rng = random.Random(3)
    for _ in range(500):
        tape = rng.choices("IHTNRO", k=rng.randint(1, 15))
        state, states = START, [0, 0, 0]
        for x in tape:
            state, factor = GRAMMAR[state, x]
            parts = [m[s, x] for m, s in zip((TARGET, NEGATION, REPORT), states, strict=True)]
            states = [p[0] for p in parts]
            assert factor == pytest.approx(math.prod(p[1] for p in parts))
            assert state == tuple(states)


def test_no_text_that_an_arc_matches_is_skipped():
    grammar = Grammar({"idiot": 3.0, "mor*": 2.0, "ñoq*": 2.0})
    rng = random.Random(4)
    parts = ["idiot", "idiots", "xidiot", "moron", "tumor", "kill", "skill", "ñoque", "töten", "you", " ", ". ", "-", "\n", "9"]
    found = 0
    for _ in range(5_000):
        low = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        hits = sum(grammar.clause(toxicity.WORD.findall(c), lang)[2] for c in toxicity.CLAUSE.split(low) for lang in toxicity.LISTS)
        found += hits > 0
        assert grammar.touched(low) or not hits
    assert found > 1_000


@pytest.mark.parametrize(
    ("text", "language"),
    [
        ("the price of the bread is high", "en"),
        ("der Preis von dem Brot ist hoch", "de"),
        ("el precio de los panes es alto", "es"),
        ("le prix du pain est dans les mains", "fr"),
        ("", "en"),
    ],
)
def test_the_language_is_told_from_the_text(text, language):
    assert toxicity.language_of(text.lower().split()) == language


def test_words_of_other_languages_do_not_count():
    grammar = Grammar({"idiot": 3.0})
    total = lambda text: math.expm1(grammar.features(text)[0])
    # French "du" is no German "you"; English "sin" is no Spanish "without".
    assert total("le prix du pain idiot est dans les mains") == pytest.approx(3.0)
    assert total("tu es idiot et le pain est dans les mains") == pytest.approx(3.75)
    assert total("sin is idiot and the bread is in the house") == pytest.approx(3.0)
    assert total("not idiot and the bread is in the house") == pytest.approx(1.8)
    assert total("du idiot und der Preis ist nicht hoch") == pytest.approx(3.75)
