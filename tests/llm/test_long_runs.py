"""Secret scanning takes time in proportion to a text, and agrees with a plain version on any text."""

from __future__ import annotations

import random
import string
import time

import pytest

from tests.llm import brute
from tidemark.llm import secret_scan

KEY_CHARS = string.ascii_letters + string.digits + "+/_=-"


@pytest.mark.parametrize("run", ["a" * 1_000_000 + "+", "Zq" * 500_000 + "+", "g_" * 500_000, "password " * 100_000])
def test_a_long_run_takes_little_time(run):
    secret_scan.encoder()
    began = time.time()
    secret_scan.spans(run)
    assert time.time() - began < 5


def test_a_long_random_run_is_one_span():
    run = "".join(random.Random(5).choices(string.ascii_letters, k=100_000))
    assert secret_scan.spans(f"x {run} y") == [(2, 3, 100_002)]


@pytest.mark.parametrize("size", [2_047, 2_049, 5_000, 70_000])
def test_long_runs_are_tokenised_whole(size):
    encode = secret_scan.encoder().encode_ordinary
    rng = random.Random(size)
    for _ in range(5):
        words = ("licht", "schatten", "AbC", "x9", "qqzx", "tion")
        run = "".join(rng.choices(words, k=size))[:size]
        efficient = len(run) >= secret_scan.LEAST_CHARS_PER_TOKEN * len(encode(run))
        assert secret_scan.is_random(run) == (not efficient)


def test_base_spans_of_random_texts():
    rng = random.Random(6)
    parts = ["password", "Secret", "api_key", "apikey", "token", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "=", ": ", "'", '"', " ", "\n", "ſ", "é", "xyz", "K"]
    for _ in range(4_000):
        text = "".join(rng.choices([*parts, *KEY_CHARS], k=rng.randint(1, 25)))
        got = [(secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.spans(text) if k < 3]
        assert got == brute.base_spans(text), text
