"""Random strings that their shape or their neighbours hid."""

from __future__ import annotations

import pytest

from tidemark.llm import secret_scan

KEY = "kJ8xQ2vP9wZ4rT7mLb3N"


def random_of(text):
    return [text[a:b] for a, k, b in secret_scan.spans(text) if k == 3]


@pytest.mark.parametrize("key", ["QxZvKjWpLmNbTrYsQhGf", "QWXZP-KJHGF-MNBVC", "XQZKJWVPHGFDZXCVQ1234", KEY])
def test_keys_of_letters_are_secrets(key):
    assert random_of(f"the key {key} is here") == [key]


@pytest.mark.parametrize("path", ["/documentation/download/articles/", "name_of_the_configuration=", "documentation-of-the-download_"])
def test_keys_after_names_are_secrets(path):
    found = random_of(f"see {path}{KEY} there")
    assert found and found[0].endswith(KEY)
    assert KEY not in secret_scan.redacted(f"see {path}{KEY} there")


@pytest.mark.parametrize("text", ["0123456789abcdef01234567-" + KEY, KEY + "_0123456789abcdef01234567"])
def test_the_rest_around_hex_is_tested(text):
    assert random_of(text) == [KEY]
    assert KEY not in secret_scan.redacted(text)


@pytest.mark.parametrize(
    "name",
    [
        "internationalization", "a_plain_identifier_name", "getResponseHeaderValue", "MAX_CONNECTION_RETRY_COUNT",
        "/documentation/download/articles/2024", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01-2025-12-31",
        "----------------------", "0123456789ABCDEF0123456789ABCDEF",
    ],
)
def test_names_are_none(name):
    assert random_of(f"see {name} there") == []
