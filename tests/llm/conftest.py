"""Small document tables with the awkward cases."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, label string, size string"


def rows_of(texts: list[tuple], start: int = 0) -> list[tuple]:
    """Document rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return [(d, t, "en", s, len(t) if t else None, "x", 1, "y", "z") for d, t, s in texts]


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture()
def make_docs(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture()
def awkward():
    """Nulls, empty, blank and very long texts, repeated rows, repeated and null ids."""
    rng = random.Random(5)
    long = prose(rng, 60_000, 500)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "one two", "b"),
        (None, None, None), (7, long, "a"), (8, long + " tail", "a"), (9, "é ü ß   x y", "ä"), (9, "other text of the same id", "c"),
    ]
