from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "web", None if t is None else len(t)) for d, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words from a small invented vocabulary."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]

    def make(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(words) for _ in range(n))

    return make
