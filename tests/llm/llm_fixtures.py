from __future__ import annotations

import random

import pytest

TEXT = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, "x", 5.0, 7) for i, t in rows], f"{TEXT}, score string, component double, n long").repartition(3)

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, always the same."""
    drawn = random.Random(11)
    vocabulary = ["".join(drawn.choice("aeioutnrsl") for _ in range(drawn.randint(2, 7))) for _ in range(400)]
    return lambda seed, words: " ".join(random.Random(seed).choices(vocabulary, k=words))
