"""Odd rows that every operator must take, and a small readable corpus."""

from __future__ import annotations

import random

import pytest
from samples import CLASHES, SCHEMA, SYLLABLES, odd_rows, prose

@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 documents in three languages, some of them toxic, with labels."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(30, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Moronic", "moron!", "zutrash", "zutrashy"]))
        rows.append((i, " ".join(text), lang, f"s{i % 5}", len(text), *CLASHES))
        if i % 3:
            labels.append((i, int(i % 7 > 0), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

