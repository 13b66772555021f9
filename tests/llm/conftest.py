"""Fixtures for the operator tests: small tables with the awkward cases."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choices(["the", "er", "on", "ti", "sh", "wh", "an", "é", "ou", "st"], k=rng.randint(1, 3)))
            for _ in range(400)]


@pytest.fixture(scope="session")
def awkward(spark, words):
    """Documents with nulls, empty and long texts, copies, repeated rows and a clashing extra column."""
    rng = random.Random(6)
    base = [" ".join(rng.choices(words, k=rng.randint(5, 160))) + rng.choice(["", ".\n", "\n\n"]) for _ in range(60)]
    rows = [(i, t, "en" if i % 3 else None, "s") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s") for i in range(10)]  # exact copies
    rows += [(200 + i, base[20 + i] + " " + rng.choice(words), "en", "s") for i in range(10)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "s"), (302, " \t\n ", "en", "s"), (None, base[3], "en", "s"),
             (None, None, None, None), (303, " ".join(rng.choices(words, k=9000)), "en", "s"),
             (304, "x" * 5000, "en", "s"), (305, base[1] + " " + base[2], "fr", "s")]
    rows += [(7, base[7], "en", "s"), (300, None, None, None)]  # repeated rows
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, fp string")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def rows(awkward):
    return [(r["doc_id"], r["text"]) for r in awkward.collect()]


@pytest.fixture(scope="session")
def empty(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
