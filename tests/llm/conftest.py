"""Small documents with everything that goes wrong: nulls, empty and long texts, copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, s string, fp string, `row` string, score string, size string, shard string, w string, copies string"
EXTRA = (1, "s", "f", "r", "x", "z", "h", "w", "c")


def sentence(r: random.Random, words: int, stem: str = "") -> str:
    parts = ["the", "of", "and", "ra", "lo", "mi", "tu", "ke", "son", "var", "bel", "dor"]
    return " ".join(stem + "".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(words))


def make() -> list[tuple]:
    r = random.Random(7)
    passage, base = sentence(r, 60), sentence(r, 120)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", "   \n\t ", "one", "one two", "Only Three words", "éà ü ß ñ", "12345 678", base, base, base.upper(), " ".join(near), base + " tail", "x " * 200, "a b " * 100]
    texts += [sentence(r, 40) + " " + passage + " " + sentence(r, 30) for _ in range(4)] + [passage + " " + passage] + [sentence(r, 3000)]
    texts += [sentence(r, r.randint(1, 90)) + "." for _ in range(40)]
    rows = [(k, t, "en" if k % 5 else None, None if k % 11 == 3 else f"src{k % 3 if k > 30 else 0}", len(t or ""), *EXTRA) for k, t in enumerate(texts)]
    return rows + [rows[8], rows[20], (None, "no id here but words", None, None, 3, *EXTRA), (None, None, None, None, None, *EXTRA)]


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
