"""Small tables with every awkward row, shared by the operators' tests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in ("lang", "source", "k", "at", "words", "row_", "text_", "id_", "label", "g")],
    T.StructField("n_chars", T.LongType()),
])


def make_docs(spark, rows):
    """Rows (doc_id, text) with clashing extra columns, some of them null."""
    return spark.createDataFrame(
        [(i, t, *(["x", None, "y", None, "z", None, "u", None, "v", None]), None) for i, t in rows], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


def awkward_rows():
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[50] = "changed"
    return [
        (1, base), (2, None), (3, ""), (4, " \t\n "), (5, base), (6, " ".join(near)), (6, " ".join(near)), (None, prose(3, 80)),
        (7, f"{prose(4, 50)} {passage} {prose(5, 40)}"), (8, f"{passage}\n{prose(6, 30)}"), (9, "one two"), (10, "one two"),
        (11, "ONE two"), (12, prose(7, 30_000, 5_000)), (13, "É É é " + passage.upper()), (14, "a" * 70_000), (15, "x y z " * 40),
        (16, "Ärger über ▁   тест 日本語 😀 \x0b\x0c\r\n z"), (None, prose(3, 80)), (17, "a  b   c \n\n d")]


@pytest.fixture(scope="session")
def awkward(spark):
    return make_docs(spark, awkward_rows()).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(1, 18)]
    rows += [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
