from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

TESTDATA = "/root/testdata"
# Names that the operators use inside; the input may have them too.
CLASHING = ("id", "text_hash", "score", "class", "anchor", "block", "first", "key", "shard", "rank", "length", "piece", "items", "spans", "kind")

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING])


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("an", "be", "co", "du", "él", "fi", "go")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(3)
    base, passage = words(rng, 120), " ".join(words(rng, 60))
    rows: list[tuple[int | None, str | None]] = [
        (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t "), (5, "one two three"), (6, "ONE Two  three"), (7, "one two three four five"),
        (8, " ".join(base)), (8, " ".join(base)), (None, " ".join(base)), (None, "漢字 かな ünï 😀 " + passage), (9, "ab" * 3000),
        (10, "x" * 250), (11, "x" * 250 + " tail"), (12, " ".join(words(rng, 6000))), (13, passage), (13, passage + " and more"),
    ]
    for i in range(14, 30):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = "changed" + str(rng.randrange(1000))
        rows.append((i, " ".join(own)))
    for i in range(30, 45):
        rows.append((i, " ".join([*words(rng, 40), passage, *words(rng, rng.randint(0, 200))])))
    return rows


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t), *("clash" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(edge_texts()).cache()


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
