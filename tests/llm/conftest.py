"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(12_000))
BASE = " ".join(f"alpha{i}" for i in range(60))
COPY_OF_PART = "head " * 3 + " ".join(f"alpha{i}" for i in range(2, 58)) + " tail"

ROWS = [
    (1, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, COPY_OF_PART), (8, "one two"),
    (9, "one two"), (9, "one two"), (10, "mail jane.doe@mail.example.com or +1 (017) 555-7713 now"),
    (None, BASE), (None, None), (11, BASE.replace("alpha30", "ALPHA30x")), (12, "x" * 70_000), (13, LONG + " end"),
    (14, "naïve  café 日本 '\x1c ok\n\n\nend "), (15, "card 4111 1111 1111 1111 ip 10.0.0.1 and 300.1.1.1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    rnd = random.Random(5)
    more = []
    for i in range(100, 160):
        words = [f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, 140))]
        more.append((i, " ".join(words)))
        if i % 3 == 0 and len(words) > 60:
            words[rnd.randint(0, len(words) - 1)] = "changed"
            more.append((i + 1000, " ".join(words)))
    return ROWS + more


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(docs):
    """The same rows with columns whose names the operators use themselves."""
    names = ("row", "ids", "scores", "shard", "slot", "size", "class_key", "runs", "key", "end", "tokens", "part")
    return docs.withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
