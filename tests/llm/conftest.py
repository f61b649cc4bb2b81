import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside; documents may have them too.
CLASHES = ["words", "node", "row", "key", "h", "spans", "blob", "line", "__row_extra"]
WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "paper", "light", "garden", "window", "silver", "forest", "winter", "summer", "music", "north", "table", "bread", "ocean"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "ed"]) + str(r.randrange(40)) * (r.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(99, 30_000)
    return [
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (None, prose(1, 80), "en", "a", 1),
        (4, prose(2, 80), None, "a", 1),
        (5, prose(2, 80), "en", "b", 1),
        (5, prose(2, 80), "en", "b", 1),
        (6, long, "en", "b", 1),
        (7, "x" * 60_000, "en", "b", 1),
        (8, "one two", "en", "b", 1),
        (9, "é😀 ▁ \n\n12345 +1 (555) 010-9999 a@b.co", "fr", "b", 1),
        (10, "the the the " * 3000, "en", "b", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
