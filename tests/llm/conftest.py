import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "su", "ke", "par", "no", "vi", "dor", "is", "an"]
    known = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    near = base.rsplit(" ", 1)[0] + " changed"
    return [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (3, near, "en", None, None), (4, None, None, None, None), (5, "", "de", "b", 0),
        (6, long, "en", "a", len(long)), (7, long + " end", "en", "a", len(long)), (8, "one two", "fr", "c", 7), (9, "ONE, two!", "fr", "c", 9), (10, "!!! ???", "es", "c", 7),
        (10, "!!! ???", "es", "c", 7), (None, "without id " + prose(3, 30), "en", "a", 1), (None, None, None, None, None), (12, "x" * 50_000, "en", "a", 50_000),
        (13, " \t\n ", "en", "a", 4), (14, "é😀 mail me@host.org or +49 30 1234567", "de", "a", 30), (15, prose(4, 60), "de", "a", 300), (15, prose(5, 60), "de", "a", 300),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
