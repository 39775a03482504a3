import os
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def passage(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text and word, ties, repeated rows, repeated ids, copies, and extra columns
    that are named like helper columns."""
    a, b = passage(1), passage(2)
    rows = [
        (1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, a.replace(a.split()[40], "changed"), "en", None, 1), (4, f"{b} {a} tail", "de", "s", None), (5, None, None, None, None), (6, "", "en", "s", 0),
        (7, " \t\n", "en", "s", 3), (8, "one", "en", "s", 3), (9, "one", "en", "s", 3), (9, "one", "en", "s", 3), (10, "two words", "fr", "s", 9), (10, b, "fr", "s", 9), (None, a, "en", "s", 1),
        (None, passage(3), None, "s", 1), (11, "the the the " * 400, "en", "s", 1), (12, passage(4, 30_000), "en", "s", 1), (13, "x" * 60_000, "en", "s", 1), (14, "123 !!! 456 ½ ²", "en", "s", 1),
        (15, "É́ ŉ Straße ΣΑΣ <|endoftext|>don't stop 中文 😀", "el", "s", 1), (16, f"{a} {a}", "en", "s", 1), (17, b.upper(), "fr", "s", 1),
    ]
    rows = [(i, t, lang, s, n, "x", 1, 2, "y", 0.5) for i, t, lang, s, n in rows]
    return spark.createDataFrame(rows, DOCS + ", doc string, row long, node long, key string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given():
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    return SF


def key(row):
    return tuple((v is None, v) for v in row)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
