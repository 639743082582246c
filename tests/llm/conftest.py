import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, band long, kept_id string, shard string, `size` int, edges string"


def words(seed: int, n: int, kinds: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) if kinds >= 26**4 else f"w{r.randrange(kinds)}x" for _ in range(n))


def row(doc_id, text, lang="en", source="web"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "k", 1, "x", "s", 3, None)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang[, source]]) with other columns whose names operators might use."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows."""
    long = words(1, 60_000)
    return make([(1, words(2, 50)), (2, None), (None, "text without an id"), (3, ""), (4, long), (5, long), (1, words(2, 50)), (6, "é ü 漢字 🙂"), (7, "  \n "), (None, None), (8, words(2, 50), None, None)])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])
