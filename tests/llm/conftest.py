import random

import pytest

#: Columns whose names operators use inside; they must not be read.
CLASHING = "text string, score string, kept string, component_id string, found string, `key` string, spans string, part string, rep string, source string"


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose over a small vocabulary, by seed and number of words."""
    source = random.Random(11)
    words = ["".join(source.choice("abcdefghijklmnop") for _ in range(source.randint(2, 8))) for _ in range(2500)]

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make


@pytest.fixture
def docs_of(spark):
    """A table of documents, with columns of clashing names and several partitions."""

    def make(rows, partitions=3):
        data = [(i, t, *["x"] * 9) for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, " + CLASHING).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts that every operator must take: null, empty, white space, one word, control characters, long."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "\x00\x01 é 🙂 ▁ x"), (6, "a" * 30_000), (7, "lorem ipsum " * 4000), (None, "no id here"), (4, "word"), (8, "Ünï cödé — ß"), (9, "x y"), (10, "same line\n" * 50)]
