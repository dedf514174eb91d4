import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, root string, seed int"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows -> documents with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "src0", len(t or ""), "k", 7, "r", 1) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvwé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    return lambda n, seed=0: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def odd(prose):
    """Texts that break things: null, empty, blank, one word, punctuation, control characters, very long, repeated."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "... !!! ???"), (6, "a\x0bb\x0cc\x1cd e　f"), (7, prose(30_000, 1)), (8, "word"), (8, "word"), (None, "no id here at all"), (10, "x" * 200_000)]
