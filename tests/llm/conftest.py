import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, a int, id int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "c", 1, 2) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    def make(seed, n, vocabulary=2000):
        rng = random.Random(seed)
        return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs, prose):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    same = prose(1, 60)
    return make_docs([(1, None), (2, ""), (3, " \n\t"), (4, "?!"), (5, prose(2, 60_000)), (6, same), (6, same), (7, same), (None, same), (None, None), (8, "é" * 3000), (9, "x")])
