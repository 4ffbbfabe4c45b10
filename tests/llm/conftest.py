import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text) pairs."""

    def make(rows, extra=""):
        full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for the same seed."""

    def make(seed, n, vocabulary=400):
        dice = random.Random(seed)
        return " ".join(f"w{dice.randrange(vocabulary)}x" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null ids and texts, empty, blank, very long and repeated texts."""
    return [(1, None), (None, prose(1, 30)), (2, ""), (3, " \n\t "), (4, "..."), (5, "long " * 60_000), (6, prose(2, 80)), (6, prose(2, 80)), (7, prose(2, 80)), (8, "Straße É 日本語 🙂 x")]
