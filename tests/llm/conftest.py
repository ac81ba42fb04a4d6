import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Random words without a pattern."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text)."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)
        if extra:  # columns whose names the operators might use themselves
            for name in ("h", "node", "key", "uid", "leader", "members", "salt", "_salt", "kept", "score", "window", "order", "rank", "_toxic"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
