import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("size", "key", "rank", "row", "norm", "full_hash", "fp", "word", "label", "part", "id", "hash", "passes", "k_id", "m_id", "b_id", "d", "t", "at", "n", "doc", "leaf", "line", "window", "term", "score", "stats")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source) rows."""

    def build(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: words(n, seed) gives n words."""

    def words(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(("an", "er", "th", "ion", "re", "ou", "st", "le", "ti", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = prose(30_000, 1)
    base = prose(60, 2)
    return [(1, None), (2, ""), (3, " \t\n"), (4, base), (4, base), (None, base), (None, None), (5, base + " "), (6, long_text), (7, "a" * 5000), (8, "token = " + "Ab3" * 4), (9, "\n" * 50), (10, "ü" * 300), (11, "word"), (12, long_text)]
