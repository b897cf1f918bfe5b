import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = ["the", "and", "er", "in", "on", "ti", "re", "st", "wh", "ha", "Éa", "ü"]


@pytest.fixture(scope="session", autouse=True)
def llm_session(spark):
    from tidepool.llm.common import prepare

    prepare(spark)


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


def corpus(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    """Documents of (doc_id, text) with columns whose names operators use inside."""
    full = [(i, t, "en", f"host{(i or 0) % 2}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, columns)
    for name in ("doc", "tag", "n", "_row", "value", "score", "kept", "_number", "_normal", "_place", "text_hash", "item", "sequence_id", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, white space, long, repeated and equal texts."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 80)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, long), (7, base), (8, base), (7, base), (None, base), (9, base.upper()), (10, "a " * 300), (11, "x" * 50_000), (12, prose(rng, 60) + "\n" + base), (None, None)]
