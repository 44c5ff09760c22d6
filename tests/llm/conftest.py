import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) or (id, text, lang)."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def prose():
    """Repeatable invented words."""
    import random

    def make(seed, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(2, 8))) for _ in range(n))

    return make
