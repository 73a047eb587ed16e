import pytest
from pyspark.sql import types as T

#: Columns whose names the operators use inside; they must not matter.
EXTRA = ["_t", "_id", "_hash", "_copy", "_copies", "_n", "size", "n", "k", "h", "fp", "digest", "label", "part", "score", "row_hash", "lam", "target"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in EXTRA],
    ]
)
LONG = "the long text goes on and on without an end " * 4000


def rows():
    texts = [
        "one two three four five six seven",
        "one two three four five six seven",
        "one  two three\tfour five six seven",
        "",
        None,
        " \t\n ",
        LONG,
        LONG + "x",
        "w" * 30_000,
        "You are an idiot. IDIOT!! " * 10,
        "a",
        "a",
        "été çà là. Größe 漢字 😀",
    ]
    out = [(i, t, "en", ["b", None, "a"][i % 3], 1, *["x"] * len(EXTRA)) for i, t in enumerate(texts)]
    out.append(out[0])  # a row twice
    out.append((None, "no id here", None, None, None, *[None] * len(EXTRA)))
    out.append((None, "no id here", None, None, None, *[None] * len(EXTRA)))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
