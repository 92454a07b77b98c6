import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in
      ("size", "Kept", "node", "ids", "place", "hash", "ws", "mix", "shard", "spans", "_hs")],
])

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"t{i % 977}x{i % 1009}" for i in range(60_000))
EDGE = [
    (1, " ".join(WORDS[:120]), "en", "a", 1),
    (1, " ".join(WORDS[:120]), "en", "a", 1),  # a repeated row
    (2, " ".join(WORDS[:120]), "en", None, None),  # an equal text
    (3, " ".join(WORDS[:60] + ["changed"] + WORDS[61:120]), None, "b", 2),
    (4, None, "de", "b", None),
    (5, "", "de", "b", 0),
    (6, " \t\n ", None, None, 3),
    (7, LONG, "en", "a", len(LONG)),
    (8, "one", "fr", "c", 3),
    (9, "one", "fr", "c", 3),
    (10, "Größe, naïve café!\nline\nline\n漢字 \U0001f600 ß", "de", "c", 9),
    (None, "no id here", "en", "a", 5),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    return spark.createDataFrame([(*r, *["x"] * 11) for r in EDGE], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def run(spark, sf_dir):
    """Rows of a registered query over the whole small tables, by id."""
    from homeward.llm.queries import QUERIES

    def rows(name, key="doc_id"):
        return {r[key]: r for r in QUERIES[name](spark, sf_dir).collect()}

    return rows
