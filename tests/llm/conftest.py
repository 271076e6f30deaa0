import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


#: Columns whose names the operators also use inside.
CLASHING = "text_hash int, payload string, id string, score double, node string, key string, block string, label string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, an empty and a long text, repeated rows, an id with two texts, and clashing names."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ümlaut", "naïve", "日本", "it's", "a\tb", "x\u00a0y"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    texts = [None, "", " \t\n", "one", "One two", long, long + " end", *(" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(20))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(8, texts[8]), (8, texts[8]), (9, "another text of nine"), (None, texts[7]), (None, None)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    frame = spark.createDataFrame(rows, schema)
    for part in CLASHING.split(", "):
        name, kind = part.split()
        frame = frame.selectExpr("*", f"cast(null as {kind}) as {name}")
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
