import pytest
from pyspark.sql import types as T

SHARED = " ".join(f"shared{i}" for i in range(60))


def corpus():
    """Documents with every odd case: (doc_id, text, source)."""
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    near = own(7, 90).split()
    return [
        (1, own(1, 120) + "\n" + SHARED, "b"),
        (2, SHARED + " " + own(2, 30), "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \n\t ", "b"),
        (6, "One two three", "c"),
        (7, " ".join(near), "a"),
        (8, " ".join(near[:80] + ["changed"] + near[81:]).upper(), "a"),
        (8, " ".join(near[:80] + ["changed"] + near[81:]).upper(), "a"),  # a repeated row
        (None, own(9, 40), "b"),
        (None, None, None),
        (10, "spam spam spam " * 3000, "hot"),
        (11, "Größe für Straße, naïve. İstanbul ﬁ 東京 " * 3, "hot"),
        (12, own(12, 5), "hot"),
        (13, own(12, 5), "hot"),
        (14, "x" * 30_000, "c"),
        (15, own(1, 120), "b"),
        *[(100 + i, own(50, 25), "hot") for i in range(20)],
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus, with columns whose names operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    extra = ["size", "copies", "bid", "row", "node", "rank", "salt", "length", "start", "score", "target", "spans"]
    df = spark.createDataFrame(corpus(), schema).repartition(3)
    return df.selectExpr("*", *[f"'mine' as {c}" for c in extra])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
