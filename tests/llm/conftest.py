import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def table_of(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""

    def make(rows, extra=()):
        full = [(tuple(r) + (None, None, None))[:4] + (len(r[1]) if r[1] else 0,) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
