import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use inside, as columns of the input.
CLASHES = ["id", "k", "w", "h", "at", "fp", "row", "block", "epoch", "leaf", "node", "low", "score", "lang_pred", "row_key", "n_words",
           "component_id", "html_", "payload", "of", "weight"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=False):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
        return df
    return make
