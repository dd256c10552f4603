"""Query on language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm.common import sf_table
from foldwise.llm.langid import predict, train


def held_out(doc_id="doc_id"):
    """A fixed quarter of the documents, by their id (a null id is held out of training too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op1_language_id(spark, sf_dir):
    docs = sf_table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    out = predict(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
