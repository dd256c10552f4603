"""Query on byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm.bpe import decode, encode
from foldwise.llm.common import sf_table


def op11_bpe(spark, sf_dir):
    out = decode(encode(sf_table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe": op11_bpe}
ORACLE: dict[str, str] = {}
