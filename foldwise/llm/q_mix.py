"""Query on mixing sources."""

from __future__ import annotations

from foldwise.llm.common import sf_table
from foldwise.llm.mixing import mix


def op2_mixing(spark, sf_dir):
    docs = sf_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_order")


QUERIES = {"op2_mixing": op2_mixing}
ORACLE: dict[str, str] = {}
