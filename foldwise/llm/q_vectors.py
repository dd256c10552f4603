"""Query on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm.common import sf_table
from foldwise.llm.kmeans_tree import search
from foldwise.llm.whitening import whiten


def op8_nearest(spark, sf_dir):
    return search(sf_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op12_whitening(spark, sf_dir):
    return whiten(sf_table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_nearest": op8_nearest, "op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
