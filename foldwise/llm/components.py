"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its smallest one."""
    both = e.select(F.col("hi").alias("n"), F.col("lo").alias("o")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
    least = both.groupBy("n").agg(F.min("o").alias("m")).where(F.col("m") < F.col("n"))
    return e.join(least, e["lo"] == least["n"], "left").select("hi", F.coalesce("m", "lo").alias("lo"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (e.join(least, "hi").where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge to another node; ``root`` is the
    component's smallest node.  Null ends, loops and repeated edges are ignored.

    Each round shuffles edges only, and is stored, so a lost executor costs one round.
    Rounds end when the edges no longer change; their number grows with the logarithm
    of a component's diameter."""
    e = (edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
         .where("hi is not null and lo is not null").distinct())
    e = materialize(e)
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == state or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        state = now
        e = materialize(_small_star(_large_star(e)).distinct())
