"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source with share p of all tokens gets weight p^x / sum(p^x).  The exponent x lies
between 0 (all sources alike) and 1 (as they are), and is found by bisection: the
largest with a wanted entropy, or the smallest that keeps repetitions within a limit.
A source's documents are dealt into blocks of about ``block_tokens`` tokens; an epoch
is a permutation of its blocks.  A source gives as many whole epochs as its budget
holds, and of the next one the first blocks that fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import materialize, row_key, token_count

#: Points between the ends that one job of the search looks at.
POINTS = 31


def _shares(sizes: DataFrame, xs: list[float]) -> list[tuple[float, float]]:
    """(Z, L) for each exponent: sums over sources of e^(x l) and l e^(x l), with l the log of
    the source's share of the largest."""
    e = [F.exp(F.col("l") * x) for x in xs]
    row = sizes.agg(*[F.sum(v) for v in e], *[F.sum(F.col("l") * v) for v in e]).first()
    return list(zip(row[:len(xs)], row[len(xs):]))


def _search(good, sizes: DataFrame, rounds: int = 7) -> float:
    """The end of [0, 1] on which ``good`` changes from true (below) to false, as the last true
    point; 0 if none is true, 1 if all are."""
    low, high = 0.0, 1.0
    if good(1.0, *_shares(sizes, [1.0])[0]):
        return 1.0
    for _ in range(rounds):
        xs = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
        ok = [good(x, z, s) for x, (z, s) in zip(xs, _shares(sizes, xs))]
        n = ok.index(False) if False in ok else POINTS
        low, high = (xs[n - 1] if n else low), (xs[n] if n < POINTS else high)
    return low


def exponent(sizes: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The exponent for source sizes (columns ``tokens`` > 0 and ``l``).

    ``target_entropy`` is a share of the greatest entropy, the log of the number of
    sources; the largest exponent that reaches it is taken (0 if none does).
    ``max_repeats`` limits the epochs of every source within ``budget`` (None: the
    budget that uses every document at least once); the smallest exponent within the
    limit is taken (1 if none is).  With both, the limit goes before the entropy."""
    n, total, least, top = sizes.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("l"), F.max("tokens")).first()
    x = 1.0
    if target_entropy is not None:
        want = target_entropy * math.log(n) - 1e-12
        x = _search(lambda x, z, s: math.log(z) - x * s / z >= want, sizes)
    elif max_repeats is not None:
        x = 0.0
    if max_repeats is not None:
        def too_many(x: float, z: float, s: float) -> bool:
            if budget is None:
                return math.exp(least * (x - 1)) > max_repeats
            return math.exp(least * (x - 1)) / z * budget / top > max_repeats
        if too_many(x, *_shares(sizes, [x])[0]):
            x = max(x, min(1.0, _search(too_many, sizes) + 1e-9))
    return round(x, 9)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float | None = 0.9, max_repeats: float | None = 4.0, budget: int | None = None,
        block_tokens: int = 20_000, seed: int = 42, tokens: Column | None = None,
        broadcast_sources: int = 10_000) -> DataFrame:
    """The columns of ``docs`` as struct ``row``, with (source, n_tokens, weight, epoch, block,
    block_order): one row for each use of a document.

    ``tokens`` (default: white-space words) counts a document's tokens.  ``budget`` is in
    tokens; None is the least budget that uses every document at least once, so nothing
    is dropped.  A null source is a source of its own.  A null or empty text has no
    tokens and goes with its block; a source without any tokens is used once, at weight
    0.  Equal rows share a block.  No documents give no rows.  Within a source, the rows of an epoch in the order of
    (block_order, block) are the permutation.

    Sizes of sources and blocks are sums with partial aggregation; the cut of the last
    epoch comes from sums of 1024 ranges of the order and one range's blocks, so no task
    holds a source.  Documents meet their source's plan in one join, a broadcast if there are
    at most ``broadcast_sources`` sources (counted first)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"),
                       (token_count(text) if tokens is None else tokens.cast("long")).alias("n_tokens"),
                       F.xxhash64(F.lit(seed), row_key(F.col(id_col), text)).alias("h"))
    light = rows.select("source", "n_tokens", "h")
    sizes = materialize(light.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    full = sizes.where("tokens > 0")
    n, total, top = full.agg(F.count(F.lit(1)), F.sum("tokens"), F.max("tokens")).first()
    plan = sizes.withColumn("n_blocks", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long"))
    if n:
        full = full.withColumn("l", F.log(F.col("tokens") / F.lit(float(top))))
        x = exponent(full, target_entropy, max_repeats, budget)
        z = _shares(full, [x])[0][0]
        weight = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(top))) * x) / z).otherwise(0.0)
        # the largest source has the smallest weight for its size
        quota = F.round(weight * (float(budget) if budget is not None else top * z)).cast("long")
        epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long")
        plan = (plan.withColumn("weight", weight).withColumn("quota", quota).withColumn("epochs", epochs)
                .withColumn("left", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0))))
    else:
        plan = plan.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"),
                           F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("left"))
    plan = plan.select("source", "tokens", "n_blocks", "weight", "epochs", "left")
    n_sources = sizes.count()

    def with_plan(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "of")
        right = F.broadcast(right) if n_sources <= broadcast_sources else right
        return left.join(right, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    block = F.pmod("h", "n_blocks").alias("block")

    def order(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), "source", epoch.cast("long"), "block")

    blocks = (with_plan(light, plan).where("left > 0").select("source", "epochs", "left", "n_tokens", block)
              .groupBy("source", "epochs", "left", "block").agg(F.sum("n_tokens").alias("t"))
              .withColumn("o", order(F.col("epochs"))).withColumn("range", F.shiftright("o", 54)))
    blocks = materialize(blocks)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (blocks.groupBy("source", "range").agg(F.sum("t").alias("sum"), F.max("left").alias("most"))
              .withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("base <= most"))
    within = Window.partitionBy("source", "range").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.select(F.col("source").alias("of"), F.col("range").alias("r"), "sum", "base")
    some = blocks.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("r")))
    whole = some.where("base + sum <= left").select("source", "o", "block")
    cut = (some.where("base + sum > left").withColumn("to", F.col("base") + F.sum("t").over(within)).where("to <= left")
           .select("source", "o", "block"))
    cuts = whole.unionByName(cut).groupBy("source").agg(F.max(F.struct("o", "block")).alias("cut"))
    cuts = cuts.withColumnRenamed("source", "s")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    used = with_plan(rows, plan).withColumn("block", block)
    more = F.coalesce(F.struct(order(F.col("epochs")).alias("o"), F.col("block").alias("block")) <= F.col("cut"), F.lit(False))
    uses = F.col("epochs") + more.cast("long")
    return (used.where(uses > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
            .select("row", "source", "n_tokens", "weight", "epoch", "block", order(F.col("epoch")).alias("block_order")))
