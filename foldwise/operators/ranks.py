"""Scale-safe ordered computations: average-tie ranks and cumulative counts.

A plain ``Window.partitionBy(keys).orderBy(score)`` puts every row of a key group
(with no keys: the whole table) into ONE task.  Here every size takes one path, in the
score's own type:

1. tie table: ``groupBy(keys, score)`` (map-side partial aggregation: a value repeated a
   billion times becomes one row per map task, then one row);
2. the tie table is range-partitioned by (keys, score).  Equal rows do not exist in it, so
   a range may end anywhere: a giant group is cut over many ranges and small groups
   share one, whatever their sizes.  The range number is stored with the row
   (``_bkt``), so all later steps see the same ranges;
3. running sums within (keys, range), plus the sums of the ranges before: a window over
   at most as many rows per group as there are ranges.

Ranks of rows (``average_rank``) take the rows themselves through steps 2 and 3, so that
nothing is joined back to them but one row per range and key group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialize, small


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match each other (a NULL group is a group)."""
    r = right
    for i, k in enumerate(keys):
        r = r.withColumnRenamed(k, f"__fw_r{i}")
    cond = [F.col(k).eqNullSafe(F.col(f"__fw_r{i}")) for i, k in enumerate(keys)]
    return left.join(r, cond, how).drop(*[f"__fw_r{i}" for i in range(len(keys))])


def range_buckets(t: DataFrame, keys: Sequence[str], score: str, buckets: int | None = None, *more: str) -> DataFrame:
    """Add ``_bkt``, the number of the row's range of (keys, score, more); ranges are ordered.

    ``buckets``: the number of ranges; by default ``spark.sql.shuffle.partitions``, fewer
    where adaptive execution finds the table small.  The number is that of the task
    that holds the row: read it once, or store the table (see ``cumulative_below``)."""
    cols = [*keys, score, *more]
    ranged = t.repartitionByRange(buckets, *cols) if buckets else t.repartitionByRange(*cols)
    return ranged.withColumn("_bkt", F.spark_partition_id())


def cumulative_below(t: DataFrame, keys: Sequence[str], score: str, counts: Sequence[str],
                     buckets: int | None = None) -> DataFrame:
    """For each (keys, score) row of a tie table, add ``{c}_below``: the sum of ``c``
    over rows of the same key group with a strictly smaller score, and
    ``{c}_total``: the group total."""
    tb = materialize(range_buckets(t, keys, score, buckets))
    per = tb.groupBy(*keys, "_bkt").agg(*[F.sum(c).alias(f"_b_{c}") for c in counts])
    # one row per range and key group: the offset window's input is bounded.
    wk = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = per.select(*keys, "_bkt",
                      *[F.coalesce(F.sum(f"_b_{c}").over(wk), F.lit(0)).alias(f"_o_{c}") for c in counts],
                      *[F.sum(f"_b_{c}").over(wt).alias(f"{c}_total") for c in counts])
    wb = Window.partitionBy(*keys, "_bkt").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_null_safe(tb, offs, list(keys) + ["_bkt"])
    return joined.select(
        *t.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wb), F.lit(0))).alias(f"{c}_below") for c in counts],
        *[F.col(f"{c}_total") for c in counts])


def tie_table(df: DataFrame, keys: Sequence[str], score: str, y: str | None = None) -> DataFrame:
    """(keys, score, n[, pos, neg]) over rows with a non-null score (and label ``y``)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    src = df.where(F.col(score).isNotNull())
    if y is not None:
        src = src.where(F.col(y).isNotNull())
        aggs += [F.sum(F.col(y).cast("long")).alias("pos"),
                 (F.count(F.lit(1)) - F.sum(F.col(y).cast("long"))).alias("neg")]
    return src.groupBy(*keys, score).agg(*aggs)


def average_rank(df: DataFrame, score: str, keys: Sequence[str] = (), out: str = "rank",
                 pct: str | None = None, n_out: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add the average-tie rank of ``score`` within ``keys`` (optionally
    rank / n as ``pct`` and the group's non-null count as ``n_out``).

    Rows are range-partitioned by (keys, score, hash of the row) and ranked inside their
    range, where they are stored; the hash cuts a score that a third of the rows share over
    many ranges.  One row per range and key group then says how many rows come before, and
    joins the ties that cross a border of ranges.  Rows without a score have no rank."""
    k = list(keys)
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    spread = range_buckets(df.withColumn("__fw_salt", F.xxhash64(*plain)), k, score, buckets, "__fw_salt")
    within = Window.partitionBy(*k, "_bkt", F.col(score).isNull()).orderBy(score)
    rows = spread.select(*df.columns, F.col("_bkt").alias("__fw_b"), F.rank().over(within).alias("__fw_r"),
                         F.count(F.lit(1)).over(within).alias("__fw_le"))
    rows = materialize(rows)
    per = small(_range_starts(rows.where(F.col(score).isNotNull()), k, score))
    joined = _join_null_safe(rows, per, [*k, "__fw_b"], "left")
    ties = F.col("__fw_le") - F.col("__fw_r") + 1
    start = F.col("__fw_before") + F.col("__fw_r") - 1
    low, high = (F.col(score) == F.col(f"__fw_{e}") for e in ("lo", "hi"))
    first = F.when(low, F.col("__fw_lo_start")).when(high, F.col("__fw_hi_start")).otherwise(start)
    size = F.when(low, F.col("__fw_lo_n")).when(high, F.col("__fw_hi_n")).otherwise(ties)
    rank = F.when(F.col(score).isNotNull(), first + (size + 1) / F.lit(2.0))
    extra = [(rank / F.col("__fw_n")).alias(pct)] if pct else []
    if n_out:
        extra.append(F.col("__fw_n").alias(n_out))
    return joined.select(*df.columns, rank.alias(out), *extra)


def _range_starts(rows: DataFrame, k: list[str], score: str) -> DataFrame:
    """One row per key group and range: rows of the group before the range, the group's size, and
    for the lowest and highest score of the range where its ties start and how many there
    are in all ranges."""
    per = rows.groupBy(*k, "__fw_b").agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.max("__fw_r").alias("hi_r"),
        F.count_if(F.col("__fw_r") == 1).alias("lo_n"))
    before = Window.partitionBy(*k).orderBy("__fw_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*k)))
    edges = per.select(*k, "__fw_b", "total", "before", F.inline(F.array(
        F.struct(F.lit(True).alias("low"), F.col("lo").alias("s"), F.col("before").alias("start"), F.col("lo_n").alias("ties")),
        F.struct(F.lit(False).alias("low"), F.col("hi").alias("s"), (F.col("before") + F.col("hi_r") - 1).alias("start"),
                 # a range of one score is counted once
                 F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.col("n") - F.col("hi_r") + 1).alias("ties")))))
    tie = Window.partitionBy(*k, "s")
    edges = edges.withColumn("start", F.min("start").over(tie)).withColumn("ties", F.sum("ties").over(tie))
    one = [F.max(F.when(F.col("low") == e, F.col(c))).alias(f"__fw_{n}{x}")
           for e, n in ((True, "lo"), (False, "hi")) for c, x in (("s", ""), ("start", "_start"), ("ties", "_n"))]
    return edges.groupBy(*k, "__fw_b").agg(F.first("before").alias("__fw_before"), F.first("total").alias("__fw_n"), *one)


def rank01(df: DataFrame, score: str, keys: Sequence[str] = (), out: str = "rank01",
           buckets: int | None = None) -> DataFrame:
    """rankdata(score) / n within each key group."""
    tmp = average_rank(df, score, keys, out="_rank", pct=out, buckets=buckets)
    return tmp.drop("_rank")


def rank_average(preds: DataFrame, id_col: str, by: Sequence[str], model_col: str = "model",
                 score: str = "score", out: str = "score", buckets: int | None = None) -> DataFrame:
    """Rank each model's scores within ``by`` + model, then average per (by, id).

    When every model scores the same number of rows (aligned predictions) the
    mean of rank/n is computed as sum(2 * rank) / (2 * n * k) on exact integers,
    so equal ensemble scores are exactly equal and a later re-rank sees the same
    ties on any engine.
    """
    keys = list(by) + [model_col]
    ranked = average_rank(preds, score, keys, out="_r", n_out="_n", buckets=buckets)
    g = ranked.where(F.col("_r").isNotNull()).groupBy(*by, id_col).agg(
        F.sum((F.col("_r") * 2).cast("long")).alias("_r2"), F.min("_n").alias("_nmin"),
        F.max("_n").alias("_nmax"), F.count(F.lit(1)).alias("_k"),
        F.avg(F.col("_r") / F.col("_n")).alias("_avg"))
    exact = F.col("_r2").cast("double") / (F.col("_nmin").cast("double") * 2.0 * F.col("_k"))
    return g.select(*by, id_col, F.when(F.col("_nmin") == F.col("_nmax"), exact).otherwise(F.col("_avg"))
                    .alias(out))


def super_ensemble(preds: DataFrame, id_col: str, by: Sequence[str], seed_col: str = "seed",
                   model_col: str = "model", score: str = "score", buckets: int | None = None) -> DataFrame:
    """Rank-average models within each seed, then re-rank the seed ensembles
    and average across seeds."""
    per_seed = rank_average(preds, id_col, list(by) + [seed_col], model_col, score, "score", buckets)
    # the per-seed ensemble is read several times by the second level: store it once
    per_seed = materialize(per_seed)
    return rank_average(per_seed, id_col, list(by), seed_col, "score", "score", buckets)
