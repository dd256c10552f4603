"""Distributed isotonic regression (B5): pool adjacent violators by ranges of the score.

1. Rows become one row per (group, score) with label sums and counts by fold, range-partitioned by
   (group, score) and stored: a score that a third of the rows share is one row.
2. Each range pools its violators, for every fold that is left out.  Pooling may go in any order, so
   the blocks of several neighbouring ranges are pooled again, ``FAN`` ranges at a time, until one
   list of blocks is left for each fit.  Means are compared as exact fractions.  Blocks of N rows with
   increasing means a / b have different fractions, so no more than about N^(2/3) are left: that
   bounds the last step and everything after it.
3. Each range meets the blocks that reach into it, and gives its scores their value: the block's mean,
   linear between the blocks around a score that the fit has not seen, the end blocks' beyond them.

Label sums are integers (0/1 labels); a score or label that is NULL or NaN takes no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import ranks as R
from foldwise.session import materialize

#: Neighbouring ranges whose blocks are pooled together.
FAN = 16


def pool(low: list, high: list, total: list[int], count: list[int]) -> tuple[list, list, list[int], list[int]]:
    """Pool adjacent violators: blocks (lowest score, highest score, label sum, rows) in score order."""
    out: list[list] = [[], [], [], []]
    lows, highs, totals, counts = out
    for lo, hi, s, n in zip(low, high, total, count):
        # a block of a mean not below the next one's joins it
        while totals and totals[-1] * n >= s * counts[-1]:
            lo = lows.pop()
            highs.pop()
            s += totals.pop()
            n += counts.pop()
        lows.append(lo)
        highs.append(hi)
        totals.append(s)
        counts.append(n)
    return lows, highs, totals, counts


def _ties(df: DataFrame, by: Sequence[str], score: str, y: str, fold: str, buckets: int | None) -> DataFrame:
    """(by, x, cells, range): one row per score with (fold, n, s) of each fold that has it, stored."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull() & F.col(fold).isNotNull())
    # + 0.0: a negative zero is a zero
    cells = rows.groupBy(*by, (F.col(score).cast("double") + F.lit(0.0)).alias("x"), F.col(fold).cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("s"))
    ties = cells.groupBy(*by, "x").agg(F.collect_list(F.struct("fold", "n", "s")).alias("cells"))
    return materialize(R.range_buckets(ties, list(by), "x", buckets).withColumnRenamed("_bkt", "range"))


def isotonic_blocks(ties: DataFrame, by: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """(by, left_out, number, low, high, s, n, first, last): the fitted blocks of each fit, in order;
    ``first`` and ``last`` are the ranges that a block spans."""
    by = list(by)
    keys = [ties.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("left_out", T.IntegerType()), T.StructField("low", T.DoubleType()),
                           T.StructField("high", T.DoubleType()), T.StructField("s", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    folds = [int(k) for k in folds]

    def frame(key, left_out, low, high, s, n, first, last):
        import pandas as pd

        d = {c: [v] * len(low) for c, v in zip(by, key)}
        return pd.DataFrame({**d, "left_out": left_out, "low": low, "high": high, "s": s, "n": n, "first": first, "last": last},
                            columns=schema.names)

    def within(key, pdf):
        import pandas as pd

        x, at = np.unique(pdf["x"].to_numpy(), return_inverse=True)
        of, n, s = (pdf[c].to_numpy() for c in ("fold", "n", "s"))

        def sums(values, rows):
            # exact: counts of one score stay below 2^53
            return np.bincount(at[rows], weights=values[rows], minlength=len(x)).astype(np.int64)

        every, parts = np.ones(len(pdf), bool), []
        n_all, s_all = sums(n, every), sums(s, every)
        for k in folds:
            n_k, s_k = n_all - sums(n, of == k), s_all - sums(s, of == k)
            seen = n_k > 0
            low = x[seen].tolist()
            low, high, s_k, n_k = pool(low, low, s_k[seen].tolist(), n_k[seen].tolist())
            parts.append(frame(key[:len(by)], k, low, high, s_k, n_k, int(key[-1]), int(key[-1])))
        return pd.concat(parts)

    def merge(key, pdf):
        pdf = pdf.sort_values("low")
        first = dict(zip(pdf["low"], pdf["first"]))
        last = dict(zip(pdf["high"], pdf["last"]))
        low, high, s, n = pool(pdf["low"].tolist(), pdf["high"].tolist(), pdf["s"].tolist(), pdf["n"].tolist())
        return frame(key[:len(by)], int(key[len(by)]), low, high, s, n, [first[v] for v in low], [last[v] for v in high])

    long = ties.select(*by, "range", "x", F.inline("cells"))
    blocks = long.groupBy(*by, "range").applyInPandas(within, schema)
    # ranges by number, each level FAN times fewer; the store tells how many there are
    n_ranges, step = (ties.agg(F.max("range")).head()[0] or 0) + 1, 1
    while step < n_ranges:
        step *= FAN
        # a block lies where its first range does: blocks before it in the list are before it in score
        blocks = blocks.groupBy(*by, "left_out", F.expr(f"first div {step}").alias("part")).applyInPandas(merge, schema)
    order = Window.partitionBy(*by, "left_out").orderBy("low")
    return blocks.withColumn("number", F.row_number().over(order) - 1)


def isotonic_values(df: DataFrame, by: Sequence[str] = (), score: str = "score", y: str = "y", fold: str = "fold",
                    buckets: int | None = None) -> DataFrame:
    """(by, fold, score, n, s, calibrated): for each score of each fold its rows, label sum, and the value of
    the isotonic fit on the other folds (NULL if these have no row)."""
    by = list(by)
    ties = _ties(df, by, score, y, fold, buckets)
    folds = [r[0] for r in ties.select(F.explode("cells.fold").alias("fold")).distinct().orderBy("fold").collect()]
    blocks = isotonic_blocks(ties, by, folds)
    order = Window.partitionBy(*by, "left_out").orderBy("number")
    value = F.col("s") / F.col("n")
    reach = blocks.select(*by, F.col("left_out").alias("fold"), "low", "high", value.alias("value"), "first",
                          F.lead("low").over(order).alias("next_low"), F.lead(value).over(order).alias("next_value"),
                          F.lead("first").over(order).alias("next_first"), "number")
    # a block answers from its first score to the next block's, the first one from the lowest range
    start = F.when(F.col("number") == 0, F.lit(0)).otherwise(F.col("first"))
    n_ranges = ties.agg(F.max("range")).head()[0]
    stop = F.coalesce(F.col("next_first"), F.lit(n_ranges))
    reach = reach.select(*by, "fold", F.explode(F.sequence(start, F.greatest(start, stop))).alias("range"), "low", "high", "value", "next_low", "next_value")
    points = ties.select(*by, "range", F.col("x").alias("score"), F.inline("cells")).select(*by, "fold", "range", "score", "n", "s")
    schema = T.StructType([*[ties.schema[c] for c in by], T.StructField("fold", T.IntegerType()), T.StructField("score", T.DoubleType()),
                           T.StructField("n", T.LongType()), T.StructField("s", T.LongType()), T.StructField("calibrated", T.DoubleType())])

    def answer(key, pts, seg):
        out = pts[[*by, "fold", "score", "n", "s"]].copy()
        if not len(out):
            out["calibrated"] = np.empty(0)
            return out
        if not len(seg):
            out["calibrated"] = None
            return out
        seg = seg.sort_values("low")
        x = out["score"].to_numpy(float)
        low, high, value, next_low, next_value = (seg[c].to_numpy(float) for c in ("low", "high", "value", "next_low", "next_value"))
        at = np.maximum(np.searchsorted(low, x, "right") - 1, 0)
        between = (x > high[at]) & ~np.isnan(next_low[at])
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            line = value[at] + (x - high[at]) * ((next_value[at] - value[at]) / (next_low[at] - high[at]))
        out["calibrated"] = np.where(between, line, value[at])
        return out

    keys = [*by, "fold", "range"]
    return points.groupBy(*keys).cogroup(reach.groupBy(*keys)).applyInPandas(answer, schema)


def isotonic_oof(df: DataFrame, id_col: str = "id", by: Sequence[str] = (), score: str = "score", y: str = "y",
                 fold: str = "fold", buckets: int | None = None) -> DataFrame:
    """(by, id, fold, score, y, calibrated): B5 for each row, fitted on the other folds."""
    values = isotonic_values(df, by, score, y, fold, buckets)
    v = values.select(*[F.col(c).alias(f"__fw_v{i}") for i, c in enumerate(by)], F.col("fold").alias("__fw_fold"), F.col("score").alias("__fw_x"), "calibrated")
    cond = [F.col(c).eqNullSafe(F.col(f"__fw_v{i}")) for i, c in enumerate(by)]
    cond += [F.col(fold) == F.col("__fw_fold"), F.col(score).cast("double") + F.lit(0.0) == F.col("__fw_x")]
    # one small row for each score of a fold; AQE splits the large side's hot scores
    return df.join(v, cond, "left").select(*by, id_col, fold, score, y, "calibrated")
