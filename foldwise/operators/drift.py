"""Duplicates, drift and missingness forensics.

* D1 duplicate feature rows: one ``groupBy`` on the feature tuple with per-split
  conditional counts; NULLs group as equal; partial aggregation collapses a hot
  duplicate before the shuffle.
* D2 two-sample KS per numeric column: unpivot -> (feature, value) counts per
  split -> cumulative shares via the running sums within ranges of
  ``foldwise.operators.ranks`` (no single-task window) -> max |F_a - F_b|.
  (``ml.stat.KolmogorovSmirnovTest`` is one-sample only.)
* D3 missing-rate drift with a pooled two-proportion z statistic, one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions import exprs as X

from foldwise.operators import ranks as R


def duplicate_rows(df: DataFrame, features: Sequence[str], split: str = "split",
                   splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Feature tuples occurring more than once, with per-split counts and the
    number of non-null feature values (the row's 'width')."""
    width = sum((F.col(c).isNotNull().cast("int") for c in features[1:]),
                F.col(features[0]).isNotNull().cast("int"))
    g = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}") for s in splits],
        F.first(width).alias("width"))
    return g.where(F.col("n") > 1)


def ks_drift(df: DataFrame, cols: Sequence[str], split: str = "split", a: str = "train", b: str = "test",
             buckets: int | None = None) -> DataFrame:
    """(feature, ks, n_a, n_b) two-sample KS statistic per column (NULLs skipped)."""
    long = (df.where(F.col(split).isin(a, b))
            .select(split, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([split], list(cols), "feature", "value")
            .where(F.col("value").isNotNull()))
    t = long.groupBy("feature", "value").agg(
        F.count(F.when(F.col(split) == a, 1)).alias("na"),
        F.count(F.when(F.col(split) == b, 1)).alias("nb"))
    c = R.cumulative_below(t, ["feature"], "value", ["na", "nb"], buckets)
    fa = (F.col("na_below") + F.col("na")) / F.nullif(F.col("na_total"), F.lit(0))
    fb = (F.col("nb_below") + F.col("nb")) / F.nullif(F.col("nb_total"), F.lit(0))
    return c.groupBy("feature").agg(F.max(F.abs(fa - fb)).alias("ks"),
                                    F.max("na_total").alias("n_a"), F.max("nb_total").alias("n_b"))


def missing_drift(df: DataFrame, cols: Sequence[str], split: str = "split", a: str = "train",
                  b: str = "test") -> DataFrame:
    """D3: missing rate per column per split and the pooled two-proportion z."""
    aggs = []
    for i, c in enumerate(cols):
        miss = F.col(c).isNull().cast("long")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.sum(F.when(F.col(split) == a, miss)).alias("xa"), F.count(F.when(F.col(split) == a, 1)).alias("na"),
            F.sum(F.when(F.col(split) == b, miss)).alias("xb"), F.count(F.when(F.col(split) == b, 1)).alias("nb"),
        ).alias(f"m{i}"))
    wide = df.agg(*aggs)
    s = wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(cols))])))
    ra = F.col("xa") / F.nullif(F.col("na"), F.lit(0))
    rb = F.col("xb") / F.nullif(F.col("nb"), F.lit(0))
    p = (F.col("xa") + F.col("xb")) / F.nullif(F.col("na") + F.col("nb"), F.lit(0))
    # an empty split gives NULL, never an ANSI division error
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / F.nullif(F.col("na"), F.lit(0))
                                         + F.lit(1.0) / F.nullif(F.col("nb"), F.lit(0))))
    return s.select("column_name", ra.alias("rate_a"), rb.alias("rate_b"),
                    ((ra - rb) / F.nullif(se, F.lit(0.0))).alias("z"))


def mcar_flags_corr(df: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """Correlation of each missingness flag with the target (one pass)."""
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     X.safe_corr(F.col(c).isNull().cast("double"), F.col(y).cast("double")).alias("r"),
                     F.avg(F.col(c).isNull().cast("double")).alias("missing_rate")).alias(f"c{i}")
            for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def moderation(df: DataFrame, group: str, x: str, y: str = "y") -> DataFrame:
    """Does a categorical change the slope (corr, OLS slope) or level of the main signal?"""
    return (df.where(F.col(group).isNotNull()).groupBy(group).agg(
        X.safe_corr(x, y).alias("r"),
        (F.covar_samp(x, y) / F.nullif(F.var_samp(F.when(F.col(y).isNotNull(), F.col(x))), F.lit(0.0)))
        .alias("slope"),
        F.avg(y).alias("mean_y"), F.avg(x).alias("mean_x"),
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n")))
