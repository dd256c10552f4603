"""Exact, tie-aware ROC-AUC by any key.

AUC = sum over distinct scores of pos * (neg_below + neg / 2) / (P * N), the
Mann-Whitney form with ties counted as 1/2 -- identical to scikit-learn's
``roc_auc_score``.  It needs only the collapsed tie table (keys, score, pos, neg),
so per-row data never reaches a window; ``neg_below`` comes from running sums
within ranges (``foldwise.operators.ranks``).  The numerator is accumulated as an
exact DECIMAL(38,0) of ``pos * (2 * neg_below + neg)``; single-class groups give NULL.

``BinaryClassificationEvaluator`` is not used: with its default ``numBins=1000``
it down-samples the curve and is not exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import ranks as R


def pair_counts(df: DataFrame, score: str, y: str = "y", keys: Sequence[str] = (),
                buckets: int | None = None) -> DataFrame:
    """(keys, num, n_pos, n_neg): twice the number of (positive, negative) pairs in order, ties
    as one, over rows with a non-null score and label.

    One chain of shuffles, each smaller than the last, and one reading of the input: tie
    table -> ranges (``ranks.range_buckets``) -> one row per range -> one row per key.
    A range adds sum of pos * (2 * neg_below + neg) with ``neg_below`` counted within it, and
    2 * pos for each negative in the ranges before."""
    k = list(keys)
    tb = R.range_buckets(R.tie_table(df, k, score, y), k, score, buckets)
    within = Window.partitionBy(*k, "_bkt").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    big = "decimal(38,0)"
    ties = tb.select(*k, "_bkt", "pos", "neg", F.coalesce(F.sum("neg").over(within), F.lit(0)).alias("_below"))
    term = F.col("pos").cast(big) * (F.col("_below") * 2 + F.col("neg")).cast(big)
    per = ties.groupBy(*k, "_bkt").agg(F.sum(term).alias("_num"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = Window.partitionBy(*k).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    num = F.col("_num").cast(big) + F.col("pos").cast(big) * (F.col("_before") * 2).cast(big)
    return per.groupBy(*k).agg(F.sum(num).cast(big).alias("num"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auc_of_pairs(num: str = "num", pos: str = "n_pos", neg: str = "n_neg") -> Column:
    """The AUC of exact pair counts; NULL for a single class."""
    den = F.col(pos).cast("double") * F.col(neg).cast("double") * 2.0
    return F.col(num).cast("double") / F.nullif(den, F.lit(0.0))


def auc(df: DataFrame, score: str, y: str = "y", keys: Sequence[str] = (),
        buckets: int | None = None) -> DataFrame:
    """(keys, auc, n_pos, n_neg) over rows with a non-null score and label (``pair_counts``)."""
    g = pair_counts(df, score, y, keys, buckets)
    return g.select(*keys, auc_of_pairs().alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def auc_panel(df: DataFrame, features: Sequence[str], y: str = "y", keys: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """Univariate AUC of many columns in ONE job: unpivot to (feature, score)
    then AUC keyed by feature (each on its own non-null rows)."""
    # columns of one type keep it; others meet as doubles
    one = len({df.schema[f].dataType.simpleString() for f in features}) == 1
    long = df.select(*keys, y, *[F.col(f) if one else F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*keys, y], list(features), "feature", "score")
    return auc(long, "score", y, [*keys, "feature"], buckets)


def auc_common_subset(df: DataFrame, features: Sequence[str], combos: dict[str, Column] | None = None,
                      y: str = "y", buckets: int | None = None) -> DataFrame:
    """AUCs on the rows where every listed column is present, plus
    combined scores (e.g. a + b) on that same subset."""
    sub = df.na.drop(how="any", subset=list(features))
    combos = combos or {}
    wide = sub.select(y, *features, *[e.alias(n) for n, e in combos.items()])
    return auc_panel(wide, list(features) + list(combos), y, buckets=buckets)


def auc_subgroup(df: DataFrame, score: str, group: str, y: str = "y", min_support: int = 100,
                 buckets: int | None = None) -> DataFrame:
    """AUC per subgroup, keeping groups with more than ``min_support`` rows."""
    out = auc(df.where(F.col(group).isNotNull()), score, y, [group], buckets)
    return out.where((F.col("n_pos") + F.col("n_neg")) > min_support)


def auc_by_fold(df: DataFrame, score: str, fold: str = "fold", y: str = "y", keys: Sequence[str] = (),
                buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per-fold AUC, summary of mean and population std of the fold AUCs)."""
    per = auc(df, score, y, [*keys, fold], buckets)
    summ = per.groupBy(*keys).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                                  F.count("auc").alias("n_folds"))
    return per, summ


def log_loss_by(df: DataFrame, p: str, group: str | Sequence[str] | None, y: str = "y",
                eps: float = 1e-15) -> DataFrame:
    """Log-loss (p clipped to [eps, 1 - eps]), Brier score and error rate at 0.5 by group(s)."""
    pc = X.clip(p, eps, 1.0 - eps)
    yy = F.col(y).cast("double")
    ll = -(yy * F.log(pc) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - pc))
    src = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    grp = [group] if isinstance(group, str) else list(group or [])
    for g in grp:
        src = src.where(F.col(g).isNotNull())
    return src.groupBy(*grp).agg(
        F.avg(ll).alias("log_loss"), F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier"),
        F.avg((F.when(F.col(p) >= 0.5, 1).otherwise(0) != F.col(y)).cast("int")).alias("error_rate"),
        F.count(F.lit(1)).alias("n"))


def attach_labels(preds: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """The positional zip of predictions and labels is an inner equi-join on id."""
    return preds.join(labels, id_col, "inner")
