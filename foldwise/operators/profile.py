"""Grouped profiles and statistics.

Every profile is one aggregate job with map-side partial aggregation: a hot key
holding a third of the rows is combined inside each map task before the shuffle,
so no single reducer receives the raw rows of that key.  NULL keys are dropped
(pandas ``groupby`` semantics); NULL values are skipped by ``avg``/``count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import pairs as PR

# Pairs of a row (``pairs.pair_rows``): each guarded correlation has fifteen fields, and beyond 100 fields
# an aggregate is not compiled.
AGG_BATCH = 6


def _not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def target_rate(df: DataFrame, keys: Sequence[str] | str, y: str = "y") -> DataFrame:
    """A1/A2: rate = mean(y), n = count(y) by key(s); NULL keys dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.where(_not_null(keys)).groupBy(*keys)
            .agg(F.avg(y).alias("rate"), F.count(y).alias("n")))


def grouped_mean(df: DataFrame, keys: Sequence[str] | str, value: str) -> DataFrame:
    """A3: mean and count of a numeric by key(s)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.where(_not_null(keys)).groupBy(*keys)
            .agg(F.avg(value).alias("mean"), F.count(value).alias("n")))


def multi_key_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A3 for several independent keys in ONE pass: GROUPING SETS ((k1), (k2), ...).

    Output (key_name, key_value STRING, mean, n); key values are cast to string so
    differently typed keys share one column.
    """
    keyed = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value))
    g = keyed.groupingSets([[k] for k in keys], *keys).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"),
        *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)])
    name = None
    val = None
    for i, k in enumerate(keys):
        cond = F.col(f"_g{i}") == 0
        name = F.when(cond, F.lit(k)) if name is None else name.when(cond, F.lit(k))
        val = F.when(cond, F.col(k)) if val is None else val.when(cond, F.col(k))
    out = g.select(name.alias("key_name"), val.alias("key_value"), "mean", "n")
    return out.where(F.col("key_value").isNotNull())


def masked_rate(df: DataFrame, key: str, mask: Column, y: str = "y") -> DataFrame:
    """A4 + J2: rate over all rows and over masked (e.g. complete) rows, one pass.

    Replaces a full outer join of two grouped results by conditional aggregates.
    """
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(y).alias("all_mean"), F.count(y).alias("all_n"),
        F.avg(F.when(mask, F.col(y))).alias("masked_mean"),
        F.count(F.when(mask, F.col(y))).alias("masked_n")))


def hi_lo_diff(df: DataFrame, group: str, flag: str, y: str = "y") -> DataFrame:
    """A5: within-group mean(y | flag=1) - mean(y | flag=0)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(F.when(F.col(flag) == 1, F.col(y))).alias("hi_mean"),
        F.avg(F.when(F.col(flag) == 0, F.col(y))).alias("lo_mean"))
        .withColumn("diff", F.col("hi_mean") - F.col("lo_mean")))


def pivot_mean(df: DataFrame, index: str, columns: str, values: Sequence, value: str) -> DataFrame:
    """pivot_table(mean). The value list is always passed (no extra distinct job)."""
    return (df.where(F.col(index).isNotNull()).groupBy(index)
            .pivot(columns, list(values)).agg(F.avg(value)))


def freq_dist(df: DataFrame, c: str) -> DataFrame:
    """value_counts(normalize=True) over non-null values.

    The denominator is a scalar subquery (one partial/final count), not a
    window over the grouped table, so it never funnels through one task.
    """
    total = df.agg(F.count(c).alias("t")).scalar()
    return (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("freq", F.col("n") / total))


def summary(df: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """describe() -- count, mean, std, min, 25/50/75 %, max per column, one pass.

    ``exact`` quartiles use linear interpolation (numpy/pandas default), by one rank
    selection over all columns at once (``binning.quantiles`` keyed by column).
    ``exact=False``: ``percentile_approx`` sketches.
    """
    from foldwise.operators import binning as B

    aggs = []
    for i, c in enumerate(cols):
        q = [] if exact else [F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias("q")]
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"),
                             F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                             F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), *q).alias(f"s{i}"))
    rows = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cols))])))
    if exact:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "_v")
        rows = rows.join(B.quantiles(long, "_v", [0.25, 0.5, 0.75], ["column_name"]), "column_name", "left")
    return rows.select("column_name", "count", "mean", "std", "min",
                       F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def corr_panel(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, r, n), pairwise-complete Pearson r of any number of pairs from one scan.

    A row becomes one row per second column and group of ``AGG_BATCH`` first columns inside the scan's stage
    (``pairs.pair_rows``); these are aggregated with map-side partial aggregation, so what is shuffled is one
    such row per ``by`` group and task.  NULL values of ``by`` are groups."""
    by, pairs = list(by), list(pairs)
    left, right = (list(dict.fromkeys(q[j] for q in pairs)) for j in (0, 1))
    at = [(left.index(a), right.index(b)) for a, b in pairs]
    long = PR.pair_rows(df, by, [F.col(c) for c in left], [F.col(c) for c in right], at, AGG_BATCH)
    aggs = [F.struct(F.lit(i).alias("slot"), X.safe_corr(f"_a{i}", "_b").alias("r"),
                     F.count(F.when(F.col(f"_a{i}").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n")).alias(f"_p{i}") for i in range(AGG_BATCH)]
    wide = long.groupBy(*by, "_g", "_r").agg(*aggs)
    rows = wide.select(*by, "_g", "_r", F.inline(F.array(*[F.col(f"_p{i}") for i in range(AGG_BATCH)])))
    rows = rows.select(*by, F.explode(PR.places(at, len(left), len(right), AGG_BATCH)).alias("_at"), "r", "n")
    first, second = (F.get(F.array(*[F.lit(q[j]) for q in pairs]), F.col("_at")) for j in (0, 1))
    return rows.select(*by, first.alias("a"), second.alias("b"), "r", "n")


def corr_by_group(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Correlation within each group (one groupBy, not a loop over groups)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group).agg(
        X.safe_corr(a, b).alias("r"),
        F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")))


def typed_values(df: DataFrame, exprs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, d, l, s): one row for each row and expression that is not NULL, the value in the column of its
    type: floating, integral, or all others as text."""
    types = dict(df.select(*[e.alias(f"_e{i}") for i, e in enumerate(exprs.values())]).dtypes)
    cells = []
    for i, (name, e) in enumerate(exprs.items()):
        t = types[f"_e{i}"]
        kind = "d" if t in ("double", "float") else "l" if t in ("tinyint", "smallint", "int", "bigint") else "s"
        cells += [F.lit(name), *[e.cast(u) if k == kind else F.lit(None).cast(u) for k, u in (("d", "double"), ("l", "bigint"), ("s", "string"))]]
    long = df.select(*by, F.stack(F.lit(len(exprs)), *cells).alias("_name", "_d", "_l", "_s"))
    return long.where(F.col("_d").isNotNull() | F.col("_l").isNotNull() | F.col("_s").isNotNull())


def distinct_rows(df: DataFrame, exprs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, n_distinct): exact distinct non-NULL values of several expressions, one scan.

    Values are grouped once, by (name, value): a value that a third of the rows hold is one row per map task,
    and the rows are those of the table, not of the table times the columns for each distinct count.
    An expression without values has no row."""
    values = typed_values(df, exprs, by).groupBy(*by, "_name", "_d", "_l", "_s").agg(F.lit(1).alias("one"))
    return values.groupBy(*by, F.col("_name").alias("name")).agg(F.count(F.lit(1)).alias("n_distinct"))


def distinct_sketches(df: DataFrame, exprs: dict[str, Column], by: Sequence[str] = (), lg_size: int = 12) -> DataFrame:
    """(by, name, sketch): HyperLogLog sketches, to be stored with a partition or day and merged later
    (``merged_distinct``); 2^``lg_size`` registers, a relative error of about 1 / 2^(lg_size / 2)."""
    # + 0.0: a negative zero is a zero; the letter keeps the empty text a value
    value = F.coalesce(F.concat(F.lit("d"), (F.col("_d") + F.lit(0.0)).cast("string")), F.concat(F.lit("l"), F.col("_l").cast("string")),
                       F.concat(F.lit("s"), F.col("_s")))
    return typed_values(df, exprs, by).groupBy(*by, F.col("_name").alias("name")).agg(F.hll_sketch_agg(value, F.lit(lg_size)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """(keys, n_distinct): estimates of stored sketches, merged."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def distinct_counts(df: DataFrame, exprs: dict[str, Column], approx: bool = False) -> DataFrame:
    """Distinct counts of several expressions, one column each (0 without values)."""
    rows = merged_distinct(distinct_sketches(df, exprs)) if approx else distinct_rows(df, exprs)
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("n_distinct"))), F.lit(0)).alias(n) for n in exprs])
