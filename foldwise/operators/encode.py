"""Leakage-safe encodings fitted on the labelled table.

Encoding maps are joined back with a LEFT join + ``coalesce`` default (``lookup``).  A map's
size grows with the category cardinality, so it is stored and counted first: up to
``session.BROADCAST_ROWS`` rows it is broadcast, and the large side is not shuffled at all;
beyond that both sides are shuffled, with the keys that hold many rows salted.

Out-of-fold target encoding is ONE aggregate instead of k passes:
enc(c, f) = (S_c - S_c,f) / (N_c - N_c,f), the mean of y over the rows of
category c outside fold f; NULL (no such rows, or NULL category) -> global mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import BROADCAST_ROWS, materialize


#: Parts that the rows of one key are dealt over when a map is too large to broadcast.
SALT = 16


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Left join of ``table`` (one row per key) to a large table, by the measured size of ``table``.

    A NULL key finds nothing.  ``rows``: the largest number of rows that is broadcast."""
    keys = list(keys)
    limit = BROADCAST_ROWS if rows is None else rows
    stored = materialize(table)
    if stored.count() <= limit:
        return df.join(F.broadcast(stored), keys, "left")
    # the map's few bytes are repeated, the large side's hot keys are cut
    parts = stored.withColumn("__fw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = df.withColumn("__fw_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT)).cast("int"))
    return salted.join(parts, [*keys, "__fw_salt"], "left").drop("__fw_salt")


def frequency_map(train: DataFrame, c: str) -> DataFrame:
    """E1 map: (c, freq) with freq = count / count of non-null c."""
    total = train.agg(F.count(c).alias("t")).scalar()
    return (train.where(F.col(c).isNotNull()).groupBy(c)
            .agg((F.count(F.lit(1)) / total).alias("_freq")))


def frequency_encode(train: DataFrame, df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Add ``{c}_freq_enc``; unseen or NULL category -> 0."""
    m = frequency_map(train, c)
    return (lookup(df, m, [c])
            .withColumn(out or f"{c}_freq_enc", F.coalesce(F.col("_freq"), F.lit(0.0))).drop("_freq"))


def global_mean(train: DataFrame, y: str = "y"):
    """Scalar-subquery column: mean of the target over the labelled table."""
    return train.agg(F.avg(y).alias("g")).scalar()


def oof_target_encode(train: DataFrame, c: str, y: str = "y", fold: str = "fold",
                      out: str | None = None) -> DataFrame:
    """Out-of-fold mean target per category for rows that carry a fold."""
    cells = (train.where(F.col(c).isNotNull()).groupBy(c, fold)
             .agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count(y).alias("_n")))
    # <= k cells per category: the per-category window input is bounded by k.
    wc = Window.partitionBy(c)
    enc = cells.select(c, fold, ((F.sum("_s").over(wc) - F.col("_s"))
                                 / F.nullif(F.sum("_n").over(wc) - F.col("_n"), F.lit(0))).alias("_enc"))
    g = global_mean(train, y)
    return (lookup(train, enc, [c, fold])
            .withColumn(out or f"{c}_target_enc", F.coalesce(F.col("_enc"), g)).drop("_enc"))


def target_map(train: DataFrame, c: str, y: str = "y") -> DataFrame:
    """E2 map: (c, mean y) over the whole labelled table."""
    return train.where(F.col(c).isNotNull()).groupBy(c).agg(F.avg(y).alias("_te"))


def test_target_encode(train: DataFrame, test: DataFrame, c: str, y: str = "y",
                       out: str | None = None) -> DataFrame:
    """Full-train target mean for the unlabelled table; unseen/NULL -> global mean."""
    g = global_mean(train, y)
    return (lookup(test, target_map(train, c, y), [c])
            .withColumn(out or f"{c}_target_enc", F.coalesce(F.col("_te"), g)).drop("_te"))


def category_codes(train: DataFrame, df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """P20: codes 0, 1, ... of the labelled table's levels in alphabetical order; unseen and
    NULL categories share the extra code ``#levels``.

    The level table stays distributed whatever its size: a level's code is the number of
    levels below it (``ranks.cumulative_below``), joined back like every encoding."""
    from foldwise.operators import ranks as R

    levels = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_level")).distinct().withColumn("one", F.lit(1))
    codes = materialize(R.cumulative_below(levels, [], "_level", ["one"]).select("_level", F.col("one_below").alias("_code")))
    n = codes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (lookup(df.withColumn("_level", F.col(c).cast("string")), codes, ["_level"])
            .withColumn(out or f"{c}_code", F.coalesce("_code", n).cast("double")).select(*df.columns, out or f"{c}_code"))
