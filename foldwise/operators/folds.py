"""Deterministic stratified k-fold assignment (E4) and fold leakage audit.

fold = (row_number() over (partition by y order by md5(id || '-' || seed), id) - 1) % k

The plain window has one partition per class -- two tasks for a binary target.
The scale form splits each class by the leading hex digits of the same md5
(uniform by construction, so every bucket holds ~n / 16^digits rows whatever the
data): per-(y, bucket) counts -> offsets by a window over <= 16^digits rows per
class -> ``row_number`` inside (y, bucket) + offset.  Because the bucket is a
prefix of the sort key, the result is identical to the plain formula: fold sizes
per class differ by at most one and do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.session import materialize


def stratified_folds(df: DataFrame, id_col: str = "id", y: str = "y", k: int = 5, seed: int = 42,
                     digits: int = 4, out: str = "fold", store: bool = False) -> DataFrame:
    """Add ``out`` (INT 0..k-1) to the labelled rows of ``df`` (NULL label -> no row).

    ``store=True`` checkpoints the result: a fold table is read by every fold's
    fit, every encoding and every fold metric, so it is derived once."""
    res = _folds(df.where(F.col(y).isNotNull()).withColumn("_h", X.hash_key(id_col, seed)), [y], id_col, k, digits, out)
    return materialize(res) if store else res


def _folds(lab: DataFrame, keys: list[str], id_col: str, k: int, digits: int, out: str) -> DataFrame:
    """Folds of rows with their hash ``_h``, dealt within ``keys``."""
    lab = lab.withColumn("_hb", F.substring("_h", 1, digits))
    counts = lab.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*keys).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_hb", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"))
    # (#classes x 16^digits) rows: few for a binary label, many for many classes, so the
    # join is left to adaptive execution, which broadcasts by measured size
    with_off = lab.join(offs, [*keys, "_hb"], "inner")
    wr = Window.partitionBy(*keys, "_hb").orderBy("_h", id_col)
    fold = ((F.col("_off") + F.row_number().over(wr) - 1) % k).cast("int")
    return with_off.withColumn(out, fold).drop("_h", "_hb", "_off")


def fold_table(df: DataFrame, seeds: Sequence[int], id_col: str = "id", y: str = "y", k: int = 5, digits: int = 4) -> DataFrame:
    """(id, seed, fold) for several seeds from one scan: a row per seed, dealt within (seed, label)."""
    rows = df.where(F.col(y).isNotNull()).select(id_col, y, F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    return _folds(rows.withColumn("_h", X.hash_key(id_col, F.col("seed"))), ["seed", y], id_col, k, digits, "fold").select(id_col, "seed", "fold")


def fold_leakage(df: DataFrame, features: Sequence[str], fold: str = "fold", split: str = "split",
                 id_col: str = "id", hash_key: bool = True) -> DataFrame:
    """Identical feature rows that fall in different folds or splits.

    Groups on a SHA-256 digest of the feature values (``hash_key=True``) so the
    shuffle carries 32 bytes per row instead of whole texts; NULLs group
    together.  Partial aggregation collapses a hot duplicate inside each map task.
    """
    if hash_key:
        # + 0.0: -0.0 and 0.0 are one value, as they are for groupBy
        real = {c for c, t in df.dtypes if t in ("double", "float")}
        key = F.sha2(F.to_json(F.struct(*[(F.col(c) + F.lit(0.0)).alias(c) if c in real else F.col(c) for c in features])), 256)
        g = df.groupBy(key.alias("_key"))
    else:
        g = df.groupBy(*features)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"),
                F.count_distinct(split).alias("n_splits"), F.count_distinct(fold).alias("n_folds"))
    out = out.where((F.col("n_splits") > 1) | (F.col("n_folds") > 1))
    return out.drop("_key") if hash_key else out
