"""Hard-constraint search and quantization profile.

Candidates are generated on the driver as column EXPRESSIONS (metadata).  Inside the
stage that reads it, a row becomes one row per right side and group of left sides
(``pairs.pair_rows``: compiled), and one aggregate keyed by these gives the statistics of
all candidates: the input is evaluated once for any number of candidates, and a task
shuffles one row per right side and group.  The statistics of a candidate:

* support     = rows where lhs and every rhs part are present
* violations  = count_if(lhs < rhs - eps)
* min_resid   = min(lhs - rhs)
* lhs_min / rhs_max (K6 trivial-hit filter: ranges must overlap)
* r_target    = corr(lhs - rhs, y) (K5), when a target is given
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import pairs as PR
from foldwise.session import materialize

#: Candidates of a row, without and with a target: their aggregates (5 and 19 fields each) together stay
#: within the compiler's limit of 100 fields.
BATCH, BATCH_TARGET = 16, 5


@dataclass(frozen=True)
class Constraint:
    lhs: str
    rhs: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.lhs} >= " + " + ".join(self.rhs)


def pair_candidates(cols: Sequence[str]) -> list[Constraint]:
    """K2: a >= b over all ordered pairs."""
    return [Constraint(a, (b,)) for a, b in itertools.permutations(cols, 2)]


def sum_candidates(cols: Sequence[str], n_addends: int = 2) -> list[Constraint]:
    """K3: c >= a + b (+ ...) over all addend sets and every other column as c."""
    out = []
    for parts in itertools.combinations(cols, n_addends):
        for c in cols:
            if c not in parts:
                out.append(Constraint(c, tuple(parts)))
    return out


def check_constraints(df: DataFrame, cands: Sequence[Constraint], eps: float = 1e-6,
                      y: str | None = None) -> DataFrame:
    """K1 for a list of candidates: one row per candidate, from one evaluation of ``df``.

    ``rhs`` is text for reports; ``parts`` holds the addends."""
    def side(names: Sequence[str]) -> Column:
        return X.sum_of([F.col(n).cast("double") for n in names])

    left, right = list(dict.fromkeys(c.lhs for c in cands)), list(dict.fromkeys(c.rhs for c in cands))
    width = min(len(left), BATCH if y is None else BATCH_TARGET)
    at = [(left.index(c.lhs), right.index(c.rhs)) for c in cands]
    keep = [] if y is None else ["_y"]
    src = df if y is None else df.withColumn("_y", F.col(y).cast("double"))
    long = PR.pair_rows(src, keep, [side([c]) for c in left], [side(c) for c in right], at, width)

    def stats(i: int) -> Column:
        lhs, rhs = F.col(f"_a{i}"), F.col("_b")
        resid = lhs - rhs
        fields = [F.lit(i).alias("slot"), F.count(resid).alias("support"),
                  F.count_if(lhs < rhs - F.lit(eps)).alias("violations"),
                  F.min(resid).alias("min_resid"),
                  F.min(F.when(rhs.isNotNull(), lhs)).alias("lhs_min"),
                  F.max(F.when(lhs.isNotNull(), rhs)).alias("rhs_max")]
        return F.struct(*fields, *([X.safe_corr(resid, "_y").alias("r_target")] if y is not None else []))

    wide = long.groupBy("_g", "_r").agg(*[stats(i).alias(f"k{i}") for i in range(width)])
    rows = wide.select("_g", "_r", F.inline(F.array(*[F.col(f"k{i}") for i in range(width)])))
    rows = rows.withColumn("_c", F.explode(PR.places(at, len(left), len(right), width)))

    def of(values) -> Column:
        return F.get(F.array(*values), F.col("_c"))

    return rows.select(of([F.lit(c.name) for c in cands]).alias("name"), of([F.lit(c.lhs) for c in cands]).alias("lhs"),
                       of([F.lit(" + ".join(c.rhs)) for c in cands]).alias("rhs"),
                       of([F.array(*map(F.lit, c.rhs)) for c in cands]).alias("parts"),
                       *[x for x in rows.columns if x not in ("_g", "_r", "_c", "slot")])


def search(df: DataFrame, cands: Sequence[Constraint], min_support: int, eps: float = 1e-6,
           y: str | None = None, require_overlap: bool = False) -> DataFrame:
    """K2/K3 (+K5/K6): zero-violation candidates with support above ``min_support``."""
    res = check_constraints(df, cands, eps)
    hits = res.where((F.col("violations") == 0) & (F.col("support") > min_support))
    if require_overlap:
        hits = hits.where(F.col("lhs_min") < F.col("rhs_max"))
    if y is not None:
        # the target's correlation of the hits alone; their list is bounded by the candidates
        hits = materialize(hits)
        found = {(r.lhs, tuple(r.parts)) for r in hits.select("lhs", "parts").collect()}
        own = [c for c in dict.fromkeys(cands) if (c.lhs, c.rhs) in found]
        if own:
            target = check_constraints(df, own, eps, y).select("lhs", "parts", "r_target")
            hits = hits.join(target, ["lhs", "parts"]).select(*hits.columns, "r_target")
        else:
            hits = hits.withColumn("r_target", F.lit(None).cast("double"))
    # O1: hits by support, largest first (a sort of the small hit list)
    return hits.orderBy(F.desc("support"), "name")


def crosscheck(hits: DataFrame, other: DataFrame, eps: float = 1e-6) -> DataFrame:
    """K4: re-evaluate found constraints on a second table.

    Only the hit list (bounded by the candidate count) reaches the driver; the
    second table is evaluated once, as in ``check_constraints``.
    """
    cands = [Constraint(r.lhs, tuple(r.parts)) for r in hits.select("lhs", "parts").collect()]
    if not cands:
        return other.sparkSession.createDataFrame([], "name string, support bigint, violations bigint, "
                                                      "min_resid double")
    return check_constraints(other, cands, eps).select("name", "support", "violations", "min_resid")


def violation_rates(df: DataFrame, cands: Sequence[Constraint], eps: float = 1e-6) -> DataFrame:
    """Soft constraints -- violation rate instead of a zero-violation filter."""
    res = check_constraints(df, cands, eps)
    return res.select("name", "support", "violations",
                      (F.col("violations") / F.nullif(F.col("support"), F.lit(0))).alias("violation_rate"))


def quantization(df: DataFrame, cols: Sequence[str], decimals: int = 2, approx: bool = False) -> DataFrame:
    """K7: non-integer fraction, distinct count at ``decimals`` dp, min, max per column; one scan, grouped by
    (column, rounded value), so that a common value is one row per map task."""
    from foldwise.operators import profile as P

    cells = [x for c in cols for x in (F.lit(c), F.col(c).cast("double"))]
    long = df.select(F.stack(F.lit(len(cols)), *cells).alias("column_name", "_x"))
    rounded = F.round("_x", decimals)
    part = long.groupBy("column_name", rounded.alias("_r")).agg(
        F.count("_x").alias("_n"), F.count_if(F.col("_x") != F.floor("_x")).alias("_f"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    distinct = F.count("_r").alias("n_distinct_round")
    if approx:  # no group per value: sketches instead
        part = long.groupBy("column_name").agg(F.count("_x").alias("_n"), F.count_if(F.col("_x") != F.floor("_x")).alias("_f"),
                                               F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        found = P.merged_distinct(P.distinct_sketches(df, {c: F.round(F.col(c).cast("double"), decimals) for c in cols}))
        part = part.join(found.withColumnRenamed("name", "column_name"), "column_name", "left")
        distinct = F.coalesce(F.max("n_distinct"), F.lit(0)).alias("n_distinct_round")
    return part.groupBy("column_name").agg((F.sum("_f") / F.nullif(F.sum("_n"), F.lit(0))).alias("frac_non_integer"), distinct,
                                           F.min("_lo").alias("min"), F.max("_hi").alias("max"))
