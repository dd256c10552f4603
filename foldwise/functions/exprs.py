"""Column-expression builders (JVM-side, codegen friendly, no Python UDFs).

Conventions shared by every operator:
* a zero denominator gives NULL (``x / NULLIF(y, 0)``), never an ANSI error or inf;
* predicates on a missing value are False, not NULL (``coalesce(pred, false)``);
* NaN is turned into NULL at ingest (see ``nan_to_null``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den with a zero denominator giving NULL."""
    return col(num) / F.nullif(col(den), F.lit(0))


def nan_to_null(c: ColumnOrName) -> Column:
    return F.nullif(col(c), F.lit(float("nan")))


def isna(c: ColumnOrName) -> Column:
    """Missingness indicator 0/1 (never NULL)."""
    return col(c).isNull().cast("int")


def missing_count(cols: Sequence[ColumnOrName]) -> Column:
    if not cols:
        return F.lit(0)
    return sum((isna(c) for c in cols[1:]), isna(cols[0]))


def sum_of(cols: Sequence[ColumnOrName]) -> Column:
    """Plain sum; NULL if any part is NULL (pandas ``a + b`` semantics)."""
    out = col(cols[0])
    for c in cols[1:]:
        out = out + col(c)
    return out


def residual(total: ColumnOrName, parts: Sequence[ColumnOrName]) -> Column:
    out = col(total)
    for p in parts:
        out = out - col(p)
    return out


def false_if_null(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def is_even(c: ColumnOrName) -> Column:
    return false_if_null(col(c) % 2 == 0).cast("int")


def is_member(c: ColumnOrName, values: Iterable) -> Column:
    return false_if_null(col(c).isin(list(values))).cast("int")


def clip(c: ColumnOrName, lo: float = 0.0, hi: float = 1.0) -> Column:
    """c within [lo, hi]; NULL stays NULL (``least`` and ``greatest`` alone skip it) and NaN, which
    they would take for the largest number, becomes NULL."""
    return F.when(col(c).isNotNull() & ~F.isnan(col(c).cast("double")), F.greatest(F.least(col(c), F.lit(hi)), F.lit(lo)))


def cross(a: ColumnOrName, b: ColumnOrName, sep: str = "_") -> Column:
    """Categorical crossing; NULL if either part is NULL (unlike concat_ws)."""
    return F.concat(col(a).cast("string"), F.lit(sep), col(b).cast("string"))


def row_stats(cols: Sequence[ColumnOrName], prefix: str = "row_num_") -> list[Column]:
    """Row mean / std (ddof 1) / max / min / sum / bias-corrected skew, NULL -> 0.

    Written as plain arithmetic over the fixed column list so it stays inside
    whole-stage codegen (no higher-order functions).
    """
    v = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols]
    n = len(v)
    total = sum(v[1:], v[0])
    mean = total / F.lit(float(n))
    dev = [x - mean for x in v]
    m2 = sum((d * d for d in dev[1:]), dev[0] * dev[0])
    m3 = sum((d * d * d for d in dev[1:]), dev[0] * dev[0] * dev[0])
    # floating noise below 1e-14 is treated as an exact zero
    m2z = F.when(F.abs(m2) < 1e-14, F.lit(0.0)).otherwise(m2)
    m3z = F.when(F.abs(m3) < 1e-14, F.lit(0.0)).otherwise(m3)
    k = n * math.sqrt(n - 1) / (n - 2) if n > 2 else float("nan")
    skew = F.when(m2z == 0, F.lit(0.0)).otherwise(F.lit(k) * m3z / F.pow(m2z, 1.5))
    return [
        mean.alias(f"{prefix}mean"),
        F.sqrt(m2 / F.lit(float(n - 1))).alias(f"{prefix}std"),
        F.greatest(*v).alias(f"{prefix}max") if n > 1 else v[0].alias(f"{prefix}max"),
        F.least(*v).alias(f"{prefix}min") if n > 1 else v[0].alias(f"{prefix}min"),
        total.alias(f"{prefix}sum"),
        skew.alias(f"{prefix}skew"),
    ]


def pair_features(cols: Sequence[str], eps: float = 1e-5) -> list[Column]:
    """Ratio and product of every two of the columns, in the order given.

    Fixed names: ``{a}_div_{b}`` is a / (nullif(b, 0) + eps), ``{a}_mul_{b}`` is a * b."""
    def both(a: str, b: str) -> list[Column]:
        ratio = F.col(a) / (F.nullif(F.col(b), F.lit(0)) + F.lit(eps))
        return [ratio.alias(f"{a}_div_{b}"), (F.col(a) * F.col(b)).alias(f"{a}_mul_{b}")]

    return [e for pair in combinations(cols, 2) for e in both(*pair)]


def hash_bucket(id_col: ColumnOrName, seed, digits: int = 3) -> Column:
    """Leading hex digits of md5(id || '-' || seed): uniform, engine independent."""
    return F.substring(F.md5(F.concat(col(id_col).cast("string"), F.lit("-"), F.lit(str(seed)))), 1, digits)


def hash_key(id_col: ColumnOrName, seed) -> Column:
    """md5 of "id-seed"; ``seed`` is a value or a column."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(col(id_col).cast("string"), F.lit("-"), seed))


def hash_sample_pred(id_col: ColumnOrName, seed, fraction: float, digits: int = 6) -> Column:
    """Deterministic sample predicate: md5 prefix below fraction * 16^digits.

    Independent of partitioning (unlike ``df.sample``) and reproducible in SQL.
    """
    bound = int(round(fraction * 16 ** digits))
    bound_hex = format(min(bound, 16 ** digits), "x").rjust(digits, "0")
    if bound >= 16 ** digits:
        return F.lit(True)
    return hash_bucket(id_col, seed, digits) < F.lit(bound_hex)


def hash_sample_bound(fraction: float, digits: int = 6) -> str:
    bound = int(round(fraction * 16 ** digits))
    return format(min(bound, 16 ** digits - 1), "x").rjust(digits, "0")


def cut_edges(x: ColumnOrName, edges: Sequence[float]) -> Column:
    """Explicit-edge binning, right-closed (e_i, e_i+1], outside -> NULL."""
    xc = col(x)
    expr = None
    for i in range(len(edges) - 1):
        cond = (xc > F.lit(float(edges[i]))) & (xc <= F.lit(float(edges[i + 1])))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def safe_corr(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pearson r over pairwise-complete rows; NULL when either side is constant.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode for a zero-variance input
    (e.g. a constraint residual that is exactly 0 everywhere), so the ratio is
    written out with a guarded denominator.  Constancy is told by minimum and maximum: merged
    variances of a constant can be a rounding error above 0.
    """
    ac, bc = col(a).cast("double"), col(b).cast("double")
    both = ac.isNotNull() & bc.isNotNull()
    ap, bp = F.when(both, ac), F.when(both, bc)
    varies = (F.min(ap) < F.max(ap)) & (F.min(bp) < F.max(bp))
    den = F.when(varies, F.sqrt(F.var_samp(ap) * F.var_samp(bp)))
    return F.covar_samp(ap, bp) / F.nullif(den, F.lit(0.0))
