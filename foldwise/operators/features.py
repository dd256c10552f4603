"""Declarative feature building.

A feature set is a list of named Column expressions compiled into ONE ``select``:
Catalyst collapses it into a single projection inside whole-stage codegen, and
column pruning reaches the parquet scan.  Column names are parameters, so the
same spec runs on any table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import exprs as X

RESIDUAL_FEATURE = "other_screen_time"
ROLES = ("daily", "social", "gaming", "work", "weekend", "sleep", "notif", "opens")


@dataclass
class FeatureSpec:
    """Ordered list of (name, expression); ``apply`` is a single projection."""

    items: list[tuple[str, Column]] = field(default_factory=list)

    def add(self, name: str, expr: Column) -> "FeatureSpec":
        self.items.append((name, expr))
        return self

    def share(self, name, part, whole):
        return self.add(name, X.safe_div(part, whole))

    def ratio(self, name, a, b):
        return self.add(name, X.safe_div(a, b))

    def diff(self, name, a, b):
        return self.add(name, X.col(a) - X.col(b))

    def sum_of(self, name, cols):
        return self.add(name, X.sum_of(cols))

    def residual(self, name, total, parts):
        return self.add(name, X.residual(total, parts))

    def isna(self, c, name=None):
        return self.add(name or f"{c}_isna", X.isna(c))

    def missing_count(self, name, cols):
        return self.add(name, X.missing_count(cols))

    def names(self) -> list[str]:
        return [n for n, _ in self.items]

    def columns(self) -> list[Column]:
        return [e.alias(n) for n, e in self.items]

    def apply(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        base = list(df.columns) if keep is None else list(keep)
        return df.select(*[F.col(c) for c in base], *self.columns())


def isna_spec(cols: Sequence[str]) -> FeatureSpec:
    spec = FeatureSpec()
    for c in cols:
        spec.isna(c)
    return spec


def missing_count_spec(numeric: Sequence[str], categorical: Sequence[str]) -> FeatureSpec:
    return (FeatureSpec()
            .missing_count("missing_count_total", list(numeric) + list(categorical))
            .missing_count("missing_count_numeric", list(numeric))
            .missing_count("missing_count_categorical", list(categorical)))


def domain_spec(roles: Mapping[str, str]) -> FeatureSpec:
    """The 15 ratio/interaction features (P6) on a role -> column mapping.

    Fixed values: the names and formulas of the canonical 44-column set, in its order."""
    r = {k: F.col(v) for k, v in roles.items()}
    d, s, g, w = r["daily"], r["social"], r["gaming"], r["work"]
    spec = FeatureSpec()
    spec.share("social_media_share", s, d)
    spec.share("gaming_share", g, d)
    spec.share("work_study_share", w, d)
    spec.share("entertainment_share", s + g, d)
    spec.ratio("weekend_weekday_ratio", r["weekend"], d)
    spec.diff("weekend_extra_screen", r["weekend"], d)
    spec.ratio("screen_sleep_ratio", d, r["sleep"])
    spec.share("sleep_awake_share", r["sleep"], r["sleep"] + d)
    spec.ratio("notifications_per_screen_hour", r["notif"], d)
    spec.ratio("app_opens_per_screen_hour", r["opens"], d)
    spec.ratio("notifications_per_app_open", r["notif"], r["opens"])
    spec.share("engagement_intensity", s + g + w, d)
    spec.ratio("work_sleep_ratio", w, r["sleep"])
    spec.ratio("app_opens_per_notification", r["opens"], r["notif"])
    spec.sum_of("total_active_hours", [s, g, w])
    return spec


def residual_spec(total: str, parts: Sequence[str], name: str = RESIDUAL_FEATURE) -> FeatureSpec:
    """Constraint residual total - sum(parts) and its missingness flag."""
    res = X.residual(total, parts)
    return FeatureSpec().add(name, res).add(f"{name}_isna", res.isNull().cast("int"))


def canonical_spec(numeric: Sequence[str], categorical: Sequence[str],
                   roles: Mapping[str, str]) -> FeatureSpec:
    """The canonical 44-column set: raw 9 + 3, 12 flags, 3 counts, 15 ratios, residual + flag."""
    spec = FeatureSpec()
    for c in list(numeric) + list(categorical):
        spec.add(c, F.col(c))
    spec.items += isna_spec(list(numeric) + list(categorical)).items
    spec.items += missing_count_spec(numeric, categorical).items
    spec.items += domain_spec(roles).items
    spec.items += residual_spec(roles["daily"], [roles["social"], roles["gaming"], roles["work"]]).items
    return spec


def build_features(df: DataFrame, id_col: str, target: str | None, numeric, categorical, roles) -> DataFrame:
    """id + canonical features (+ target when present), one projection."""
    spec = canonical_spec(numeric, categorical, roles)
    keep = [id_col] + ([target] if target and target in df.columns else [])
    return df.select(*[F.col(c) for c in keep], *spec.columns())


def feature_columns(df: DataFrame, id_col: str, target: str | None) -> list[str]:
    """All columns but id and target."""
    return [c for c in df.columns if c not in (id_col, target)]


def row_stats(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Row statistics over numeric columns with NULL -> 0 (needs >= 3 columns)."""
    if len(cols) < 3:
        return df.select(*keep)
    return df.select(*keep, *X.row_stats(cols))


def pair_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """P10/O2: pairwise ratios/products of the given columns in one projection (the caller
    picks and orders the columns; none is left out)."""
    return df.select(*keep, *X.pair_features(cols))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column is non-null."""
    return df.na.drop(how="any", subset=list(cols))


def half_open(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Lo <= c < hi."""
    return df.where((F.col(c) >= lo) & (F.col(c) < hi))


def column_roles(df: DataFrame, cols: Sequence[str], max_card: int = 15, approx: bool = False) -> DataFrame:
    """Categorical iff string typed or fewer than ``max_card`` distinct non-null values.

    One scan over all columns (NULL excluded), grouped by (column, value); ``approx=True`` takes mergeable
    HyperLogLog sketches instead.
    """
    from foldwise.operators import profile as P

    types = dict(df.dtypes)
    counts = P.distinct_counts(df, {c: F.col(c) for c in cols}, approx)
    stacked = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                 F.col(f"`{c}`").cast("bigint").alias("n_distinct"))
        for c in cols])))
    role = F.when((F.col("dtype") == "string") | (F.col("n_distinct") < max_card), F.lit("categorical")) \
        .otherwise(F.lit("numeric"))
    return stacked.select("column", "n_distinct", role.alias("role"))


def value_flags(c: str, even_name: str, members: Sequence, member_name: str,
                eq_value, eq_name: str) -> list[Column]:
    """Parity flag, membership flag, equality flag (missing -> 0)."""
    return [X.is_even(c).alias(even_name), X.is_member(c, members).alias(member_name),
            X.false_if_null(F.col(c) == F.lit(eq_value)).cast("int").alias(eq_name)]


def one_hot(df: DataFrame, c: str, levels: Sequence[str], prefix: str | None = None) -> list[Column]:
    """CASE flags for a level list fitted on the training table."""
    p = prefix or f"{c}_"
    return [X.false_if_null(F.col(c) == F.lit(v)).cast("int").alias(f"{p}{v}") for v in levels]


def fitted_levels(df: DataFrame, c: str, most: int = 1000) -> list[str]:
    """Sorted distinct non-null levels of a column: the names of its one-hot columns.

    No more than ``most`` + 1 reach the driver; a column of more levels is refused: one-hot columns are not
    the encoding for it (``encode`` has those)."""
    levels = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().limit(most + 1).collect()
    if len(levels) > most:
        raise ValueError(f"{c} has more than {most} levels")
    return sorted(r.v for r in levels)


def hash_sample(df: DataFrame, id_col: str, seed, fraction: float) -> DataFrame:
    """Deterministic subsample by md5(id || '-' || seed) prefix."""
    return df.where(X.hash_sample_pred(id_col, seed, fraction))


def proportional_impute(df: DataFrame, x: str, base: str, out: str | None = None) -> DataFrame:
    """P25: coalesce(x, base * sum(x)/sum(base)) with the ratio over complete rows.

    The global ratio is a scalar subquery: one partial/final aggregate, evaluated
    once and inlined as a literal into the projection.
    """
    both = df.where(F.col(x).isNotNull() & F.col(base).isNotNull())
    ratio = both.agg(X.safe_div(F.sum(x), F.sum(base)).alias("r")).scalar()
    return df.withColumn(out or f"est_{x}", F.coalesce(F.col(x), F.col(base) * ratio))


def engagement_estimates(df: DataFrame, base: str, notif: str, opens: str) -> DataFrame:
    """P25: estimates of two counts from ``base`` (``proportional_impute``) and what derives from them.

    ``est_notif_per_open`` is the ratio of the two estimates (NULL for a zero or missing one);
    ``missing_key_engagement`` is 1 where either count is missing.  The formulas are ours: the source of the
    experiment that names the columns is lost.  Both ratios come from one aggregate."""
    def ratio(x: str) -> Column:
        both = F.col(x).isNotNull() & F.col(base).isNotNull()
        return X.safe_div(F.sum(F.when(both, F.col(x))), F.sum(F.when(both, F.col(base))))

    ratios = df.agg(F.struct(ratio(notif).alias("n"), ratio(opens).alias("o")).alias("r")).scalar()
    out = df.select("*", F.coalesce(F.col(notif), F.col(base) * ratios["n"]).alias("est_notifications"),
                    F.coalesce(F.col(opens), F.col(base) * ratios["o"]).alias("est_app_opens"))
    return out.select("*", X.safe_div("est_notifications", "est_app_opens").alias("est_notif_per_open"),
                      (F.col(notif).isNull() | F.col(opens).isNull()).cast("int").alias("missing_key_engagement"))


def fill_missing(df: DataFrame, fills: Mapping[str, object], fitted_on: DataFrame | None = None) -> DataFrame:
    """Coalesce with a constant or a statistic fitted on ``fitted_on`` (default df).

    ``fills`` maps column -> constant | "mean" | "median".  Statistics are scalar
    subqueries, inlined as literals; the median is exact, by rank selection.
    """
    from foldwise.operators import binning as B

    src = fitted_on if fitted_on is not None else df
    cols = []
    for c in df.columns:
        if c not in fills:
            cols.append(F.col(c))
            continue
        v = fills[c]
        if v == "mean":
            stat = src.agg(F.avg(c)).scalar()
        elif v == "median":
            stat = F.get(B.quantiles(src, c, [0.5]).scalar(), 0)
        else:
            stat = F.lit(v)
        cols.append(F.coalesce(F.col(c), stat).alias(c))
    return df.select(*cols)


# Named candidate-feature bundles -- name -> builder(roles) -> FeatureSpec.
def _bundle_total_screen(r):
    return FeatureSpec().sum_of("total_screen", [r["daily"], r["weekend"]]).add(
        "total_screen_isna", X.sum_of([r["daily"], r["weekend"]]).isNull().cast("int"))


def _bundle_sm_weekend(r):
    return FeatureSpec().sum_of("sm_weekend", [r["social"], r["weekend"]]).add(
        "sm_weekend_isna", X.sum_of([r["social"], r["weekend"]]).isNull().cast("int"))


def _bundle_all3(r):
    parts = [r["daily"], r["social"], r["weekend"]]
    return FeatureSpec().sum_of("all3_screen", parts).add("all3_screen_isna", X.sum_of(parts).isNull().cast("int"))


# The high-rate ages of the reference's age bundle.
AGE_HIGH_BAND = (22, 24, 26, 28, 32)


def _bundle_age(r):
    age = F.col(r["age"])
    return FeatureSpec().add("age_cat", age.cast("string")).add("age_even", X.is_even(age)).add(
        "age_high_band", X.is_member(age, AGE_HIGH_BAND))


def _bundle_both(r):
    out = _bundle_total_screen(r)
    out.items += _bundle_age(r).items
    return out


BUNDLES = {"total_screen": _bundle_total_screen, "sm_weekend": _bundle_sm_weekend, "all3": _bundle_all3,
           "age": _bundle_age, "both": _bundle_both}


def bundle(name: str, roles: Mapping[str, str]) -> FeatureSpec:
    return BUNDLES[name](roles)
