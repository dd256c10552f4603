"""Catalog step 1: projections, predicates and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import features as FE
from foldwise.plans.common import (E_CAT, E_MISSING, E_NUM, O_CAT, O_NUM, O_ROLES, domain_sql, r6,
                                   row_stats_sql, sql_isna, sql_r6)
from foldwise.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}

# The event types present in the driver's events table, used as the
# fitted level list of the one-hot oracle.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SAMPLE_SEED = 7
SAMPLE_FRACTION = 0.15


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@q("isna_flags")
def isna_flags(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.isna_spec(E_MISSING).apply(df, keep=["id"])


ORACLE["isna_flags"] = FX.with_views(
    "SELECT id, " + ", ".join(f"{sql_isna(c)} AS {c}_isna" for c in E_MISSING) + " FROM obs_events",
    "obs_events")


@q("missing_counts")
def missing_counts(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.missing_count_spec(["x1", "x2", "x3"], E_CAT).apply(df, keep=["id"])


ORACLE["missing_counts"] = FX.with_views(
    "SELECT id, " + " + ".join(sql_isna(c) for c in E_MISSING) + " AS missing_count_total, "
    + " + ".join(sql_isna(c) for c in ["x1", "x2", "x3"]) + " AS missing_count_numeric, "
    + " + ".join(sql_isna(c) for c in E_CAT) + " AS missing_count_categorical FROM obs_events",
    "obs_events")


@q("ratio_features")
def ratio_features(spark, sf):
    df = FX.obs_orders(spark, sf)
    spec = FE.domain_spec(O_ROLES)
    return df.select("id", *[r6(e).alias(n) for n, e in spec.items])


ORACLE["ratio_features"] = FX.with_views(
    "SELECT id, " + ", ".join(domain_sql(O_ROLES)) + " FROM obs_orders", "obs_orders")


@q("residual_feature")
def residual_feature(spark, sf):
    df = FX.obs_orders(spark, sf)
    spec = FE.residual_spec("qty_total", ["qty_a", "qty_n", "qty_r"])
    (n1, e1), (n2, e2) = spec.items
    return df.select("id", r6(e1).alias(n1), e2.alias(n2))


ORACLE["residual_feature"] = FX.with_views(
    "SELECT id, " + sql_r6("qty_total - qty_a - qty_n - qty_r") + " AS other_screen_time, "
    "CAST((qty_total - qty_a - qty_n - qty_r) IS NULL AS INTEGER) AS other_screen_time_isna FROM obs_orders",
    "obs_orders")


@q("canonical_features")
def canonical_features(spark, sf):
    """The fixed, ordered canonical feature projection on obs_orders."""
    df = FX.obs_orders(spark, sf)
    out = FE.build_features(df, "id", "y", O_NUM, O_CAT, O_ROLES)
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _canonical_sql():
    cols = ["id", "y"] + [sql_r6(c) + f" AS {c}" if c not in ("n_lines",) else c for c in O_NUM] + list(O_CAT)
    cols += [f"{sql_isna(c)} AS {c}_isna" for c in O_NUM + O_CAT]
    cols += [" + ".join(sql_isna(c) for c in O_NUM + O_CAT) + " AS missing_count_total",
             " + ".join(sql_isna(c) for c in O_NUM) + " AS missing_count_numeric",
             " + ".join(sql_isna(c) for c in O_CAT) + " AS missing_count_categorical"]
    cols += domain_sql(O_ROLES)
    cols += [sql_r6("qty_total - qty_a - qty_n - qty_r") + " AS other_screen_time",
             "CAST((qty_total - qty_a - qty_n - qty_r) IS NULL AS INTEGER) AS other_screen_time_isna"]
    return FX.with_views("SELECT " + ", ".join(cols) + " FROM obs_orders", "obs_orders")


ORACLE["canonical_features"] = _canonical_sql()


@q("pair_features")
def pair_features(spark, sf):
    df = FX.obs_events(spark, sf)
    out = FE.pair_features(df, E_NUM)
    return out.select("id", *[r6(c).alias(c) for c in out.columns[1:]])


def _pair_sql():
    parts = []
    for i in range(len(E_NUM)):
        for j in range(i + 1, len(E_NUM)):
            a, b = E_NUM[i], E_NUM[j]
            parts.append(f"{sql_r6(f'{a} / (NULLIF({b}, 0) + 1e-5)')} AS {a}_div_{b}")
            parts.append(f"{sql_r6(f'{a} * {b}')} AS {a}_mul_{b}")
    return FX.with_views("SELECT id, " + ", ".join(parts) + " FROM obs_events", "obs_events")


ORACLE["pair_features"] = _pair_sql()


@q("row_stats")
def row_stats(spark, sf):
    df = FX.obs_events(spark, sf)
    out = FE.row_stats(df, E_NUM)
    return out.select("id", *[r6(c).alias(c) for c in out.columns[1:]])


def _row_stats_sql():
    inner, outer = row_stats_sql(E_NUM)
    return FX.with_views(f"SELECT id, {', '.join(outer)} FROM (SELECT id, {inner} FROM obs_events) t",
                         "obs_events")


ORACLE["row_stats"] = _row_stats_sql()


@q("value_flags")
def value_flags(spark, sf):
    df = FX.obs_events(spark, sf)
    return df.select("id", *FE.value_flags("x3", "x3_even", [2.0, 4.0, 6.0], "x3_in_set", 5.0, "x3_eq_5"))


ORACLE["value_flags"] = FX.with_views(
    "SELECT id, CAST(COALESCE(x3 % 2 = 0, false) AS INTEGER) AS x3_even, "
    "CAST(COALESCE(x3 IN (2.0, 4.0, 6.0), false) AS INTEGER) AS x3_in_set, "
    "CAST(COALESCE(x3 = 5.0, false) AS INTEGER) AS x3_eq_5 FROM obs_events", "obs_events")


@q("complete_cases")
def complete_cases(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.complete_cases(df, E_MISSING).select("id", "y")


ORACLE["complete_cases"] = FX.with_views(
    "SELECT id, y FROM obs_events WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in E_MISSING),
    "obs_events")


@q("half_open_filter")
def half_open_filter(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.half_open(df, "x1", 50.0, 150.0).select("id", "x1")


ORACLE["half_open_filter"] = FX.with_views(
    "SELECT id, x1 FROM obs_events WHERE x1 >= 50.0 AND x1 < 150.0", "obs_events")


@q("missing_conjunction")
def missing_conjunction(spark, sf):
    df = FX.obs_events(spark, sf)
    return df.select("id", (F.col("x1").isNull() & F.col("x2").isNull()).cast("int").alias("missing_x1_and_x2"))


ORACLE["missing_conjunction"] = FX.with_views(
    "SELECT id, CAST(x1 IS NULL AND x2 IS NULL AS INTEGER) AS missing_x1_and_x2 FROM obs_events", "obs_events")


@q("candidate_sums")
def candidate_sums(spark, sf):
    df = FX.obs_events(spark, sf)
    spec = (FE.FeatureSpec().sum_of("total_x", ["x1", "x3"]).sum_of("all3", ["value", "x1", "x3"]))
    out = spec.apply(df, keep=["id"])
    return out.select("id", r6("total_x").alias("total_x"), X.isna("total_x").alias("total_x_isna"),
                      r6("all3").alias("all3"), X.isna("all3").alias("all3_isna"))


ORACLE["candidate_sums"] = FX.with_views(
    "SELECT id, " + sql_r6("x1 + x3") + " AS total_x, CAST((x1 + x3) IS NULL AS INTEGER) AS total_x_isna, "
    + sql_r6("value + x1 + x3") + " AS all3, CAST((value + x1 + x3) IS NULL AS INTEGER) AS all3_isna "
    "FROM obs_events", "obs_events")


ROLE_COLS = ["user_id", "value", "x1", "x2", "x3", "c1", "c2", "s_c"]


@q("column_roles")
def column_roles(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.column_roles(df, ROLE_COLS).withColumnRenamed("column", "column_name")


def _roles_sql():
    string_cols = {"c1", "c2"}
    parts = []
    for c in ROLE_COLS:
        role = "'categorical'" if c in string_cols else \
            f"CASE WHEN count(DISTINCT {c}) < 15 THEN 'categorical' ELSE 'numeric' END"
        parts.append(f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
                     f"{role} AS role FROM obs_events")
    return FX.with_views(" UNION ALL ".join(parts), "obs_events")


ORACLE["column_roles"] = _roles_sql()


@q("one_hot")
def one_hot(spark, sf):
    df = FX.obs_events(spark, sf)
    levels = FE.fitted_levels(df.where(F.col("split") == "train"), "c1")
    return df.select("id", *FE.one_hot(df, "c1", levels))


ORACLE["one_hot"] = FX.with_views(
    "SELECT id, " + ", ".join(f"CAST(COALESCE(c1 = '{v}', false) AS INTEGER) AS c1_{v}" for v in EVENT_TYPES)
    + " FROM obs_events", "obs_events")


@q("discretize")
def discretize(spark, sf):
    df = FX.obs_events(spark, sf)
    return df.select("id", F.round("value", 0).alias("value_r0"),
                     F.floor(F.col("value") / 10).alias("value_w10"),
                     X.cross("c1", "c2").alias("c1_x_c2"))


ORACLE["discretize"] = FX.with_views(
    "SELECT id, round(value, 0) AS value_r0, CAST(floor(value / 10) AS BIGINT) AS value_w10, "
    "c1 || '_' || c2 AS c1_x_c2 FROM obs_events", "obs_events")


@q("hash_sample")
def hash_sample(spark, sf):
    df = FX.obs_events(spark, sf)
    return FE.hash_sample(df, "id", SAMPLE_SEED, SAMPLE_FRACTION).select("id", "y")


ORACLE["hash_sample"] = FX.with_views(
    f"SELECT id, y FROM obs_events WHERE substr(md5(CAST(id AS VARCHAR) || '-{SAMPLE_SEED}'), 1, 6) "
    f"< '{X.hash_sample_bound(SAMPLE_FRACTION)}'", "obs_events")


@q("clip_scores")
def clip_scores(spark, sf):
    df = FX.obs_events(spark, sf)
    return df.select("id", r6(X.clip(F.col("s_a") / 100.0)).alias("p"))


ORACLE["clip_scores"] = FX.with_views(
    "SELECT id, " + sql_r6("greatest(least(s_a / 100.0, 1.0), 0.0)") + " AS p FROM obs_events", "obs_events")


@q("prop_impute")
def prop_impute(spark, sf):
    df = FX.obs_events(spark, sf)
    out = FE.proportional_impute(df, "x1", "value", out="est_x1")
    return out.select("id", r6("est_x1").alias("est_x1"))


ORACLE["prop_impute"] = FX.with_views(
    "SELECT id, " + sql_r6("COALESCE(x1, value * (SELECT sum(x1) / NULLIF(sum(value), 0) FROM obs_events "
                           "WHERE x1 IS NOT NULL AND value IS NOT NULL))") + " AS est_x1 FROM obs_events",
    "obs_events")


@q("engagement_estimates")
def engagement_estimates(spark, sf):
    """P25: two imputed counts, their ratio, and the flag of a missing one."""
    df = FX.obs_events(spark, sf).select("id", "value", "x1", "x3")
    out = FE.engagement_estimates(df, "value", "x1", "x3")
    return out.select("id", *[r6(c).alias(c) for c in ("est_notifications", "est_app_opens", "est_notif_per_open")], "missing_key_engagement")


def _engagement_sql():
    est = {n: f"COALESCE({c}, value * (SELECT sum({c}) / NULLIF(sum(value), 0) FROM obs_events WHERE {c} IS NOT NULL AND value IS NOT NULL))"
           for n, c in (("est_notifications", "x1"), ("est_app_opens", "x3"))}
    return FX.with_views(
        f"SELECT id, {sql_r6('est_notifications')} AS est_notifications, {sql_r6('est_app_opens')} AS est_app_opens, "
        f"{sql_r6('est_notifications / NULLIF(est_app_opens, 0)')} AS est_notif_per_open, missing_key_engagement FROM (SELECT id, "
        + ", ".join(f"{e} AS {n}" for n, e in est.items())
        + ", CAST(x1 IS NULL OR x3 IS NULL AS INTEGER) AS missing_key_engagement FROM obs_events) e", "obs_events")


ORACLE["engagement_estimates"] = _engagement_sql()


@q("fill_missing")
def fill_missing(spark, sf):
    """Constant, mean and median fills (statistics fitted on the labelled rows)."""
    df = FX.obs_events(spark, sf)
    tr = df.where(F.col("split") == "train")
    out = FE.fill_missing(df, {"x1": "mean", "x2": "median", "c1": "missing"}, fitted_on=tr)
    return out.select("id", r6("x1").alias("x1"), r6("x2").alias("x2"), "c1")


ORACLE["fill_missing"] = FX.with_views(
    "SELECT id, " + sql_r6("COALESCE(x1, (SELECT avg(x1) FROM obs_events WHERE split = 'train'))") + " AS x1, "
    + sql_r6("COALESCE(x2, (SELECT quantile_cont(x2, 0.5) FROM obs_events WHERE split = 'train'))") + " AS x2, "
    "COALESCE(c1, 'missing') AS c1 FROM obs_events", "obs_events")


@q("feature_bundles")
def feature_bundles(spark, sf):
    """Named candidate bundles applied in one projection."""
    df = FX.obs_orders(spark, sf)
    spec = FE.FeatureSpec()
    for name in ("sm_weekend", "all3", "both"):  # "both" is "total_screen" and "age"
        spec.items += FE.bundle(name, {**O_ROLES, "age": "n_lines"}).items
    out = spec.apply(df, keep=["id"])
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


ORACLE["feature_bundles"] = FX.with_views(
    "SELECT id, " + sql_r6("qty_total + price_max") + " AS total_screen, "
    "CAST((qty_total + price_max) IS NULL AS INTEGER) AS total_screen_isna, "
    + sql_r6("qty_a + price_max") + " AS sm_weekend, CAST((qty_a + price_max) IS NULL AS INTEGER) AS sm_weekend_isna, "
    + sql_r6("qty_total + qty_a + price_max") + " AS all3_screen, "
    "CAST((qty_total + qty_a + price_max) IS NULL AS INTEGER) AS all3_screen_isna, CAST(n_lines AS VARCHAR) AS age_cat, "
    "CASE WHEN n_lines % 2 = 0 THEN 1 ELSE 0 END AS age_even, CASE WHEN n_lines IN (22, 24, 26, 28, 32) THEN 1 ELSE 0 END AS age_high_band "
    "FROM obs_orders", "obs_orders")
