"""Catalog step 5: constraint search and data forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import auc as A
from foldwise.operators import constraints as K
from foldwise.operators import drift as D
from foldwise.operators import profile as P
from foldwise.functions import exprs as X
from foldwise.plans.common import E_MISSING, O_NUM, r6, sql_isna, sql_r6, sql_safe_corr
from foldwise.plans.q_rank import auc_sql
from foldwise.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}

EPS = 1e-6
MIN_SUPPORT = 1000


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cand_sql(c: K.Constraint, src: str, y: str | None = None) -> str:
    lhs = f"CAST({c.lhs} AS DOUBLE)"
    rhs = " + ".join(f"CAST({p} AS DOUBLE)" for p in c.rhs)
    rhs = f"({rhs})"
    cols = [f"'{c.name}' AS name", f"'{c.lhs}' AS lhs", f"'{' + '.join(c.rhs)}' AS rhs",
            f"count({lhs} - {rhs}) AS support",
            f"count(*) FILTER (WHERE {lhs} < {rhs} - {EPS!r}) AS violations",
            f"{sql_r6(f'min({lhs} - {rhs})')} AS min_resid",
            f"{sql_r6(f'min(CASE WHEN {rhs} IS NOT NULL THEN {lhs} END)')} AS lhs_min",
            f"{sql_r6(f'max(CASE WHEN {lhs} IS NOT NULL THEN {rhs} END)')} AS rhs_max"]
    if y:
        cols.append(f"{sql_r6(sql_safe_corr(f'{lhs} - {rhs}', f'CAST({y} AS DOUBLE)'))} AS r_target")
    return f"SELECT {', '.join(cols)} FROM {src}"


def _search_sql(cands, src, views, min_support=MIN_SUPPORT, y=None, extra=None):
    body = " UNION ALL ".join(_cand_sql(c, src, y) for c in cands)
    return FX.with_views(f"SELECT * FROM ({body}) z WHERE violations = 0 AND support > {min_support}",
                         *views, extra=extra)


PAIRS = K.pair_candidates(O_NUM)


@q("constraint_pairs")
def constraint_pairs(spark, sf):
    return _round_doubles(K.search(FX.obs_orders(spark, sf), PAIRS, MIN_SUPPORT, EPS).drop("parts"))


ORACLE["constraint_pairs"] = _search_sql(PAIRS, "obs_orders", ["obs_orders"])

SUMS = K.sum_candidates(O_NUM, 2)


@q("constraint_sums")
def constraint_sums(spark, sf):
    """K3 + K5: c >= a + b with the residual's correlation to the target."""
    return _round_doubles(K.search(FX.obs_orders(spark, sf), SUMS, MIN_SUPPORT, EPS, y="y").drop("parts"))


ORACLE["constraint_sums"] = _search_sql(SUMS, "obs_orders", ["obs_orders"], y="y")

SUMS3 = K.sum_candidates(O_NUM, 3)


@q("constraint_sums3")
def constraint_sums3(spark, sf):
    """K3 with three addends (the promoted constraint's shape)."""
    return _round_doubles(K.search(FX.obs_orders(spark, sf), SUMS3, MIN_SUPPORT, EPS, y="y").drop("parts"))


ORACLE["constraint_sums3"] = _search_sql(SUMS3, "obs_orders", ["obs_orders"], y="y")


@q("constraint_nontrivial")
def constraint_nontrivial(spark, sf):
    """K6: zero-violation pairs whose lhs and rhs ranges overlap."""
    return _round_doubles(K.search(FX.obs_orders(spark, sf), PAIRS, MIN_SUPPORT, EPS, require_overlap=True).drop("parts"))


ORACLE["constraint_nontrivial"] = FX.with_views(
    "SELECT * FROM (" + " UNION ALL ".join(_cand_sql(c, "obs_orders") for c in PAIRS) + ") z "
    f"WHERE violations = 0 AND support > {MIN_SUPPORT} AND lhs_min < rhs_max", "obs_orders")

HIGH = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@q("constraint_crosscheck")
def constraint_crosscheck(spark, sf):
    """K4: constraints found on high-priority orders, re-checked on the others."""
    o = FX.obs_orders(spark, sf)
    first, second = o.where(F.col("c1").isin(HIGH)), o.where(~F.col("c1").isin(HIGH))
    hits = K.search(first, PAIRS + SUMS3, 500, EPS)
    return _round_doubles(K.crosscheck(hits, second, EPS))


def _crosscheck_sql():
    cands = PAIRS + SUMS3
    inlist = ", ".join(f"'{v}'" for v in HIGH)
    first = " UNION ALL ".join(_cand_sql(c, "_first") for c in cands)
    second = " UNION ALL ".join(_cand_sql(c, "_second") for c in cands)
    return FX.with_views(
        "SELECT s.name, s.support, s.violations, s.min_resid FROM (" + second + ") s JOIN ("
        + first + ") f ON s.name = f.name WHERE f.violations = 0 AND f.support > 500", "obs_orders",
        extra=[("_first", f"SELECT * FROM obs_orders WHERE c1 IN ({inlist})"),
               ("_second", f"SELECT * FROM obs_orders WHERE c1 NOT IN ({inlist})")])


ORACLE["constraint_crosscheck"] = _crosscheck_sql()

SOFT = [K.Constraint("price_total", ("price_max", "price_min")), K.Constraint("qty_total", ("qty_a", "qty_n")),
        K.Constraint("price_max", ("price_min",))]


@q("soft_constraints")
def soft_constraints(spark, sf):
    return _round_doubles(K.violation_rates(FX.obs_orders(spark, sf), SOFT, EPS))


ORACLE["soft_constraints"] = FX.with_views(
    "SELECT name, support, violations, " + sql_r6("violations / NULLIF(support, 0)") + " AS violation_rate FROM ("
    + " UNION ALL ".join(_cand_sql(c, "obs_orders") for c in SOFT) + ") z", "obs_orders")

QUANT_COLS = ["value", "x1", "x3", "s_c"]


@q("quantization")
def quantization(spark, sf):
    return _round_doubles(K.quantization(FX.obs_events(spark, sf), QUANT_COLS))


ORACLE["quantization"] = FX.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, "
    f"{sql_r6(f'avg(CASE WHEN {c} IS NOT NULL THEN CAST({c} <> floor({c}) AS INTEGER) END)')} AS frac_non_integer, "
    f"count(DISTINCT round({c}, 2)) AS n_distinct_round, {sql_r6(f'min({c})')} AS min, {sql_r6(f'max({c})')} AS max "
    "FROM obs_events" for c in QUANT_COLS), "obs_events")

DUP_COLS = ["c1", "c2", "x3"]


@q("dup_rows")
def dup_rows(spark, sf):
    return D.duplicate_rows(FX.obs_events(spark, sf), DUP_COLS)


ORACLE["dup_rows"] = FX.with_views(
    "SELECT " + ", ".join(DUP_COLS) + ", count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train, "
    "count(*) FILTER (WHERE split = 'test') AS n_test, "
    "min(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in DUP_COLS) + ") AS width "
    "FROM obs_events GROUP BY " + ", ".join(DUP_COLS) + " HAVING count(*) > 1", "obs_events")

DUP_NUM = ["value", "x1", "x2", "x3", "s_a", "s_b", "s_c"]


@q("dup_rows_all")
def dup_rows_all(spark, sf):
    """D1 over all features; the continuous ones in steps of 100, or no two rows are alike."""
    ev = FX.obs_events(spark, sf)
    return D.duplicate_rows(ev.select("split", "c1", "c2", *[F.floor(F.col(c) / 100).alias(c) for c in DUP_NUM]), ["c1", "c2", *DUP_NUM])


ORACLE["dup_rows_all"] = FX.with_views(
    "SELECT " + ", ".join(["c1", "c2", *DUP_NUM]) + ", count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train, "
    "count(*) FILTER (WHERE split = 'test') AS n_test, "
    "min(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ["c1", "c2", *DUP_NUM]) + ") AS width "
    "FROM _g GROUP BY " + ", ".join(["c1", "c2", *DUP_NUM]) + " HAVING count(*) > 1", "obs_events",
    extra=[("_g", "SELECT split, c1, c2, " + ", ".join(f"CAST(floor({c} / 100) AS BIGINT) AS {c}" for c in DUP_NUM) + " FROM obs_events")])

KS_COLS = ["value", "x1", "x2", "x3", "s_a"]


@q("ks_drift")
def ks_drift(spark, sf):
    return _round_doubles(D.ks_drift(FX.obs_events(spark, sf), KS_COLS))


def _ks_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, split FROM obs_events "
                              f"WHERE {c} IS NOT NULL AND split IN ('train', 'test')" for c in KS_COLS)
    t = ("SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS na, "
         "count(*) FILTER (WHERE split = 'test') AS nb FROM _long GROUP BY feature, value")
    c = ("SELECT feature, value, sum(na) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING "
         "AND CURRENT ROW) AS ca, sum(nb) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED "
         "PRECEDING AND CURRENT ROW) AS cb, sum(na) OVER (PARTITION BY feature) AS ta, "
         "sum(nb) OVER (PARTITION BY feature) AS tb FROM _t")
    return FX.with_views(
        f"SELECT feature, {sql_r6('max(abs(ca / NULLIF(ta, 0) - cb / NULLIF(tb, 0)))')} AS ks, "
        "CAST(max(ta) AS BIGINT) AS n_a, CAST(max(tb) AS BIGINT) AS n_b FROM _c GROUP BY feature", "obs_events",
        extra=[("_long", long), ("_t", t), ("_c", c)])


ORACLE["ks_drift"] = _ks_sql()


@q("missing_drift")
def missing_drift(spark, sf):
    return _round_doubles(D.missing_drift(FX.obs_events(spark, sf), E_MISSING))


def _md_sql():
    parts = []
    for c in E_MISSING:
        parts.append(
            f"SELECT '{c}' AS column_name, "
            f"CAST(sum(CASE WHEN split = 'train' THEN CAST({c} IS NULL AS BIGINT) END) AS BIGINT) AS xa, "
            "count(CASE WHEN split = 'train' THEN 1 END) AS na, "
            f"CAST(sum(CASE WHEN split = 'test' THEN CAST({c} IS NULL AS BIGINT) END) AS BIGINT) AS xb, "
            "count(CASE WHEN split = 'test' THEN 1 END) AS nb FROM obs_events")
    s = " UNION ALL ".join(parts)
    ra, rb = "(xa / NULLIF(na, 0))", "(xb / NULLIF(nb, 0))"
    p = "((xa + xb) / NULLIF(na + nb, 0))"
    se = f"sqrt({p} * (1.0 - {p}) * (1.0 / na + 1.0 / nb))"
    return FX.with_views(f"SELECT column_name, {sql_r6(ra)} AS rate_a, {sql_r6(rb)} AS rate_b, "
                         f"{sql_r6(f'({ra} - {rb}) / NULLIF({se}, 0)')} AS z FROM ({s}) z", "obs_events")


ORACLE["missing_drift"] = _md_sql()


@q("mcar_corr")
def mcar_corr(spark, sf):
    return _round_doubles(D.mcar_flags_corr(FX.obs_events(spark, sf), E_MISSING))


ORACLE["mcar_corr"] = FX.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql_r6(f'corr(CAST({c} IS NULL AS DOUBLE), CAST(y AS DOUBLE))')} AS r, "
    f"{sql_r6(f'avg(CAST({c} IS NULL AS DOUBLE))')} AS missing_rate FROM obs_events" for c in E_MISSING),
    "obs_events")


@q("mcar_rate")
def mcar_rate(spark, sf):
    """Target rate by number of missing values in the row."""
    df = FX.obs_events(spark, sf).withColumn("miss_n", X.missing_count(E_MISSING))
    return _round_doubles(P.target_rate(df, "miss_n"))


ORACLE["mcar_rate"] = FX.with_views(
    f"SELECT miss_n, {sql_r6('avg(y)')} AS rate, count(y) AS n FROM (SELECT *, "
    + " + ".join(sql_isna(c) for c in E_MISSING) + " AS miss_n FROM obs_events) t GROUP BY miss_n", "obs_events")

SCAN_COLS = ["value", "s_a", "s_b", "x1"]


def _scan_combos():
    import itertools
    out = {}
    for r in (2, 3):
        for combo in itertools.combinations(SCAN_COLS, r):
            out["sum_" + "_".join(combo)] = combo
    return out


@q("sum_score_scan")
def sum_score_scan(spark, sf):
    """Univariate AUC of pairwise and triple sums on a common complete subset."""
    combos = {n: X.sum_of(list(parts)) for n, parts in _scan_combos().items()}
    return _round_doubles(A.auc_common_subset(FX.obs_events(spark, sf), SCAN_COLS, combos))


def _scan_sql():
    sub = "SELECT * FROM obs_events WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SCAN_COLS)
    feats = [(c, c) for c in SCAN_COLS] + [(n, " + ".join(p)) for n, p in _scan_combos().items()]
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS score, y FROM _sub"
                              for n, e in feats)
    extra, final = auc_sql("_long", ["feature"], "score")
    return FX.with_views(final, "obs_events", extra=[("_sub", sub), ("_long", long)] + extra)


ORACLE["sum_score_scan"] = _scan_sql()


@q("moderation")
def moderation(spark, sf):
    return _round_doubles(D.moderation(FX.obs_events(spark, sf), "c1", "x1"))


ORACLE["moderation"] = FX.with_views(
    f"SELECT c1, {sql_r6('corr(x1, y)')} AS r, "
    + sql_r6("covar_samp(x1, y) / NULLIF(var_samp(CASE WHEN y IS NOT NULL THEN x1 END), 0)") + " AS slope, "
    f"{sql_r6('avg(y)')} AS mean_y, {sql_r6('avg(x1)')} AS mean_x, "
    "count(CASE WHEN x1 IS NOT NULL AND y IS NOT NULL THEN 1 END) AS n FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1",
    "obs_events")


@q("ks_drift_bucketed")
def ks_drift_bucketed(spark, sf):
    """D2 through the bucketed running-sum plan (forced), same oracle."""
    return _round_doubles(D.ks_drift(FX.obs_events(spark, sf), KS_COLS, buckets=64))


ORACLE["ks_drift_bucketed"] = ORACLE["ks_drift"]
