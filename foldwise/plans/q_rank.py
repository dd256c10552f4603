"""Catalog step 3: ranks, rank ensembles and exact AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import auc as A
from foldwise.operators import binning as B
from foldwise.operators import blend as BL
from foldwise.operators import profile as P
from foldwise.operators import ranks as R
from foldwise.plans.common import E_MISSING, r6, sql_isna, sql_qcut, sql_r6
from foldwise.session import materialize
from foldwise.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def auc_sql(src: str, keys: list[str], score: str, y: str = "y") -> tuple[list[tuple[str, str]], str]:
    """Oracle: plain-window rank form of the AUC. Returns (extra CTEs, final select)."""
    kp = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    t = (f"SELECT {kp}CAST({score} AS DOUBLE) AS score, CAST(sum({y}) AS BIGINT) AS pos, "
         f"CAST(count(*) - sum({y}) AS BIGINT) AS neg FROM {src} WHERE {score} IS NOT NULL "
         f"GROUP BY {kp}CAST({score} AS DOUBLE)")
    c = (f"SELECT *, COALESCE(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING "
         "AND 1 PRECEDING), 0) AS nb FROM _t")
    num = "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE)"
    den = "CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0"
    final = (f"SELECT {kp}{sql_r6(f'{num} / NULLIF({den}, 0)')} AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, "
             f"CAST(sum(neg) AS BIGINT) AS n_neg FROM _c" + (f" GROUP BY {', '.join(keys)}" if keys else ""))
    return [("_t", t), ("_c", c)], final


def rank_sql(src: str, keys: list[str], score: str) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    part_s = f"PARTITION BY {', '.join(keys + [score])}"
    return (f"(rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part_s}) - 1) / 2.0)")


# ---------------------------------------------------------------- ranks


@q("rank01")
def rank01(spark, sf):
    p = FX.preds(spark, sf)
    out = R.rank01(p, "score", ["split", "seed", "model"])
    return out.select("id", "split", "seed", "model", r6("rank01").alias("rank01"))


ORACLE["rank01"] = FX.with_views(
    "SELECT id, split, seed, model, "
    + sql_r6(f"{rank_sql('preds', ['split', 'seed', 'model'], 'score')} / "
             "count(*) OVER (PARTITION BY split, seed, model)") + " AS rank01 FROM preds", "preds")


def _rank_avg_ctes():
    r = ("SELECT id, split, seed, model, " + rank_sql("preds", ["split", "seed", "model"], "score")
         + " AS r, count(*) OVER (PARTITION BY split, seed, model) AS n FROM preds")
    a = ("SELECT split, seed, id, CAST(sum(CAST(2 * r AS BIGINT)) AS DOUBLE) / "
         "(CAST(min(n) AS DOUBLE) * 2.0 * count(*)) AS score FROM _r GROUP BY split, seed, id")
    return [("_r", r), ("_a", a)]


@q("rank_average")
def rank_average(spark, sf):
    out = R.rank_average(FX.preds(spark, sf), "id", ["split", "seed"])
    return out.select("split", "seed", "id", r6("score").alias("score"))


ORACLE["rank_average"] = FX.with_views(
    f"SELECT split, seed, id, {sql_r6('score')} AS score FROM _a", "preds", extra=_rank_avg_ctes())


def _super_ctes():
    ctes = _rank_avg_ctes()
    r2 = ("SELECT split, seed, id, " + rank_sql("_a", ["split", "seed"], "score")
          + " AS r, count(*) OVER (PARTITION BY split, seed) AS n FROM _a")
    s = ("SELECT split, id, CAST(sum(CAST(2 * r AS BIGINT)) AS DOUBLE) / "
         "(CAST(min(n) AS DOUBLE) * 2.0 * count(*)) AS score FROM _r2 GROUP BY split, id")
    return ctes + [("_r2", r2), ("_s", s)]


@q("super_ensemble")
def super_ensemble(spark, sf):
    out = R.super_ensemble(FX.preds(spark, sf), "id", ["split"])
    return out.select("split", "id", r6("score").alias("score"))


ORACLE["super_ensemble"] = FX.with_views(
    f"SELECT split, id, {sql_r6('score')} AS score FROM _s", "preds", extra=_super_ctes())


@q("super_ensemble_auc")
def super_ensemble_auc(spark, sf):
    """W3 + J3 + A14: OOF AUC of the two-seed rank super-ensemble."""
    ens = R.super_ensemble(FX.preds(spark, sf).where(F.col("split") == "train"), "id", [])
    labelled = A.attach_labels(ens, FX.labels_of(spark, sf).select("id", "y"))
    return _round_doubles(A.auc(labelled, "score"))


def _super_auc_sql():
    ctes = [("_ptr", "SELECT * FROM preds WHERE split = 'train'")] + [
        (n, b.replace("FROM preds", "FROM _ptr")) for n, b in _super_ctes()]
    ctes.append(("_lab", "SELECT s.id, s.score, e.y FROM _s s JOIN obs_events e ON s.id = e.id"))
    extra, final = auc_sql("_lab", [], "score")
    return FX.with_views(final, "preds", extra=ctes + extra)


ORACLE["super_ensemble_auc"] = _super_auc_sql()


@q("group_pct_rank")
def group_pct_rank(spark, sf):
    """Percentile rank of value within each c1 subgroup."""
    out = R.rank01(FX.obs_events(spark, sf).where(F.col("c1").isNotNull()), "value", ["c1"], out="value_pct")
    return out.select("id", "c1", r6("value_pct").alias("value_pct"))


ORACLE["group_pct_rank"] = FX.with_views(
    "SELECT id, c1, " + sql_r6(f"{rank_sql('obs_events', ['c1'], 'value')} / count(*) OVER (PARTITION BY c1)")
    + " AS value_pct FROM obs_events WHERE c1 IS NOT NULL", "obs_events")


# ---------------------------------------------------------------- AUC

PANEL = ["value", "s_a", "s_b", "s_c", "x1", "x2", "x3"]


@q("auc_panel")
def auc_panel(spark, sf):
    return _round_doubles(A.auc_panel(FX.obs_events(spark, sf), PANEL))


def _panel_sql():
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS score, y FROM obs_events"
                              for f in PANEL)
    extra, final = auc_sql("_long", ["feature"], "score")
    return FX.with_views(final, "obs_events", extra=[("_long", long)] + extra)


ORACLE["auc_panel"] = _panel_sql()

COMMON = ["x1", "x2", "s_b"]


@q("auc_common_subset")
def auc_common_subset(spark, sf):
    df = FX.obs_events(spark, sf)
    out = A.auc_common_subset(df, COMMON, {"x1_plus_s_b": F.col("x1") + F.col("s_b"),
                                           "x1_s_b_w": F.col("x1") * 0.3 + F.col("s_b") * 0.7})
    return _round_doubles(out)


def _common_sql():
    sub = "SELECT * FROM obs_events WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND s_b IS NOT NULL"
    feats = [(f, f) for f in COMMON] + [("x1_plus_s_b", "x1 + s_b"), ("x1_s_b_w", "x1 * 0.3 + s_b * 0.7")]
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS score, y FROM _sub"
                              for n, e in feats)
    extra, final = auc_sql("_long", ["feature"], "score")
    return FX.with_views(final, "obs_events", extra=[("_sub", sub), ("_long", long)] + extra)


ORACLE["auc_common_subset"] = _common_sql()


@q("auc_subgroup")
def auc_subgroup(spark, sf):
    df = FX.obs_events(spark, sf).withColumn("miss_n", X.missing_count(E_MISSING))
    return _round_doubles(A.auc_subgroup(df, "s_a", "miss_n", min_support=100))


def _subgroup_sql():
    src = "SELECT *, " + " + ".join(sql_isna(c) for c in E_MISSING) + " AS miss_n FROM obs_events"
    extra, final = auc_sql("_src", ["miss_n"], "s_a")
    return FX.with_views(f"SELECT * FROM ({final}) z WHERE n_pos + n_neg > 100", "obs_events",
                         extra=[("_src", src)] + extra)


ORACLE["auc_subgroup"] = _subgroup_sql()


@q("auc_by_model")
def auc_by_model(spark, sf):
    """A19 + J3: OOF AUC per (seed, model) of the long prediction table."""
    p = FX.preds(spark, sf).where(F.col("split") == "train")
    lab = A.attach_labels(p, FX.labels_of(spark, sf).select("id", "y"))
    return _round_doubles(A.auc(lab, "score", keys=["seed", "model"]))


def _by_model_sql():
    src = "SELECT p.seed, p.model, p.score, e.y FROM preds p JOIN obs_events e ON p.id = e.id WHERE p.split = 'train'"
    extra, final = auc_sql("_src", ["seed", "model"], "score")
    return FX.with_views(final, "preds", extra=[("_src", src)] + extra)


ORACLE["auc_by_model"] = _by_model_sql()


@q("auc_by_decile")
def auc_by_decile(spark, sf):
    """AUC of s_a within each decile of value."""
    df = B.qcut(FX.obs_events(spark, sf), "value", 10, out="decile")
    return _round_doubles(A.auc(df.where(F.col("decile").isNotNull()), "s_a", keys=["decile"]))


def _decile_sql():
    cte, expr = sql_qcut("value", 10, "obs_events")
    src = f"SELECT s_a, y, CAST({expr} AS INTEGER) AS decile FROM obs_events"
    extra, final = auc_sql("_src", ["decile"], "s_a")
    return FX.with_views(final.replace("FROM _c", "FROM _c WHERE decile IS NOT NULL"), "obs_events",
                         extra=[cte, ("_src", src)] + extra)


ORACLE["auc_by_decile"] = _decile_sql()


@q("log_loss_subgroup")
def log_loss_subgroup(spark, sf):
    df = FX.obs_events(spark, sf).withColumn("p", X.clip(F.col("s_a") / 150.0))
    return _round_doubles(A.log_loss_by(df, "p", "c1"))


ORACLE["log_loss_subgroup"] = FX.with_views(
    "SELECT c1, " + sql_r6("avg(-(CAST(y AS DOUBLE) * ln(pc) + (1.0 - CAST(y AS DOUBLE)) * ln(1.0 - pc)))")
    + " AS log_loss, " + sql_r6("avg((p - CAST(y AS DOUBLE)) * (p - CAST(y AS DOUBLE)))") + " AS brier, "
    + sql_r6("avg(CAST((CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) <> y AS INTEGER))") + " AS error_rate, "
    "count(*) AS n FROM (SELECT *, greatest(least(p, 1.0 - 1e-15), 1e-15) AS pc FROM "
    "(SELECT *, greatest(least(s_a / 150.0, 1.0), 0.0) AS p FROM obs_events) a) b "
    "WHERE p IS NOT NULL AND c1 IS NOT NULL GROUP BY c1", "obs_events")

MODELS = ["m_a", "m_b", "m_c"]


MODEL_PAIRS = [(MODELS[i], MODELS[j]) for i in range(3) for j in range(i + 1, 3)]


@q("diversity_corr")
def diversity_corr(spark, sf):
    """Correlation of the models' prediction vectors within each split and seed (pivot models to columns, one agg)."""
    wide = BL.pivot_models(FX.preds(spark, sf), MODELS, by=["split", "seed"])
    return _round_doubles(P.corr_panel(wide, MODEL_PAIRS, ["split", "seed"]))


def _div_sql():
    wide = ("SELECT split, seed, id, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN score END) AS {m}" for m in MODELS)
            + " FROM preds GROUP BY split, seed, id")
    body = " UNION ALL ".join(
        f"SELECT split, seed, '{a}' AS a, '{b}' AS b, {sql_r6(f'corr({a}, {b})')} AS r, "
        f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM _w GROUP BY split, seed" for a, b in MODEL_PAIRS)
    return FX.with_views(body, "preds", extra=[("_w", wide)])


ORACLE["diversity_corr"] = _div_sql()


@q("diversity_seeds")
def diversity_seeds(spark, sf):
    """Correlation between the seeds' rank ensembles, on labelled and on test rows."""
    ens = R.rank_average(FX.preds(spark, sf), "id", ["split", "seed"])
    wide = BL.pivot_models(ens, [42, 100], model_col="seed", by=["split"])
    wide = wide.withColumnsRenamed({"42": "seed_42", "100": "seed_100"})
    return _round_doubles(P.corr_panel(wide, [("seed_42", "seed_100")], ["split"]))


ORACLE["diversity_seeds"] = FX.with_views(
    f"SELECT split, 'seed_42' AS a, 'seed_100' AS b, {sql_r6('corr(p, q)')} AS r, count(*) AS n FROM (SELECT split, id, "
    "max(CASE WHEN seed = 42 THEN score END) AS p, max(CASE WHEN seed = 100 THEN score END) AS q FROM _a GROUP BY split, id) z GROUP BY split",
    "preds", extra=_rank_avg_ctes())


# Quintiles keep every subgroup above the 100-row support floor from the
# smallest scale factor (1,000 events) upwards.
ENTRY_Q = 5


@q("entry_subgroup_auc")
def entry_subgroup_auc(spark, sf):
    """Flagship: how well does s_a rank y within each quintile of x1 (groups > 100 rows)?"""
    df = FX.obs_events(spark, sf)
    df = B.qcut(df, "x1", ENTRY_Q, out="x1_quintile")
    return _round_doubles(A.auc_subgroup(df, "s_a", "x1_quintile", min_support=100))


def _entry_sql():
    cte, expr = sql_qcut("x1", ENTRY_Q, "obs_events")
    src = f"SELECT s_a, y, CAST({expr} AS INTEGER) AS x1_quintile FROM obs_events"
    extra, final = auc_sql("_src", ["x1_quintile"], "s_a")
    final = final.replace("FROM _c", "FROM _c WHERE x1_quintile IS NOT NULL")
    return FX.with_views(f"SELECT * FROM ({final}) z WHERE n_pos + n_neg > 100", "obs_events",
                         extra=[cte, ("_src", src)] + extra)


ORACLE["entry_subgroup_auc"] = _entry_sql()


# ---------------------------------------------------------------- forced scale path
# The default plan picks a single window per group when a HyperLogLog check shows
# the groups are small (always true at test scale).  These keys force the
# bucketed plan (64 range buckets) and reuse the plain oracles, so the path that
# runs at 100 TB is checked against DuckDB on every round.


@q("rank01_bucketed")
def rank01_bucketed(spark, sf):
    p = FX.preds(spark, sf)
    out = R.rank01(p, "score", ["split", "seed", "model"], buckets=64)
    return out.select("id", "split", "seed", "model", r6("rank01").alias("rank01"))


ORACLE["rank01_bucketed"] = ORACLE["rank01"]


@q("auc_panel_bucketed")
def auc_panel_bucketed(spark, sf):
    return _round_doubles(A.auc_panel(FX.obs_events(spark, sf), PANEL, buckets=64))


ORACLE["auc_panel_bucketed"] = ORACLE["auc_panel"]


@q("super_ensemble_auc_bucketed")
def super_ensemble_auc_bucketed(spark, sf):
    ens = R.super_ensemble(FX.preds(spark, sf).where(F.col("split") == "train"), "id", [], buckets=64)
    labelled = A.attach_labels(ens, FX.labels_of(spark, sf).select("id", "y"))
    return _round_doubles(A.auc(labelled, "score", buckets=64))


ORACLE["super_ensemble_auc_bucketed"] = ORACLE["super_ensemble_auc"]


# ---------------------------------------------------------------- OOF diagnostics


def _diag_src(spark, sf):
    """OOF predictions joined to labels and the row's missing count."""
    ev = FX.obs_events(spark, sf).select("id", "y", X.missing_count(E_MISSING).alias("miss_n"))
    p = FX.preds(spark, sf).where(F.col("split") == "train")
    return A.attach_labels(p, ev).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("score") - 100.0) / 25.0)))


@q("oof_diagnostics")
def oof_diagnostics(spark, sf):
    """A17 + A19 + A21 in one report: AUC, log-loss and Brier per (seed, model),
    overall (miss_n = -1) and per missing-count subgroup."""
    src = _diag_src(spark, sf)
    keys = ["seed", "model", "subgroup"]
    # the labelled OOF table feeds the size check, the AUC and the log-loss: store it once
    src = materialize(src.select("seed", "model", "score", "p", "y", "miss_n"))
    both = src.withColumn("subgroup", F.col("miss_n")).unionByName(src.withColumn("subgroup", F.lit(-1)))
    a = A.auc(both, "score", keys=keys)
    ll = A.log_loss_by(both, "p", keys).select(*keys, "log_loss", "brier")
    return _round_doubles(a.join(ll, keys, "inner"))


def _diag_sql():
    src = ("SELECT p.seed, p.model, p.score, e.y, 1.0 / (1.0 + exp(-(p.score - 100.0) / 25.0)) AS p, "
           + " + ".join(sql_isna(c) for c in E_MISSING) + " AS miss_n FROM preds p JOIN obs_events e ON p.id = e.id "
           "WHERE p.split = 'train'")
    both = "SELECT *, miss_n AS subgroup FROM _src UNION ALL SELECT *, -1 AS subgroup FROM _src"
    extra, final = auc_sql("_both", ["seed", "model", "subgroup"], "score")
    ll = ("SELECT seed, model, subgroup, "
          + sql_r6("avg(-(CAST(y AS DOUBLE) * ln(greatest(least(p, 1.0 - 1e-15), 1e-15)) + (1.0 - CAST(y AS DOUBLE))"
                   " * ln(1.0 - greatest(least(p, 1.0 - 1e-15), 1e-15))))") + " AS log_loss, "
          + sql_r6("avg((p - CAST(y AS DOUBLE)) * (p - CAST(y AS DOUBLE)))") + " AS brier "
          "FROM _both GROUP BY seed, model, subgroup")
    return FX.with_views(f"SELECT a.*, l.log_loss, l.brier FROM ({final}) a JOIN ({ll}) l "
                         "ON a.seed = l.seed AND a.model = l.model AND a.subgroup = l.subgroup", "preds",
                         extra=[("_src", src), ("_both", both)] + extra)


ORACLE["oof_diagnostics"] = _diag_sql()
