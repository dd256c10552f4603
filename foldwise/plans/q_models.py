"""Catalog step 7: cross-validated Spark ML training and model-level ensembles
(M1-M10, E5, E6, B3-B6).  Scores of iterative fits are not SQL-expressible: those keys have
no oracle (row-count check).  What can be checked has keys of its own with one: what the fits are
given (fold medians, category cells, rows of each fold), that logistic fits are optimal, and isotonic
fits as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import auc as A
from foldwise.operators import binning as B
from foldwise.operators import encode as EN
from foldwise.operators import features as FE
from foldwise.operators import folds as FO
from foldwise.operators import isotonic as ISO
from foldwise.operators import logistic as LG
from foldwise.operators import models as M
from foldwise.operators import ranks as R
from foldwise.plans.common import DOMAIN_SQL, O_NUM, O_ROLES, r6, sql_r6
from foldwise.plans.q_encode import TRAIN_CTES, train_folds
from foldwise.plans.q_rank import rank_sql
from foldwise.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}

NUM = ["x1", "x2", "x3", "s_b"]
CAT = ["c1", "c2"]
FLAGS = ["x1_isna", "x2_isna", "x3_isna"]


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _train(spark, sf):
    tr = train_folds(spark, sf)
    return FE.isna_spec(["x1", "x2", "x3"]).apply(tr)


def _test(spark, sf):
    te = FX.obs_events(spark, sf).where(F.col("split") == "test")
    return FE.isna_spec(["x1", "x2", "x3"]).apply(te)


def _fold_auc(preds, spark, sf):
    per, _ = M.oof_auc(preds, FX.labels_of(spark, sf))
    return _round_doubles(per)


@q("cv_lr")
def cv_lr(spark, sf):
    """M1 + M5 + E5 + E6: logistic regression (C = 0.1) on imputed, scaled features."""
    p = M.cv_train(_train(spark, sf), NUM, CAT, FLAGS, "lr", test=_test(spark, sf))
    return _fold_auc(p, spark, sf)


@q("cv_rf")
def cv_rf(spark, sf):
    p = M.cv_train(_train(spark, sf), NUM, CAT, FLAGS, "rf", test=_test(spark, sf))
    return _fold_auc(p, spark, sf)


@q("cv_gbt")
def cv_gbt(spark, sf):
    """M3 + M7: gradient boosting with early stopping on rows drawn from the training folds."""
    p = M.cv_train(_train(spark, sf), NUM, CAT, FLAGS, "gbt", {"early_stopping": True}, test=_test(spark, sf))
    return _fold_auc(p, spark, sf)


@q("cv_mlp")
def cv_mlp(spark, sf):
    p = M.cv_train(_train(spark, sf), NUM, CAT, FLAGS, "mlp", test=_test(spark, sf))
    return _fold_auc(p, spark, sf)


SEEDS = [42, 100]
MODELS = ["m_a", "m_b", "m_c"]


def _fixture_oof(spark, sf):
    return FX.preds(spark, sf).select("id", "split", "seed", "model", "score")


@q("stack_lr")
def stack_lr(spark, sf):
    """Logistic stacking over the OOF score matrix, same folds."""
    lf = train_folds(spark, sf).select("id", "y", "fold")
    p = M.stack(_fixture_oof(spark, sf), lf, MODELS, "raw", seeds=SEEDS)
    return _fold_auc(p, spark, sf)


@q("stack_ranks")
def stack_ranks(spark, sf):
    """Stacking on rank percentiles."""
    lf = train_folds(spark, sf).select("id", "y", "fold")
    p = M.stack(_fixture_oof(spark, sf), lf, MODELS, "rank", seeds=SEEDS)
    return _fold_auc(p, spark, sf)


@q("isotonic")
def isotonic(spark, sf):
    """Per-fold isotonic calibration of every seed's and model's OOF scores; AUC before and after."""
    cal = ISO.isotonic_oof(_labelled_oof(spark, sf), by=["seed", "model"])
    keys = ["seed", "model", "fold"]
    raw = A.auc(cal, "score", keys=keys).select(*keys, F.col("auc").alias("auc_raw"))
    iso = A.auc(cal, "calibrated", keys=keys).select(*keys, F.col("auc").alias("auc_calibrated"))
    return _round_doubles(raw.join(iso, keys))


def _labelled_oof(spark, sf):
    lf = train_folds(spark, sf).select("id", "y", "fold")
    return _fixture_oof(spark, sf).where(F.col("split") == "train").drop("split").join(lf, "id")


@q("isotonic_fit")
def isotonic_fit(spark, sf):
    """The calibrated value of every whole score, fitted on the other folds."""
    d = _labelled_oof(spark, sf).withColumn("score", F.floor("score").cast("double"))
    out = ISO.isotonic_values(d, ["seed", "model"])
    return _round_doubles(out.select("seed", "model", "fold", "score", "n", "s", "calibrated"))


def _isotonic_sql():
    fit = "seed, model, k"
    ctes = [
        *TRAIN_CTES,
        ("_o", "SELECT p.seed, p.model, f.fold, f.y, CAST(floor(p.score) AS DOUBLE) AS x FROM preds p JOIN _f f ON p.id = f.id WHERE p.split = 'train'"),
        ("_c", "SELECT seed, model, fold, x, count(*) AS n, CAST(sum(y) AS BIGINT) AS s FROM _o GROUP BY seed, model, fold, x"),
        ("_k", "SELECT DISTINCT fold AS k FROM _f"),
        ("_t", f"SELECT {fit}, x, sum(n) AS n, sum(s) AS s FROM _c, _k WHERE fold <> k GROUP BY {fit}, x"),
        ("_u", f"SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM _t WINDOW w AS (PARTITION BY {fit} ORDER BY x)"),
        # the least mean from a up to any b at or after x, then the greatest of these over a at or before x
        ("_m", "SELECT a.seed, a.model, a.k, a.x AS a, b.x AS x, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER "
               "(PARTITION BY a.seed, a.model, a.k, a.x ORDER BY b.x DESC) AS least "
               "FROM _u a JOIN _u b ON a.seed = b.seed AND a.model = b.model AND a.k = b.k AND a.x <= b.x"),
        ("_g", f"SELECT {fit}, x, max(least) AS g FROM _m GROUP BY {fit}, x"),
        ("_lo", "SELECT c.*, g.x AS lo_x, g.g AS lo FROM _c c ASOF LEFT JOIN _g g ON c.seed = g.seed AND c.model = g.model AND c.fold = g.k AND c.x >= g.x"),
        ("_hi", "SELECT c.*, g.x AS hi_x, g.g AS hi FROM _lo c ASOF LEFT JOIN _g g ON c.seed = g.seed AND c.model = g.model AND c.fold = g.k AND c.x <= g.x"),
    ]
    value = ("CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR hi_x = lo_x THEN lo ELSE lo + (x - lo_x) * ((hi - lo) / (hi_x - lo_x)) END")
    return FX.with_views(f"SELECT seed, model, fold, x AS score, n, s, {sql_r6(value)} AS calibrated FROM _hi", "preds", extra=ctes)


ORACLE["isotonic_fit"] = _isotonic_sql()


def _certificate(store, models, label="_label"):
    """Gradients from an aggregate of their own, and the moments that the fits standardise with."""
    features = {k: store.column(k) for k in store.ks}
    cert = LG.certificate(store.data, models, store.names, features, label, store.fold)
    return _round_doubles(cert.select("left_out", "term", "n", "mean", "scale", "gradient"))


@q("lr_certificate")
def lr_certificate(spark, sf):
    """M5 + E5 + E6: the logistic fits of cv_lr's numeric columns: optimal (gradient 0), on standardised imputed columns."""
    store = M.FoldStore(_train(spark, sf), NUM, [], FLAGS, "lr")
    _, models = M.cv_logistic(store, {"lr": (store.positions(NUM, [], FLAGS), {})})
    return _certificate(store, models)


def _lr_certificate_sql():
    parts = []
    for c in NUM:
        v = f"COALESCE(CAST({c} AS DOUBLE), quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER (PARTITION BY k))"
        parts.append(f"SELECT k AS left_out, '_x_{c}' AS term, {v} AS v FROM _e")
    parts += [f"SELECT k AS left_out, '_x_{c}_isna' AS term, CAST(CAST({c} IS NULL AS INTEGER) AS DOUBLE) AS v FROM _e" for c in ("x1", "x2", "x3")]
    moments = ("SELECT left_out, term, count(*) AS n, avg(v) AS mean, CASE WHEN var_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS scale FROM ("
               + " UNION ALL ".join(parts) + ") z GROUP BY left_out, term UNION ALL SELECT k, 'intercept', count(*), 0.0, 1.0 FROM _e GROUP BY k")
    return FX.with_views(f"SELECT left_out, term, n, {sql_r6('mean')} AS mean, {sql_r6('scale')} AS scale, CAST(0.0 AS DOUBLE) AS gradient FROM ({moments}) m",
                         "obs_events", extra=[*TRAIN_CTES, ("_k", "SELECT CAST(unnest(range(5)) AS INTEGER) AS k"),
                                              ("_e", "SELECT * FROM _f, _k WHERE fold <> k")])


ORACLE["lr_certificate"] = _lr_certificate_sql()


@q("stack_certificate")
def stack_certificate(spark, sf):
    """B3 + B4: the meta-models' fits are optimal on the raw, rank and logit score matrices; rows and mean score of each fit."""
    lf = train_folds(spark, sf).select("id", "y", "fold")
    out = None
    for kind in ("raw", "rank", "logit"):
        store, names = M.stack_store(_oof_for(spark, sf, kind), lf, MODELS, kind, seeds=SEEDS)
        _, models = M.cv_logistic(store, {"stack": (store.positions(names), M.STACK_PARAMS)})
        cert = _certificate(store, models).select("left_out", "term", "n", "gradient")
        means = [F.struct(F.lit(k).alias("left_out"), F.lit(f"_x_{c}").alias("term"),
                          F.avg(F.when(F.col("fold") != k, F.col(store.column(k))[i])).alias("mean_score")) for k in store.ks for i, c in enumerate(names)]
        scores = store.data.agg(F.array(*means).alias("m")).select(F.inline("m"))
        part = cert.join(scores, ["left_out", "term"], "left").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return _round_doubles(out)


def _oof_for(spark, sf, kind):
    """The fixture's scores; as probabilities for log-odds."""
    oof = _fixture_oof(spark, sf)
    return oof.withColumn("score", F.col("score") / 500.0) if kind == "logit" else oof


def _stack_certificate_sql():
    score = {"raw": "score", "rank": rank_sql("_own", ["seed", "model"], "score") + " / count(*) OVER (PARTITION BY seed, model)",
             "logit": "ln(greatest(least(score / 500.0, 1 - 1e-6), 1e-6) / (1.0 - greatest(least(score / 500.0, 1 - 1e-6), 1e-6)))"}
    ctes = [*TRAIN_CTES, ("_k", "SELECT CAST(unnest(range(5)) AS INTEGER) AS k"), ("_own", "SELECT * FROM preds WHERE split = 'train'")]
    parts = []
    for kind, e in score.items():
        ctes.append((f"_s_{kind}", f"SELECT id, seed, model, {e} AS score FROM _own"))
        parts.append(f"SELECT '{kind}' AS kind, k AS left_out, '_x_' || p.model || '_' || p.seed AS term, count(*) AS n, avg(p.score) AS mean_score "
                     f"FROM _s_{kind} p JOIN _f f ON p.id = f.id, _k WHERE f.fold <> k GROUP BY k, p.model, p.seed "
                     f"UNION ALL SELECT '{kind}', k, 'intercept', count(*), NULL FROM _f, _k WHERE fold <> k GROUP BY k")
    return FX.with_views(f"SELECT kind, left_out, term, n, CAST(0.0 AS DOUBLE) AS gradient, {sql_r6('mean_score')} AS mean_score FROM ("
                         + " UNION ALL ".join(parts) + ") z", "preds", extra=ctes)


ORACLE["stack_certificate"] = _stack_certificate_sql()


def _order_features(spark, sf):
    """obs_orders' canonical features: (table with y, numeric, categorical, flag columns).

    c2 is the order status the label is derived from: it never enters a model."""
    o = FX.obs_orders(spark, sf)
    feats = FE.build_features(o, "id", "y", O_NUM, MODEL_CAT, O_ROLES)
    flags = [c for c in feats.columns if c.endswith("_isna")]
    return feats, [c for c in feats.columns if c not in ("id", "y", *MODEL_CAT, *flags)], MODEL_CAT, flags


MODEL_CAT = ["c1"]


@q("ablation")
def ablation(spark, sf):
    """M8: leave-one-group-out deltas of the nine feature groups, on one store."""
    feats, numeric, categorical, flags = _order_features(spark, sf)
    counts = [c for c in numeric if c.startswith("missing_count")]
    ratios = [n for n, _ in DOMAIN_SQL]
    groups = {"residual": [c for c in (*numeric, *flags) if c.startswith("other_screen_time")], "indicators": flags, "missing_counts": counts,
              "ratios": ratios, "categoricals": categorical, "price_total": ["price_total"],
              "notifications": [O_ROLES["notif"]], "app_opens": [O_ROLES["opens"]], "sleep": [O_ROLES["sleep"]]}
    train = FO.stratified_folds(feats, "id", "y", 5, 42, store=True)
    return _round_doubles(M.ablation(train, groups, numeric, categorical, flags, "lr"))


@q("screen")
def screen(spark, sf):
    """M9: candidate bundle (+x1) vs baseline, fold by fold."""
    base = {"numeric": ["x2", "x3", "s_b"], "categorical": CAT, "flags": ["x2_isna", "x3_isna"]}
    cand = {"numeric": NUM, "categorical": CAT, "flags": FLAGS}
    return _round_doubles(M.screen(_train(spark, sf), base, cand, "lr"))


#: Seventeen penalties, half a decade apart.
TUNE = {f"C_1e{(i - 8) / 2:+.1f}": {"C": 10.0 ** ((i - 8) / 2)} for i in range(17)}


@q("tune_scan")
def tune_scan(spark, sf):
    """Seventeen hyper-parameter candidates on the same folds, fitted together."""
    return _round_doubles(M.tune_scan(_train(spark, sf), TUNE, NUM, CAT, FLAGS, "lr",
                                      labels=FX.labels_of(spark, sf)))


CONFIGS = {"gbt_d3": ("gbt", {"maxIter": 10, "maxDepth": 3}), "lr": ("lr", {"C": 0.1})}


@q("multi_seed")
def multi_seed(spark, sf):
    """B6 + M2: two configs x 5 folds x 2 seeds on obs_orders' canonical features,
    rank super-ensemble, OOF AUC."""
    feats, numeric, _, flags = _order_features(spark, sf)
    numeric = [c for c in numeric if not c.startswith("missing_count")]
    flags = [c for c in flags if c != "c1_isna"]
    by_seed = {s: FO.stratified_folds(feats, "id", "y", 5, s, store=True) for s in (42, 100)}
    _, ens = M.multi_seed(by_seed, CONFIGS, numeric, MODEL_CAT, flags)
    lab = ens.where(F.col("split") == "train").join(feats.select("id", "y"), "id")
    return _round_doubles(A.auc(lab, "score"))


@q("stack_logit")
def stack_logit(spark, sf):
    """Stacking on log-odds of clipped scores."""
    lf = train_folds(spark, sf).select("id", "y", "fold")
    p = M.stack(_oof_for(spark, sf, "logit"), lf, MODELS, "logit", seeds=SEEDS)
    return _fold_auc(p, spark, sf)


@q("fold_medians")
def fold_medians(spark, sf):
    """E5: the exact medians that each fold's model imputes with."""
    return _round_doubles(M.fold_medians(train_folds(spark, sf), NUM, range(5)))


ORACLE["fold_medians"] = FX.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, k AS fold, {sql_r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median "
    f"FROM _f, _k WHERE fold <> k GROUP BY k" for c in NUM), "obs_events",
    extra=[*TRAIN_CTES, ("_k", "SELECT CAST(unnest(range(5)) AS INTEGER) AS k")])


@q("category_cells")
def category_cells(spark, sf):
    """E3 within training: label sums and counts by level and fold, and over all folds."""
    cells = M.category_cells(train_folds(spark, sf), "c2")
    return _round_doubles(cells.select("c2", F.explode("_cells").alias("fold", "cell"), F.col("_all.s").alias("s_all"), F.col("_all.n").alias("n_all"))
                          .select("c2", "fold", F.col("cell.s").alias("s"), F.col("cell.n").alias("n"), "s_all", "n_all"))


ORACLE["category_cells"] = FX.with_views(
    "SELECT c2, fold, s, n, sum(s) OVER (PARTITION BY c2) AS s_all, CAST(sum(n) OVER (PARTITION BY c2) AS BIGINT) AS n_all FROM ("
    "SELECT c2, fold, sum(CAST(y AS DOUBLE)) AS s, count(*) AS n FROM _f WHERE c2 IS NOT NULL GROUP BY c2, fold) z", "obs_events", extra=TRAIN_CTES)


@q("category_frequency")
def category_frequency(spark, sf):
    """E1 within training, with NULL labels: a level's share of the rows outside each fold, labelled or not."""
    df = FX.obs_events(spark, sf).select("c2", (F.col("id") % 5).cast("int").alias("fold"), F.when(F.col("id") % 4 != 1, F.col("y")).alias("y"))
    feats = M.FoldFeatures(df.withColumn("id", F.lit(0)), [], ["c2"], [], "lr", "id", "y", "fold")
    rows = feats.attach(df.select("c2").distinct().withColumn("fold", F.lit(None).cast("int")))
    names = feats.names()
    out = rows.select("c2", F.inline(F.array(*[F.struct(F.lit(k).alias("left_out"), *[e.alias(n) for n, e in zip(names, feats.columns(k, False))]) for k in feats.ks])))
    return _round_doubles(out.select("c2", "left_out", F.col(names[0]).alias("target"), F.col(names[1]).alias("freq")))


ORACLE["category_frequency"] = FX.with_views(
    f"SELECT l.c2, k.k AS left_out, {sql_r6('COALESCE(t.target, k.mean)')} AS target, {sql_r6('COALESCE(t.m, 0) / k.seen')} AS freq "
    "FROM (SELECT DISTINCT c2 FROM _d) l, "
    "(SELECT k, avg(CAST(y AS DOUBLE)) AS mean, CAST(count(c2) AS DOUBLE) AS seen FROM _d, _k WHERE fold <> k GROUP BY k) k "
    "LEFT JOIN (SELECT c2, k, avg(CAST(y AS DOUBLE)) AS target, count(*) AS m FROM _d, _k WHERE fold <> k AND c2 IS NOT NULL GROUP BY c2, k) t "
    "ON t.c2 = l.c2 AND t.k = k.k", "obs_events",
    extra=[("_d", "SELECT c2, CAST(id % 5 AS INTEGER) AS fold, CASE WHEN id % 4 <> 1 THEN y END AS y FROM obs_events"),
           ("_k", "SELECT CAST(unnest(range(5)) AS INTEGER) AS k")])


@q("stack_rows")
def stack_rows(spark, sf):
    """Rows and classes that the stack scores in each fold, and the test rows it averages."""
    lf = train_folds(spark, sf).select("id", "y", "fold")
    p = M.stack(_fixture_oof(spark, sf), lf, MODELS, "raw", seeds=SEEDS)
    return p.join(lf.select("id", "y"), "id", "left").groupBy("split", "fold").agg(
        F.count("score").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if((F.col("score") >= 0) & (F.col("score") <= 1)).alias("n_probabilities"))


ORACLE["stack_rows"] = FX.with_views(
    "SELECT 'train' AS split, fold, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE y = 1) AS n_pos, "
    "count(*) AS n_probabilities FROM _f GROUP BY fold UNION ALL "
    "SELECT 'test', NULL, count(*), count(DISTINCT id), 0, count(*) FROM obs_events WHERE split = 'test'", "obs_events", extra=TRAIN_CTES)


def _holes(df):
    """Labels, scores and bin values missing on fixed rows; a BIGINT score above 2^53."""
    return df.select("id", F.when(F.col("id") % 5 != 1, F.col("y")).alias("y"), F.when(F.col("id") % 7 != 2, F.col("x1")).alias("x1"),
                     F.when(F.col("id") % 7 != 2, F.lit(2 ** 53) + F.col("id") % 1000).alias("big"))


_HOLES_SQL = ("SELECT id, CASE WHEN id % 5 <> 1 THEN y END AS y, CASE WHEN id % 7 <> 2 THEN x1 END AS x1, "
              "CASE WHEN id % 7 <> 2 THEN 9007199254740992 + id % 1000 END AS big FROM obs_events")


@q("null_safe_auc")
def null_safe_auc(spark, sf):
    """A14 over rows with NULL labels and NULL scores, by an integer score that no double holds."""
    return _round_doubles(A.auc(_holes(FX.obs_events(spark, sf)), "big"))


ORACLE["null_safe_auc"] = FX.with_views(
    "SELECT " + sql_r6("sum(CASE WHEN y = 1 THEN below + same / 2.0 END) / (max(p) * max(n))")
    + " AS auc, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM ("
    "SELECT y, coalesce(sum(1 - y) OVER (ORDER BY big RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, "
    "sum(1 - y) OVER (PARTITION BY big) AS same, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM _h "
    "WHERE y IS NOT NULL AND big IS NOT NULL) z", "obs_events", extra=[("_h", _HOLES_SQL)])


@q("big_integer_rank")
def big_integer_rank(spark, sf):
    """W1/W8 in the score's own type."""
    return _round_doubles(R.average_rank(_holes(FX.obs_events(spark, sf)).select("id", "big"), "big", out="r", pct="r01"))


ORACLE["big_integer_rank"] = FX.with_views(
    "SELECT id, big, CASE WHEN big IS NOT NULL THEN r END AS r, CASE WHEN big IS NOT NULL THEN " + sql_r6("r / n") + " END AS r01 FROM ("
    "SELECT id, big, rank() OVER (ORDER BY big NULLS LAST) + (count(*) OVER (PARTITION BY big) - 1) / 2.0 AS r, "
    "count(big) OVER () AS n FROM _h) z", "obs_events", extra=[("_h", _HOLES_SQL)])


@q("null_safe_bins")
def null_safe_bins(spark, sf):
    """W5 and P19 with NULL values: no bin, no score."""
    df = _holes(FX.obs_events(spark, sf))
    return _round_doubles(B.cut_width(df, "x1", 8, "bin").select("id", "bin", X.clip(F.col("x1") / 10, 0.1, 0.9).alias("clipped")))


ORACLE["null_safe_bins"] = FX.with_views(
    "SELECT id, CAST(CASE WHEN x1 IS NULL THEN NULL WHEN x1 <= lo THEN 0 ELSE ceil((x1 - lo) / ((hi - lo) / 8.0)) - 1 END AS BIGINT) AS bin, "
    + sql_r6("CASE WHEN x1 IS NULL THEN NULL WHEN x1 / 10 < 0.1 THEN 0.1 WHEN x1 / 10 > 0.9 THEN 0.9 ELSE x1 / 10 END")
    + " AS clipped FROM _h, (SELECT min(x1) AS lo, max(x1) AS hi FROM _h) m", "obs_events", extra=[("_h", _HOLES_SQL)])


@q("wide_category_codes")
def wide_category_codes(spark, sf):
    """P20 on a category of more than 256 levels."""
    o = FX.obs_events(spark, sf).select("id", "split", (F.col("id") % 701).cast("string").alias("wide"))
    return EN.category_codes(o.where("split = 'train'"), o, "wide").select("id", "wide", F.col("wide_code").cast("long").alias("wide_code"))


ORACLE["wide_category_codes"] = FX.with_views(
    "SELECT o.id, o.wide, CAST(coalesce(c.code, (SELECT count(*) FROM _c)) AS BIGINT) AS wide_code FROM _o o LEFT JOIN _c c ON o.wide = c.wide",
    "obs_events", extra=[("_o", "SELECT id, split, CAST(id % 701 AS VARCHAR) AS wide FROM obs_events"),
                         ("_c", "SELECT wide, row_number() OVER (ORDER BY wide) - 1 AS code FROM (SELECT DISTINCT wide FROM _o WHERE split = 'train') z")])
