"""Catalog step 6: blend sweeps, run comparison, verdicts, schema advice, codes
(B1, B2, D9, M11, P20, P21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import blend as BL
from foldwise.operators import encode as EN
from foldwise.plans.common import r6, sql_r6
from foldwise.plans.q_encode import TRAIN_CTES, train_folds
from foldwise.plans.q_rank import MODELS, auc_sql, rank_sql
from foldwise.sources import fixtures as FX
from foldwise.sources import io as IO

QUERIES: dict = {}
ORACLE: dict = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


GRID = BL.simplex_grid(3, 10)
RATIOS = BL.ratio_weights()


def _train_preds(spark, sf):
    return FX.preds(spark, sf).where(F.col("split") == "train")


def _labelled_wide(spark, sf, models, rank_scaled=False):
    p = _train_preds(spark, sf).where(F.col("model").isin(list(models)))
    if rank_scaled:
        p = BL.rank_scale(p, ["seed"])
    wide = BL.pivot_models(p, models, by=["seed"])
    return wide.join(FX.labels_of(spark, sf).select("id", "y"), "id", "inner")


def _sweep(spark, sf, models, weights, rank_scaled=False):
    return BL.blend_sweep(_labelled_wide(spark, sf, models, rank_scaled), models, weights, by=["seed"])


@q("blend_sweep")
def blend_sweep(spark, sf):
    """B1: exact AUC of every 3-model weight vector on a 0.1 simplex grid, for each seed."""
    return _round_doubles(_sweep(spark, sf, MODELS, GRID))


def _sweep_ctes(models, weights, rank_scaled=False):
    src = "_p"
    ctes = [("_p", "SELECT * FROM preds WHERE split = 'train' AND model IN ("
             + ", ".join(f"'{m}'" for m in models) + ")")]
    if rank_scaled:
        ctes.append(("_pr", "SELECT seed, id, model, " + rank_sql("_p", ["seed", "model"], "score")
                     + " / count(*) OVER (PARTITION BY seed, model) AS score FROM _p"))
        src = "_pr"
    ctes.append(("_wide", "SELECT seed, id, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN score END) AS {m}"
                                                          for m in models) + f" FROM {src} GROUP BY seed, id"))
    ctes.append(("_lab", "SELECT w.*, e.y FROM _wide w JOIN obs_events e ON w.id = e.id"))
    vals = ", ".join("(" + ", ".join([str(i)] + [f"CAST({float(x)!r} AS DOUBLE)" for x in w]) + ")"
                     for i, w in enumerate(weights))
    ctes.append(("_wt", f"SELECT * FROM (VALUES {vals}) t(w_id, " + ", ".join(f"w_{m}" for m in models) + ")"))
    # one branch per weight vector: every labelled row scored under each weight
    branches = []
    for i, w in enumerate(weights):
        expr = " + ".join(f"CAST({float(x)!r} AS DOUBLE) * l.{m}" for m, x in zip(models, w))
        branches.append(f"SELECT l.seed, {i} AS w_id, l.y, {expr} AS score FROM _lab l")
    ctes.append(("_bl", " UNION ALL ".join(branches)))
    extra, final = auc_sql("_bl", ["seed", "w_id"], "score")
    return ctes + extra, final


def _sweep_sql(models, weights, rank_scaled=False):
    ctes, final = _sweep_ctes(models, weights, rank_scaled)
    wcols = ", ".join(f"{sql_r6(f'_wt.w_{m}')} AS w_{m}" for m in models)
    return FX.with_views(f"SELECT a.*, {wcols} FROM ({final}) a JOIN _wt ON a.w_id = _wt.w_id", "preds",
                         extra=ctes)


ORACLE["blend_sweep"] = _sweep_sql(MODELS, GRID)


@q("blend_best")
def blend_best(spark, sf):
    """B1: the best weight vector of each seed; bin counts rule out most of the others."""
    return _round_doubles(BL.best_weights(_labelled_wide(spark, sf, MODELS), MODELS, GRID, by=["seed"]))


def _best_sql():
    ctes, final = _sweep_ctes(MODELS, GRID)
    raw = final.replace(sql_r6(
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)"),
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)")
    wcols = ", ".join(f"{sql_r6(f'_wt.w_{m}')} AS w_{m}" for m in MODELS)
    return FX.with_views(
        f"SELECT a.seed, a.w_id, {sql_r6('a.auc')} AS auc, a.n_pos, a.n_neg, {wcols} FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY seed ORDER BY auc DESC, w_id) AS i FROM ({raw}) r) a "
        "JOIN _wt ON a.w_id = _wt.w_id WHERE a.i = 1", "preds", extra=ctes)


ORACLE["blend_best"] = _best_sql()


BOUND_BINS = 64


@q("blend_bounds")
def blend_bounds(spark, sf):
    """B1: bounds of every weight vector's AUC from bin counts, which merge in any order."""
    return _round_doubles(BL.blend_bounds(_labelled_wide(spark, sf, MODELS), MODELS, GRID, by=["seed"], bins=BOUND_BINS))


def _bounds_sql():
    ctes, _ = _sweep_ctes(MODELS, GRID)
    ctes = [c for c in ctes if c[0] not in ("_t", "_c")]
    ends = ", ".join(f"min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in MODELS)
    ctes.append(("_ends", f"SELECT {ends} FROM _lab"))
    lo, hi = (" + ".join(f"_wt.w_{m} * _ends.{e}_{m}" for m in MODELS) for e in ("lo", "hi"))
    ctes.append(("_scale", f"SELECT w_id, {lo} AS lo, {BOUND_BINS} / ({hi} - ({lo})) AS scale FROM _wt, _ends"))
    ctes.append(("_bins", "SELECT b.seed, b.w_id, b.y, CAST(greatest(0, least("
                 f"{BOUND_BINS - 1}, floor((b.score - s.lo) * s.scale))) AS INTEGER) AS bin FROM _bl b JOIN _scale s ON s.w_id = b.w_id"))
    ctes.append(("_n", "SELECT seed, w_id, bin, sum(y) AS pos, count(*) - sum(y) AS neg FROM _bins GROUP BY seed, w_id, bin"))
    ctes.append(("_below", "SELECT *, COALESCE(sum(neg) OVER (PARTITION BY seed, w_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING "
                 "AND 1 PRECEDING), 0) AS below FROM _n"))
    low, high = (f"CAST(sum(CAST(pos AS HUGEINT) * CAST({t} AS HUGEINT)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0)"
                 for t in ("2 * below", "2 * below + 2 * neg"))
    agg = (f"SELECT seed, w_id, {sql_r6(low)} AS auc_low, {sql_r6(high)} AS auc_high, CAST(sum(pos) AS BIGINT) AS n_pos, "
           "CAST(sum(neg) AS BIGINT) AS n_neg FROM _below GROUP BY seed, w_id")
    wcols = ", ".join(f"{sql_r6(f'_wt.w_{m}')} AS w_{m}" for m in MODELS)
    return FX.with_views(f"SELECT a.*, {wcols} FROM ({agg}) a JOIN _wt ON a.w_id = _wt.w_id", "preds", extra=ctes)


ORACLE["blend_bounds"] = _bounds_sql()

TWO = ["m_a", "m_b"]


@q("blend_ratios_raw")
def blend_ratios_raw(spark, sf):
    """B2: the fixed two-model ratio list on raw scores."""
    return _round_doubles(_sweep(spark, sf, TWO, RATIOS))


ORACLE["blend_ratios_raw"] = _sweep_sql(TWO, RATIOS)


@q("blend_ratios_rank")
def blend_ratios_rank(spark, sf):
    """B2: the same ratios after rank-scaling each source to rank / n."""
    return _round_doubles(_sweep(spark, sf, TWO, RATIOS, rank_scaled=True))


ORACLE["blend_ratios_rank"] = _sweep_sql(TWO, RATIOS, rank_scaled=True)


def _run_compare_df(spark, sf):
    folds = train_folds(spark, sf).select("id", "fold", "y")
    scored = _train_preds(spark, sf).join(folds, "id", "inner")
    return BL.compare_runs(scored, "model", "m_b", "m_a", by=["seed"])


@q("run_compare")
def run_compare(spark, sf):
    """Fold-by-fold AUC of a candidate run against a baseline run."""
    return _round_doubles(_run_compare_df(spark, sf))


def _compare_ctes():
    src = ("SELECT p.seed, p.model, p.score, f.fold, f.y FROM preds p JOIN _f f ON p.id = f.id "
           "WHERE p.split = 'train' AND p.model IN ('m_a', 'm_b')")
    extra, final = auc_sql("_src", ["seed", "model", "fold"], "score")
    raw = final.replace(sql_r6(
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)"),
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)")
    cmp = ("SELECT b.seed, b.fold, b.auc AS auc_base, c.auc AS auc_cand, c.auc - b.auc AS delta "
           "FROM _per b JOIN _per c ON b.seed = c.seed AND b.fold = c.fold WHERE b.model = 'm_b' AND c.model = 'm_a'")
    return TRAIN_CTES + [("_src", src)] + extra + [("_per", raw), ("_cmp", cmp)]


ORACLE["run_compare"] = FX.with_views(
    f"SELECT seed, fold, {sql_r6('auc_base')} AS auc_base, {sql_r6('auc_cand')} AS auc_cand, {sql_r6('delta')} AS delta "
    "FROM _cmp", "preds", extra=_compare_ctes())


@q("promotion_verdict")
def promotion_verdict(spark, sf):
    """mean/sd of paired fold deltas, folds improved, verdict."""
    return _round_doubles(BL.promotion_verdict(_run_compare_df(spark, sf), by=["seed"]))


ORACLE["promotion_verdict"] = FX.with_views(
    f"SELECT seed, {sql_r6('avg(delta)')} AS mean_delta, {sql_r6('stddev_samp(delta)')} AS sd_delta, "
    "count(*) FILTER (WHERE delta > 0) AS folds_improved, count(delta) AS n_folds, "
    "CASE WHEN avg(delta) > 0.0003 AND count(*) FILTER (WHERE delta > 0) * 2 > count(delta) THEN 'promote' "
    "WHEN avg(delta) < 0 THEN 'reject' ELSE 'neutral' END AS verdict FROM _cmp GROUP BY seed", "preds", extra=_compare_ctes())

ADVISE = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
          ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")]


@q("schema_advisor")
def schema_advisor(spark, sf):
    """Narrowest storage type per column of the whole lineitem table."""
    li = FX.read_table(spark, sf, "lineitem")
    return _round_doubles(IO.schema_advisor(li, [c for c, _ in ADVISE]))


def _advisor_sql():
    parts = []
    for c, t in ADVISE:
        mn, mx = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
        if t in ("bigint", "int"):
            sug = (f"CASE WHEN {mn} > -128 AND {mx} < 127 THEN 'tinyint' WHEN {mn} > -32768 AND {mx} < 32767 "
                   f"THEN 'smallint' WHEN {mn} > -2147483648 AND {mx} < 2147483647 THEN 'int' ELSE 'bigint' END")
        else:
            sug = "'float'"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, {sql_r6(mn)} AS min, {sql_r6(mx)} AS max, "
                     f"{sug} AS suggested FROM lineitem")
    return " UNION ALL ".join(parts)


ORACLE["schema_advisor"] = _advisor_sql()


@q("category_codes")
def category_codes(spark, sf):
    """P20: alphabetical codes fitted on the labelled rows; unseen/NULL -> #levels."""
    df = FX.obs_events(spark, sf)
    out = EN.category_codes(df.where(F.col("split") == "train"), df, "c1")
    return out.select("id", "c1_code")


ORACLE["category_codes"] = FX.with_views(
    "SELECT e.id, CAST(COALESCE(l.code, (SELECT count(*) FROM _lv)) AS DOUBLE) AS c1_code "
    "FROM obs_events e LEFT JOIN _lv l ON e.c1 = l.c1", "obs_events",
    extra=[("_lv", "SELECT c1, row_number() OVER (ORDER BY c1) - 1 AS code FROM "
                   "(SELECT DISTINCT c1 FROM obs_events WHERE split = 'train' AND c1 IS NOT NULL) d")])


@q("label_scan")
def label_scan(spark, sf):
    """S3: single-column label read -- parquet column pruning keeps the scan to
    the columns the label derives from."""
    return FX.labels_of(spark, sf).select("id", "y")


ORACLE["label_scan"] = FX.with_views("SELECT id, y FROM obs_events", "obs_events")


@q("json_path_lookup")
def json_path_lookup(spark, sf):
    """Nested-JSON path lookup on the events' props column, then a profile of it."""
    ev = FX.read_table(spark, sf, "events").select("event_type", IO.json_path("props", "$.k", "int").alias("k"))
    return _round_doubles(ev.groupBy("event_type").agg(F.count("k").alias("n"), F.avg("k").alias("mean_k"),
                                                       F.max("k").alias("max_k")))


ORACLE["json_path_lookup"] = (
    f"SELECT event_type, count(k) AS n, {sql_r6('avg(k)')} AS mean_k, max(k) AS max_k FROM "
    "(SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) t GROUP BY event_type")
