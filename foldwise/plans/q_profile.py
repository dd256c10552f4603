"""Catalog step 2: grouped profiles (A1-A13) and right-closed binning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.operators import binning as B
from foldwise.operators import features as FE
from foldwise.operators import profile as P
from foldwise.plans.common import O_NUM, r6, sql_qcut, sql_r6, sql_safe_corr
from foldwise.plans.q_features import EVENT_TYPES
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


def ev(sql):
    return FX.with_views(sql, "obs_events")


@q("target_rate")
def target_rate(spark, sf):
    return _round_doubles(P.target_rate(FX.obs_events(spark, sf), "c1"))


ORACLE["target_rate"] = ev(
    f"SELECT c1, {sql_r6('avg(y)')} AS rate, count(y) AS n FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1")


@q("target_rate_2key")
def target_rate_2key(spark, sf):
    return _round_doubles(P.target_rate(FX.obs_events(spark, sf), ["c1", "c2"]))


ORACLE["target_rate_2key"] = ev(
    f"SELECT c1, c2, {sql_r6('avg(y)')} AS rate, count(y) AS n FROM obs_events "
    "WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY c1, c2")


@q("grouped_mean")
def grouped_mean(spark, sf):
    return _round_doubles(P.grouped_mean(FX.obs_events(spark, sf), "c2", "x1"))


ORACLE["grouped_mean"] = ev(
    f"SELECT c2, {sql_r6('avg(x1)')} AS mean, count(x1) AS n FROM obs_events WHERE c2 IS NOT NULL GROUP BY c2")


@q("grouping_sets_profile")
def grouping_sets_profile(spark, sf):
    return _round_doubles(P.multi_key_profile(FX.obs_events(spark, sf), ["c1", "c2", "x3"], "value"))


ORACLE["grouping_sets_profile"] = ev(" UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, {sql_r6('avg(value)')} AS mean, "
    f"count(value) AS n FROM obs_events WHERE {k} IS NOT NULL GROUP BY {k}" for k in ["c1", "c2", "x3"]))


@q("masked_rate")
def masked_rate(spark, sf):
    df = FX.obs_events(spark, sf)
    complete = F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull()
    return _round_doubles(P.masked_rate(df, "c1", complete))


ORACLE["masked_rate"] = ev(
    f"SELECT c1, {sql_r6('avg(y)')} AS all_mean, count(y) AS all_n, "
    f"{sql_r6('avg(y) FILTER (WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)')} AS masked_mean, "
    "count(y) FILTER (WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL) AS masked_n "
    "FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1")


@q("hi_lo_diff")
def hi_lo_diff(spark, sf):
    df = FX.obs_events(spark, sf).withColumn("h", F.coalesce(F.col("x3") % 2 == 0, F.lit(False)).cast("int"))
    return _round_doubles(P.hi_lo_diff(df, "c2", "h"))


ORACLE["hi_lo_diff"] = ev(
    "SELECT c2, " + sql_r6("avg(CASE WHEN h = 1 THEN y END)") + " AS hi_mean, "
    + sql_r6("avg(CASE WHEN h = 0 THEN y END)") + " AS lo_mean, "
    + sql_r6("avg(CASE WHEN h = 1 THEN y END) - avg(CASE WHEN h = 0 THEN y END)") + " AS diff "
    "FROM (SELECT *, CAST(COALESCE(x3 % 2 = 0, false) AS INTEGER) AS h FROM obs_events) t "
    "WHERE c2 IS NOT NULL GROUP BY c2")


@q("pivot_rate")
def pivot_rate(spark, sf):
    df = FX.obs_events(spark, sf)
    return _round_doubles(P.pivot_mean(df, "c2", "c1", FE.fitted_levels(df, "c1"), "y"))  # a new type is a new column


ORACLE["pivot_rate"] = ev(
    "SELECT c2, " + ", ".join(f"{sql_r6(f'avg(CASE WHEN c1 = {chr(39)}{v}{chr(39)} THEN y END)')} AS {v}"
                              for v in EVENT_TYPES)
    + " FROM obs_events WHERE c2 IS NOT NULL GROUP BY c2")


@q("freq_dist")
def freq_dist(spark, sf):
    return _round_doubles(P.freq_dist(FX.obs_events(spark, sf), "c2"))


ORACLE["freq_dist"] = ev(
    "SELECT c2, count(*) AS n, " + sql_r6("count(*) / (SELECT count(c2) FROM obs_events)") + " AS freq "
    "FROM obs_events WHERE c2 IS NOT NULL GROUP BY c2")

SUMMARY_COLS = ["value", "x1", "x2", "x3"]


@q("summary")
def summary(spark, sf):
    return _round_doubles(P.summary(FX.obs_events(spark, sf), SUMMARY_COLS))


ORACLE["summary"] = ev(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, {sql_r6(f'avg({c})')} AS mean, "
    f"{sql_r6(f'stddev_samp({c})')} AS std, {sql_r6(f'min({c})')} AS min, "
    f"{sql_r6(f'quantile_cont({c}, 0.25)')} AS p25, {sql_r6(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{sql_r6(f'quantile_cont({c}, 0.75)')} AS p75, {sql_r6(f'max({c})')} AS max FROM obs_events"
    for c in SUMMARY_COLS))

CORR_COLS = ["value", "x1", "x2", "x3", "s_a", "y"]
CORR_PAIRS = [(CORR_COLS[i], CORR_COLS[j]) for i in range(len(CORR_COLS)) for j in range(i + 1, len(CORR_COLS))]


@q("corr_panel")
def corr_panel(spark, sf):
    return _round_doubles(P.corr_panel(FX.obs_events(spark, sf), CORR_PAIRS))


ORACLE["corr_panel"] = ev(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {sql_r6(f'corr({a}, {b})')} AS r, "
    f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM obs_events"
    for a, b in CORR_PAIRS))


@q("corr_matrix")
def corr_matrix(spark, sf):
    """Every pair of 44 columns of the orders view, from one scan."""
    df = FX.obs_orders(spark, sf).select("y", *[F.expr(e).alias(n) for n, e in MATRIX_SQL])
    cols = df.columns
    return _round_doubles(P.corr_panel(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]))


#: The eight numeric columns, and shifted, capped and missing variants of them: 43 columns.
MATRIX_SQL = [(c, f"CAST({c} AS DOUBLE)") for c in O_NUM]
MATRIX_SQL += [(f"{c}_if_{k}", f"CASE WHEN id % {k} <> 0 THEN CAST({c} AS DOUBLE) END") for c in O_NUM for k in (3, 5)]
MATRIX_SQL += [(f"{c}_root", f"sqrt(CAST({c} AS DOUBLE))") for c in O_NUM]
MATRIX_SQL += [(f"{c}_cap", f"least(CAST({c} AS DOUBLE), 40.0)") for c in O_NUM]
MATRIX_SQL += [("id_7", "CAST(id % 7 AS DOUBLE)"), ("id_11", "CAST(id % 11 AS DOUBLE)"), ("constant", "CAST(1.0 AS DOUBLE)")]


def _matrix_sql():
    cols = ["y", *[n for n, _ in MATRIX_SQL]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rs = ", ".join(sql_r6(sql_safe_corr(a, b)) for a, b in pairs)
    ns = ", ".join(f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)" for a, b in pairs)
    left, right = (", ".join(f"'{q[j]}'" for q in pairs) for j in (0, 1))
    src = "SELECT CAST(y AS DOUBLE) AS y, " + ", ".join(f"{e} AS {n}" for n, e in MATRIX_SQL) + " FROM obs_orders"
    return FX.with_views(f"SELECT unnest([{left}]) AS a, unnest([{right}]) AS b, unnest(r) AS r, unnest(n) AS n FROM "
                         f"(SELECT [{rs}] AS r, [{ns}] AS n FROM _m) z", "obs_orders", extra=[("_m", src)])


ORACLE["corr_matrix"] = _matrix_sql()


@q("corr_by_group")
def corr_by_group(spark, sf):
    return _round_doubles(P.corr_by_group(FX.obs_events(spark, sf), "c1", "x1", "y"))


ORACLE["corr_by_group"] = ev(
    f"SELECT c1, {sql_r6('corr(x1, y)')} AS r, count(CASE WHEN x1 IS NOT NULL AND y IS NOT NULL THEN 1 END) AS n "
    "FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1")


@q("distinct_counts")
def distinct_counts(spark, sf):
    df = FX.obs_events(spark, sf)
    return P.distinct_counts(df, {"x3_distinct": F.col("x3"), "value_2dp_distinct": F.round("value", 2),
                                  "c1_distinct": F.col("c1")})


ORACLE["distinct_counts"] = ev(
    "SELECT count(DISTINCT x3) AS x3_distinct, count(DISTINCT round(value, 2)) AS value_2dp_distinct, "
    "count(DISTINCT c1) AS c1_distinct FROM obs_events")


@q("distinct_sketch")
def distinct_sketch(spark, sf):
    """Sketches of each split, merged: within 5 % of the exact count."""
    df = FX.obs_events(spark, sf)
    exprs = {"x2": F.col("x2"), "value_2dp": F.round("value", 2), "c1": F.col("c1"), "id": F.col("id")}
    stored = P.distinct_sketches(df, exprs, ["split"])
    near = P.merged_distinct(stored).withColumnRenamed("n_distinct", "estimate")
    out = P.distinct_rows(df, exprs).join(near, "name")
    return out.select("name", "n_distinct", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct")).alias("near"))


ORACLE["distinct_sketch"] = ev(" UNION ALL ".join(
    f"SELECT '{n}' AS name, count(DISTINCT {e}) AS n_distinct, true AS near FROM obs_events"
    for n, e in (("x2", "x2"), ("value_2dp", "round(value, 2)"), ("c1", "c1"), ("id", "id"))))


@q("sorted_rates")
def sorted_rates(spark, sf):
    """Group output in key order, NULL keys dropped; the position is part of the result."""
    g = P.target_rate(FX.obs_events(spark, sf), ["c1", "c2"]).orderBy("c1", "c2")
    # a sort of the grouped rows; positions follow it
    rows = g.withColumn("_at", F.monotonically_increasing_id())
    return _round_doubles(rows.select("c1", "c2", "rate", "n", F.row_number().over(Window.partitionBy("c1").orderBy("_at")).alias("place")))


ORACLE["sorted_rates"] = ev(
    f"SELECT c1, c2, {sql_r6('avg(y)')} AS rate, count(y) AS n, CAST(row_number() OVER (PARTITION BY c1 ORDER BY c2) AS INTEGER) AS place "
    "FROM obs_events WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY c1, c2")


@q("qcut_rate")
def qcut_rate(spark, sf):
    df = B.qcut(FX.obs_events(spark, sf), "x1", 10, out="bin")
    return _round_doubles(B.binned_rate(df, "bin"))


def _qcut_rate_sql():
    cte, expr = sql_qcut("x1", 10, "obs_events")
    return FX.with_views(f"SELECT bin, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM "
                         f"(SELECT y, CAST({expr} AS INTEGER) AS bin FROM obs_events) t WHERE bin IS NOT NULL "
                         "GROUP BY bin", "obs_events", extra=[cte])


ORACLE["qcut_rate"] = _qcut_rate_sql()


@q("qcut_subset")
def qcut_subset(spark, sf):
    """Bins recomputed inside a filtered subset."""
    mid = FX.obs_events(spark, sf).where((F.col("value") > 100) & (F.col("value") <= 300))
    df = B.qcut(mid, "s_c", 5, out="bin")
    return _round_doubles(B.binned_rate(df, "bin"))


def _qcut_subset_sql():
    cte, expr = sql_qcut("s_c", 5, "mid")
    return FX.with_views(f"SELECT bin, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM "
                         f"(SELECT y, CAST({expr} AS INTEGER) AS bin FROM mid) t WHERE bin IS NOT NULL GROUP BY bin",
                         "obs_events",
                         extra=[("mid", "SELECT * FROM obs_events WHERE value > 100 AND value <= 300"), cte])


ORACLE["qcut_subset"] = _qcut_subset_sql()


@q("cut_width")
def cut_width(spark, sf):
    df = B.cut_width(FX.obs_events(spark, sf), "value", 10, out="bin")
    return _round_doubles(B.binned_rate(df, "bin"))


ORACLE["cut_width"] = FX.with_views(
    f"SELECT bin, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM (SELECT y, "
    "CAST(greatest(ceil((value - (SELECT lo FROM _m)) / NULLIF(((SELECT hi FROM _m) - (SELECT lo FROM _m)) / 10.0, 0))"
    " - 1, 0) AS BIGINT) AS bin FROM obs_events) t WHERE bin IS NOT NULL GROUP BY bin", "obs_events",
    extra=[("_m", "SELECT CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM obs_events")])

EDGES = [0.0, 50.0, 100.0, 200.0, 300.0, 400.0]


@q("cut_edges")
def cut_edges(spark, sf):
    df = B.cut_edges(FX.obs_events(spark, sf), "value", EDGES, out="bin")
    return _round_doubles(B.binned_rate(df, "bin"))


def _case_edges(x, edges):
    return "CASE " + " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN {i}"
                              for i in range(len(edges) - 1)) + " END"


ORACLE["cut_edges"] = ev(
    f"SELECT bin, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM (SELECT y, {_case_edges('value', EDGES)} AS bin "
    "FROM obs_events) t WHERE bin IS NOT NULL GROUP BY bin")

CP_EDGES = [0.0, 100.0, 250.0, 500.0]


@q("conditional_profile")
def conditional_profile(spark, sf):
    out = B.conditional_profile(FX.obs_events(spark, sf), "value", CP_EDGES, "s_b", 4)
    return _round_doubles(out)


def _cp_sql():
    cte, expr = sql_qcut("s_b", 4, "obs_events")
    return FX.with_views(
        f"SELECT value_bin, s_b_q, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM "
        f"(SELECT y, {_case_edges('value', CP_EDGES)} AS value_bin, CAST({expr} AS INTEGER) AS s_b_q "
        "FROM obs_events) t WHERE value_bin IS NOT NULL AND s_b_q IS NOT NULL GROUP BY value_bin, s_b_q",
        "obs_events", extra=[cte])


ORACLE["conditional_profile"] = _cp_sql()


@q("conditional_profile_per_bin")
def conditional_profile_per_bin(spark, sf):
    out = B.conditional_profile(FX.obs_events(spark, sf), "value", CP_EDGES, "s_b", 4, per_bin=True)
    return _round_doubles(out)


def _cp_per_bin_sql():
    q = 4
    fr = ", ".join(str(i / q) for i in range(q + 1))
    terms = " + ".join(
        f"CASE WHEN e.q[{i + 1}] > e.q[{i}] AND e.q[{i + 1}] < e.q[{q + 1}] AND s_b > e.q[{i + 1}] THEN 1 ELSE 0 END"
        for i in range(1, q))
    return ev(f", b AS (SELECT *, {_case_edges('value', CP_EDGES)} AS value_bin FROM obs_events), "
              f"e AS (SELECT value_bin, quantile_cont(s_b, [{fr}]) AS q FROM b WHERE value_bin IS NOT NULL "
              "GROUP BY value_bin) "
              f"SELECT value_bin, s_b_q, count(y) AS n, {sql_r6('avg(y)')} AS rate FROM "
              f"(SELECT b.y, b.value_bin, CAST(CASE WHEN s_b IS NULL OR e.q[1] = e.q[{q + 1}] THEN NULL ELSE {terms} END AS INTEGER) AS s_b_q "
              "FROM b JOIN e ON b.value_bin = e.value_bin) t WHERE s_b_q IS NOT NULL GROUP BY value_bin, s_b_q"
              ).replace("\n, b AS", ",\nb AS")


ORACLE["conditional_profile_per_bin"] = _cp_per_bin_sql()
