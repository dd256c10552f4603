"""Right-closed binning against pandas; constraints; drift; blends."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tables import SF_MID
from foldwise.operators import auc as A
from foldwise.operators import binning as B
from foldwise.operators import blend as BL
from foldwise.operators import constraints as K
from foldwise.operators import drift as D
from foldwise.sources import fixtures as FX


@pytest.fixture(scope="module")
def ev(spark):
    return FX.obs_events(spark, SF_MID).cache()


def test_qcut_equals_pandas(ev):
    got = B.qcut(ev, "x1", 10, out="b").select("id", "x1", "b").toPandas().sort_values("id")
    exp = pd.qcut(got["x1"], 10, labels=False, duplicates="drop")
    assert np.array_equal(got["b"].fillna(-1).values, exp.fillna(-1).values)


def test_qcut_with_duplicate_edges(ev):
    got = B.qcut(ev, "x3", 10, out="b").select("x3", "b").toPandas()
    exp = pd.qcut(got["x3"], 10, labels=False, duplicates="drop")
    assert np.array_equal(got["b"].fillna(-1).values, exp.fillna(-1).values)


def test_cut_width_and_edges_equal_pandas(ev):
    got = B.cut_width(ev, "value", 10, out="b").select("value", "b").toPandas()
    exp = pd.cut(got["value"], 10, labels=False)
    assert np.array_equal(got["b"].values, exp.values)
    edges = [0.0, 50.0, 100.0, 200.0, 300.0, 400.0]
    got = B.cut_edges(ev, "value", edges, out="b").select("value", "b").toPandas()
    exp = pd.cut(got["value"], edges, labels=False)
    assert np.array_equal(got["b"].fillna(-1).values, exp.fillna(-1).values)


def test_constraint_identity(spark):
    o = FX.obs_orders(spark, SF_MID)
    res = K.check_constraints(o, K.pair_candidates(["qty_total", "qty_a", "price_max", "price_min"])).toPandas()
    for _, r in res.iterrows():
        assert (r["violations"] == 0) == (r["min_resid"] >= -1e-6)
    hits = set(K.search(o, K.sum_candidates(["qty_total", "qty_a", "qty_n", "qty_r"], 3), 100).toPandas()["name"])
    assert "qty_total >= qty_a + qty_n + qty_r" in hits


def test_ks_matches_numpy(ev):
    got = {r.feature: r.ks for r in D.ks_drift(ev, ["value", "x3"]).collect()}
    got_b = {r.feature: r.ks for r in D.ks_drift(ev, ["value", "x3"], buckets=16).collect()}
    pdf = ev.select("value", "x3", "split").toPandas()
    for c in ["value", "x3"]:
        a = np.sort(pdf.loc[pdf.split == "train", c].dropna().values)
        b = np.sort(pdf.loc[pdf.split == "test", c].dropna().values)
        grid = np.union1d(a, b)
        d = np.max(np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)))
        assert got[c] == pytest.approx(d) and got_b[c] == pytest.approx(d)


def test_blend_at_one_zero_is_the_single_model(spark, ev):
    wide = ev.where(F.col("split") == "train").select("id", "y", F.col("s_a").alias("m_a"), F.col("s_b").alias("m_b"))
    sweep = {r.w_id: r.auc for r in BL.blend_sweep(wide, ["m_a", "m_b"], BL.ratio_weights()).collect()}
    single = A.auc(wide, "m_a").first().auc
    assert sweep[0] == pytest.approx(single, abs=1e-12)


def test_simplex_grid():
    g = BL.simplex_grid(3, 10)
    assert len(g) == 66 and all(abs(sum(w) - 1) < 1e-12 for w in g)


@pytest.mark.parametrize("col", ["x1", "x3", "value"])
def test_rank_selection_quantiles_equal_percentile(spark, ev, col):
    fr = [i / 10 for i in range(11)]
    exact = ev.agg(F.percentile(col, F.array(*[F.lit(f) for f in fr]))).first()[0]
    got = B.quantiles(ev, col, fr).first()["q"]
    assert np.allclose(got, exact, rtol=0, atol=1e-9)


def test_keyed_quantiles_equal_percentile_by_group(spark, ev):
    fr = [0.0, 0.25, 0.5, 0.9, 1.0]
    exact = {r.c1: r.q for r in ev.groupBy("c1").agg(F.percentile("x1", F.array(*[F.lit(f) for f in fr])).alias("q")).collect()}
    got = {r.c1: r.q for r in B.quantiles(ev, "x1", fr, ["c1"]).collect()}
    assert got.keys() == exact.keys()
    assert all(np.allclose(got[k], exact[k], rtol=0, atol=1e-9) for k in got)


def test_null_and_constant_columns_have_no_equal_width_bin(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (10.0, 5.0), (4.0, None)], "x double, c double")
    assert [r.x_w4 for r in B.cut_width(df, "x", 4).collect()] == [0, None, 3, 1]
    assert {r.c_w4 for r in B.cut_width(df, "c", 4).collect()} == {None}



def test_missing_drift_with_an_empty_split(spark):
    df = spark.createDataFrame([(1.0, "train"), (None, "train")], "x double, split string")
    r = D.missing_drift(df, ["x"]).first()
    assert r.rate_a == pytest.approx(0.5) and r.rate_b is None and r.z is None


def test_targets_of_hits_alone(spark, monkeypatch):
    """Hits and their target correlations are those of all candidates, candidates given twice come twice."""
    rows = [(float(i % 7 + i % 5 + i % 3), float(i % 7), float(i % 5) if i % 11 else None, float(i % 3), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "t double, a double, b double, c double, y int")
    cands = K.sum_candidates(["t", "a", "b", "c"], 2)
    cands += [cands[0], K.Constraint("t", ("a", "b", "c")), K.Constraint("a", ("a",))]
    every = K.check_constraints(df, cands, y="y")
    calls, check = [], K.check_constraints
    monkeypatch.setattr(K, "check_constraints", lambda df, cands, eps, y=None: calls.append((len(cands), y)) or check(df, cands, eps, y))
    found = K.search(df, cands, 10, y="y")
    want = sorted((r.name, r.support, r.r_target) for r in every.collect() if r.violations == 0 and r.support > 10)
    assert len(every.collect()) == len(cands)
    got = [(r.name, r.support, r.r_target) for r in found.collect()]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in want] and len(got) >= 4
    assert all(g[2] == pytest.approx(w[2], abs=1e-9) for g, w in zip(sorted(got), want))
    assert K.search(df, cands[:1], 10 ** 6, y="y").count() == 0
    assert calls[0] == (len(cands), None) and calls[1] == (len({g[0] for g in got}), "y")
