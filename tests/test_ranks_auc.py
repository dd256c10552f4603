"""Ranks and AUC: scale form == plain form, and AUC properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tables import SF_MID
from foldwise.operators import auc as A
from foldwise.operators import ranks as R
from foldwise.sources import fixtures as FX


def _brute_auc(score, y):
    s, y = np.asarray(score, float), np.asarray(y, int)
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def skewed(spark):
    # a hot score value holding a third of the rows, plus ties elsewhere
    ev = FX.obs_events(spark, SF_MID)
    return ev.select("id", "y", "c1", F.when(F.col("id") % 3 == 0, F.lit(50.0)).otherwise(F.col("s_c")).alias("s"))


@pytest.mark.parametrize("keys", [[], ["c1"]])
@pytest.mark.parametrize("buckets", [None, 8, 64])
def test_bucketed_rank_equals_pandas(spark, skewed, keys, buckets):
    got = R.average_rank(skewed, "s", keys, out="r", buckets=buckets).select("id", "r").toPandas()
    pdf = skewed.toPandas()
    if keys:
        pdf["r"] = pdf.groupby(keys, dropna=False)["s"].rank(method="average")
    else:
        pdf["r"] = pdf["s"].rank(method="average")
    m = got.merge(pdf[["id", "r"]], on="id", suffixes=("", "_pd"))
    assert len(m) == len(pdf)
    assert np.allclose(m["r"], m["r_pd"])


def test_rank_sum_identity(spark, skewed):
    out = R.average_rank(skewed, "s", [], out="r", buckets=16)
    n, total = out.agg(F.count("r"), F.sum("r")).collect()[0]
    assert total == pytest.approx(n * (n + 1) / 2)


@pytest.mark.parametrize("buckets", [None, 16])
def test_auc_equals_brute_force(spark, skewed, buckets):
    got = {r.c1: r.auc for r in A.auc(skewed, "s", keys=["c1"], buckets=buckets).collect()}
    pdf = skewed.toPandas()
    for c, g in pdf.groupby("c1", dropna=False):
        key = None if (c is None or (isinstance(c, float) and np.isnan(c))) else c
        assert got[key] == pytest.approx(_brute_auc(g["s"], g["y"]), abs=1e-12)


def test_auc_properties(spark):
    ev = FX.obs_events(spark, SF_MID).select("y", "value", (-F.col("value")).alias("neg"),
                                              F.exp(F.col("value") / 100).alias("mono"), F.lit(1.0).alias("const"))
    res = {r.feature: r.auc for r in A.auc_panel(ev, ["value", "neg", "mono", "const"]).collect()}
    assert res["mono"] == pytest.approx(res["value"], abs=1e-12)
    assert res["neg"] == pytest.approx(1 - res["value"], abs=1e-12)
    assert res["const"] == pytest.approx(0.5)


def test_single_class_group_is_null(spark):
    df = spark.createDataFrame([(1, 0.1, "a"), (1, 0.2, "a"), (0, 0.3, "b"), (1, 0.4, "b")], "y int, s double, g string")
    res = {r.g: r.auc for r in A.auc(df, "s", keys=["g"]).collect()}
    assert res["a"] is None and res["b"] == pytest.approx(1.0)


def test_rank_average_exact_ties(spark):
    p = spark.createDataFrame([(i, m, float(s)) for i, (a, b) in enumerate([(1, 2), (2, 1), (3, 3)])
                               for m, s in (("a", a), ("b", b))], "id int, model string, score double")
    out = {r.id: r.score for r in R.rank_average(p, "id", []).collect()}
    assert out[0] == out[1]  # (1/3 + 2/3)/2 on both rows: an exact tie


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_the_number_of_ranges_does_not_change_ranks(spark, skewed, buckets):
    one = R.average_rank(skewed, "s", ["c1"], out="r").select("id", "r")
    other = R.average_rank(skewed, "s", ["c1"], out="r2", buckets=buckets).select("id", "r2")
    j = one.join(other, "id")
    assert j.count() == skewed.count()
    assert j.where(~F.col("r").eqNullSafe(F.col("r2"))).count() == 0


def test_mixed_group_sizes(spark):
    """One big group is cut over several ranges, small groups share one; ranks and AUC equal
    pandas / brute force."""
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") < 4000, "big").when(F.col("id") < 5000, "small1").otherwise("small2").alias("g"),
        F.when(F.col("id") < 4000, (F.col("id") * 7 % 3001).cast("double"))
         .when(F.col("id") < 5000, (F.col("id") % 50).cast("double")).otherwise(F.lit(3.0)).alias("s"),
        (F.col("id") * 7919 % 5 < 2).cast("int").alias("y"))
    got = R.average_rank(df, "s", ["g"], out="r", buckets=16).select("id", "r").toPandas()
    pdf = df.toPandas()
    pdf["exp"] = pdf.groupby("g")["s"].rank(method="average")
    m = got.merge(pdf, on="id")
    assert np.allclose(m["r"], m["exp"])
    res = {r.g: r.auc for r in A.auc(df, "s", keys=["g"], buckets=16).collect()}
    for g, part in pdf.groupby("g"):
        assert res[g] == pytest.approx(_brute_auc(part["s"], part["y"]), abs=1e-12)
    tb = R.range_buckets(R.tie_table(df, ["g"], "s"), ["g"], "s", 16)
    nb = {r.g: r.nb for r in tb.groupBy("g").agg(F.countDistinct("_bkt").alias("nb")).collect()}
    assert nb["big"] > 8 and nb["small1"] <= 2 and nb["small2"] == 1


def test_scores_keep_their_type(spark):
    """Integers that are one double, and decimals wider than one, have ranks of their own."""
    for kind, base in (("bigint", 2 ** 53), ("decimal(30,0)", 10 ** 25)):
        df = spark.createDataFrame([(i, str(base + i)) for i in range(4)], "id int, t string").select("id", F.col("t").cast(kind).alias("s"))
        for buckets in (None, 4):
            got = {r.id: r.r for r in R.average_rank(df, "s", out="r", buckets=buckets).collect()}
            assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}


def test_rows_without_a_label_or_score_take_no_part(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (None, 0.95), (None, 0.05), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    r = A.auc(df, "s").first()
    assert (r.auc, r.n_pos, r.n_neg) == (0.75, 2, 2)
    assert A.log_loss_by(df, "s", None).first().n == 4


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_ties_across_borders_nulls_and_equal_rows(spark, buckets):
    """A hot score over many ranges, signed zeros, NaN, NULL scores and keys, equal rows."""
    rng = np.random.default_rng(3)
    scores = np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 12, 3000).astype(float))
    rows = [(["a", "b", None][i % 3], None if i % 17 == 0 else float(s)) for i, s in enumerate(scores)]
    rows += [("a", -0.0)] * 5 + [("z", None)] * 3 + [("y", float("nan"))] * 2 + [("y", 1.0)]
    df = spark.createDataFrame(rows, "g string, s double").repartition(5)
    got = R.average_rank(df, "s", ["g"], out="r", pct="p", n_out="n", buckets=buckets).toPandas()
    assert len(got) == len(rows)
    pdf = pd.DataFrame(rows, columns=["g", "s"])
    order = pdf["s"].where(~((pdf["g"] == "y") & pdf["s"].isna()), np.inf)  # NaN ranks last, NULL does not rank
    pdf["r"] = order.groupby(pdf["g"], dropna=False).rank(method="average")
    pdf["n"] = order.groupby(pdf["g"], dropna=False).transform("count")
    key = lambda d: sorted((str(g), str(round(s + 0.0, 6)) if s == s else "-", -1.0 if r != r else r)
                           for g, s, r in zip(d["g"], d["s"], d["r"]))
    assert key(got) == key(pdf)
    ranked = got[got["r"].notna()]
    assert np.allclose(ranked["p"], ranked["r"] / ranked["n"])
    assert dict(zip(ranked["g"].astype(str), ranked["n"])) == {str(g): n for g, n in zip(pdf["g"], pdf["n"]) if n}


def test_rank_plan_has_no_join_of_the_rows(spark, skewed):
    plan = R.average_rank(skewed, "s", ["c1"], out="r")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_a_pivot_by_id_has_tasks_of_bounded_rows(spark, monkeypatch):
    from foldwise import session
    from foldwise.operators import blend as BL

    rows = [(i, m, float(i) + j) for i in range(3000) for j, m in enumerate("ab")]
    df = spark.createDataFrame(rows, "id int, model string, score double")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    out = BL.pivot_models(df, ["a", "b"])
    got = {r.id: (r.a, r.b) for r in out.collect()}
    assert got == {i: (float(i), i + 1.0) for i in range(3000)}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 300
