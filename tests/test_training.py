"""Newton logistic fits, fold stores, isotonic regression and blend bounds against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import blend as BL
from foldwise.operators import forest as RF
from foldwise.operators import isotonic as ISO
from foldwise.operators import logistic as LG
from foldwise.operators import models as M


def rows_of(n, d, seed, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 10.0 ** np.arange(d) + 5
    x[:, -1] = 3.0  # a constant feature
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 5)))).astype(float)
    return [([float(v) for v in r], None if missing and i % 11 == 0 else float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))]


def as_table(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("y", T.DoubleType()),
                                                     T.StructField("fold", T.IntegerType())]))


def loss_of(rows, fit, w, b):
    """The penalised objective, plainly, on features as they are; the penalty on standardised weights."""
    own = [(x, y) for x, y, k in rows if y is not None and k != fit.left_out]
    cols = list(fit.columns) if fit.columns is not None else range(len(own[0][0]))
    x = np.array([[r[c] for c in cols] for r, _ in own])
    y = np.array([t for _, t in own])
    sd = x.std(0)
    sd = np.where(sd > 0, sd, 1.0) if fit.standardise else np.ones(len(cols))
    z = x @ w + b
    return fit.c * float((np.logaddexp(0, z) - y * z).sum()) + 0.5 * float(((w * sd) ** 2).sum())


def test_fits_are_optimal_and_independent(spark):
    rows = rows_of(600, 4, 1)
    t = as_table(spark, rows).repartition(5)
    fits = [LG.Fit(k, c, cols, std) for k, c, cols, std in
            [(0, 0.1, None, True), (1, 100.0, None, True), (None, 1.0, (0, 2), True), (3, 1.0, (1, 0), False), (2, 1e-4, None, True), (2, 1e4, (0,), True)]]
    models = LG.fit_logistic(t, fits, "f")
    cert = LG.certificate(t, models, list("abcd"), "f").collect()
    assert max(abs(r.gradient) for r in cert) < 1e-8
    assert len(cert) == sum(len(m.columns) + 1 for m in models)
    rng = np.random.default_rng(0)
    for m in models:
        w, b = m.coefficients
        best = loss_of(rows, m.fit, w, b)
        for size in (1e-3, 1e-1):
            for _ in range(10):
                assert loss_of(rows, m.fit, w + rng.normal(size=len(w)) * size / m.scales, b + rng.normal() * size) > best
        assert m.n == sum(y is not None and k != m.fit.left_out for _, y, k in rows)
    alone = LG.fit_logistic(t, [fits[1]], "f")[0]
    assert np.allclose(alone.weights, models[1].weights, atol=1e-9)


def test_separable_one_class_and_empty(spark):
    rows = [([float(i), 1.0], float(i >= 20), 0) for i in range(40)]
    (m,) = LG.fit_logistic(as_table(spark, rows), [LG.Fit(None, 1000.0)], "f", fold=None)
    w, b = m.coefficients
    assert all((w[0] * x[0] + w[1] * x[1] + b > 0) == (y == 1) for x, y, _ in rows) and np.abs(m.gradient).max() < 1e-8
    one = as_table(spark, [([1.0], 1.0, 0), ([2.0], 1.0, 1)])
    (m,) = LG.fit_logistic(one, [LG.Fit(0)], "f")
    assert m.weights[0] == 0 and m.weights[-1] == pytest.approx(math.log((1 - 1e-6) / 1e-6))
    (m,) = LG.fit_logistic(as_table(spark, []), [LG.Fit(0)], "f")
    assert m.n == 0 and m.weights.tolist() == [0.0]


def test_scores_by_fold_and_mean(spark):
    rows = rows_of(200, 3, 2, missing=False)
    t = as_table(spark, rows).withColumn("id", F.monotonically_increasing_id())
    models = LG.fit_logistic(t, [LG.Fit(k) for k in range(4)], "f")
    features = dict.fromkeys(range(4), "f")
    own = LG.score_logistic(t, [models], features, ["id", "fold", "f"], "fold").collect()
    every = {r.id: r.scores[0] for r in LG.score_logistic(t, [models], features, ["id"]).collect()}

    def p(m, x):
        w, b = m.coefficients
        return 1 / (1 + math.exp(-(np.array(x)[m.columns] @ w + b)))
    assert len(own) == 200
    for r in own:
        assert r.scores[0] == pytest.approx(p(models[r.fold], r.f), abs=1e-12)
        assert every[r.id] == pytest.approx(np.mean([p(m, r.f) for m in models]), abs=1e-12)


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]), rng.gauss(2, 3), rng.choice("abcde"), int(rng.random() < 0.4), i % 3) for i in range(400)]
    return spark.createDataFrame(rows, "id int, x double, z double, c string, y int, fold int").withColumn("flag", F.col("x").isNull().cast("int"))


def test_a_store_serves_every_candidate_alike(spark, wide):
    """Runs on slices of one store equal runs on stores of their own."""
    groups = {"z": ["z"], "c": ["c"], "flag": ["flag"]}
    got = {r.group: r.auc for r in M.ablation(wide, groups, ["x", "z"], ["c"], ["flag"], "lr").collect()}
    for g, cols in groups.items():
        p = M.cv_train(wide, [c for c in ("x", "z") if c not in cols], [c for c in ("c",) if c not in cols],
                       [c for c in ("flag",) if c not in cols], "lr")
        _, overall = M.oof_auc(p, wide)
        assert got[g] == pytest.approx(overall.first().auc, abs=1e-12)
    scan = M.tune_scan(wide, {"a": {"C": 0.01}, "b": {"C": 10.0}}, ["x", "z"], ["c"], ["flag"], "lr")
    assert [r.auc for r in scan.collect()] == sorted((r.auc for r in scan.collect()), reverse=True)
    trees = M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], "rf")
    one = M.cv_train(None, ["z"], ["c"], [], "rf", {"numTrees": 3, "maxDepth": 3}, store=trees, seed=1)
    assert one.count() == 400 and one.where("score < 0 OR score > 1").count() == 0


def plain_isotonic(points, x):
    """Min-max formula at the points (x, s, n), linear between, constant beyond."""
    points = sorted(points)
    def mean(a, b):
        return sum(p[1] for p in points[a:b + 1]) / sum(p[2] for p in points[a:b + 1])
    g = [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    return float(np.interp(x, [p[0] for p in points], g)) if points else None


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_isotonic_equals_min_max(spark, buckets):
    rng = random.Random(buckets)
    rows = [("a" if i % 3 else None, i, rng.choice([round(rng.gauss(0, 2), 1), 0.5, -0.0, 0.0]), int(rng.random() < 0.3 + 0.1 * (i % 5)), i % 3) for i in range(240)]
    rows += [("a", 900, None, 1, 0), ("a", 901, float("nan"), 1, 0), ("a", 902, 1.0, None, 1), ("lone", 903, 1.0, 1, 2)]
    df = spark.createDataFrame(rows, "g string, id int, score double, y int, fold int")
    got = ISO.isotonic_oof(df, by=["g"], buckets=buckets).collect()
    assert len(got) == len(rows)
    for r in got:
        points = {}
        for g, _, s, y, k in rows:
            if g == r.g and k != r.fold and s is not None and s == s and y is not None:
                a = points.setdefault(s + 0.0, [0, 0])
                a[0] += y
                a[1] += 1
        seen = r.score is not None and r.score == r.score and (r.y is not None or any(
            q[0] == r.g and q[4] == r.fold and q[2] == r.score and q[3] is not None for q in rows))
        want = plain_isotonic([(x, s, n) for x, (s, n) in points.items()], r.score) if seen else None
        assert (r.calibrated is None) == (want is None)
        if want is not None:
            assert r.calibrated == pytest.approx(want, abs=1e-12)


def test_pool_any_order():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(0, 30)
        pts = [(float(i), float(i), rng.randint(0, 3), rng.randint(3, 4)) for i in range(n)]
        whole = ISO.pool(*map(list, zip(*pts))) if pts else ([], [], [], [])
        cut = rng.randint(0, n)
        parts = [ISO.pool(*map(list, zip(*p))) if p else ([], [], [], []) for p in (pts[:cut], pts[cut:])]
        assert ISO.pool(*[a + b for a, b in zip(*parts)]) == whole


@pytest.mark.parametrize("bins", [1, 8, 1024])
@pytest.mark.parametrize("hot", [2, 100_000])
def test_blends_are_exact_and_bounded(spark, bins, hot, monkeypatch):
    """Any number of bins, hot bins through ranges, ties, NULL scores, several groups."""
    monkeypatch.setattr(BL, "HOT_BIN", hot)
    rng = random.Random(bins)
    rows = [(g, rng.choice([0.5, rng.gauss(0, 1)]), rng.choice([None, 1.0, rng.gauss(0, 1), 1e6 if rng.random() < 0.05 else 0.0]), int(rng.random() < 0.4))
            for g in (1, 2) for _ in range(150)]
    rows += [(3, 1.0, 2.0, 1), (1, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y int")
    weights = [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0), (-1.0, 0.25), (0.0, 0.0)]
    b = BL.Blend(df, ["a", "b"], weights, by=["g"], bins=bins)
    exact = {(r.g, r.w_id): r for r in b.exact().collect()}
    bounds = {(r.g, r.w_id): r for r in b.bounds().collect()}
    assert exact.keys() == bounds.keys() and len(exact) == 15
    for g, (i, w) in itertools.product((1, 2), enumerate(weights)):
        s = [(w[0] * a + w[1] * c, y) for h, a, c, y in rows if h == g and c is not None and y is not None]
        pos, neg = [x for x, y in s if y], [x for x, y in s if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        r = exact[g, i]
        assert r.auc == pytest.approx(want, abs=1e-12) and (r.n_pos, r.n_neg) == (len(pos), len(neg))
        assert bounds[g, i].auc_low - 1e-12 <= want <= bounds[g, i].auc_high + 1e-12
    assert exact[3, 0].auc is None
    best = {r.g: r for r in b.best().collect()}
    for g in (1, 2):
        top = max(exact[g, i].auc for i in range(5))
        assert best[g].auc == top and best[g].w_id == min(i for i in range(5) if exact[g, i].auc == top)


@pytest.mark.parametrize("rows_per_bucket", [1, 40, 200_000])
def test_packed_scores_give_every_pair(spark, rows_per_bucket, monkeypatch):
    """A sweep hands over a bucket's scores packed, a row for many; hot buckets, NaN, infinities, NULL groups and signed zeros count as rows do."""
    monkeypatch.setattr(BL, "HOT_BIN", 20)
    monkeypatch.setattr(BL, "ROWS_PER_BUCKET", rows_per_bucket)
    monkeypatch.setattr(BL, "ROWS_AT_ONCE", 64)
    rng = random.Random(rows_per_bucket)
    inf = float("inf")
    rows = [(g, rng.choice([-0.0, 0.0, rng.gauss(0, 1)]), rng.choice([None, rng.gauss(0, 9), 1e9 if rng.random() < 0.1 else 0.25]), int(rng.random() < 0.5))
            for g in (None, "p", "q") for _ in range(200)]
    rows += [("p", float("nan"), 1.0, 1), ("p", float("nan"), 1.0, 0), ("q", inf, 0.0, 1), ("q", -inf, 0.0, 0), ("q", 1.0, inf, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    weights = [(1.0, 0.0), (0.3, 0.7), (0.0, 1.0), (-1.0, 0.25)]
    b = BL.Blend(df, ["a", "b"], weights, by=["g"], bins=64)
    assert b._packed(range(4), 64).count() < 4 * len(rows) / 5  # far fewer rows than scores
    got = {(r.g, r.w_id): r for r in b.exact().collect()}
    assert len(got) == 12

    def place(s):  # Spark's order: NaN last, zeros equal
        return (s != s, 0.0 if s != s else s + 0.0)

    for (g, i), r in got.items():
        w = weights[i]
        s = [(place(w[0] * a + w[1] * c), y) for h, a, c, y in rows if h == g and c is not None and y is not None]
        pos, neg = [x for x, y in s if y], [x for x, y in s if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert r.auc == pytest.approx(want, abs=1e-12) and (r.n_pos, r.n_neg) == (len(pos), len(neg))


def test_families_share_what_folds_learn(spark, wide, monkeypatch):
    """Configurations of two families seek the medians once; the second store holds what it would hold alone."""
    calls, real = [], M.fold_medians
    monkeypatch.setattr(M, "fold_medians", lambda *a, **k: calls.append(1) or real(*a, **k))
    runs = {"gbt": ("gbt", {"maxIter": 1, "maxDepth": 1}), "lr": ("lr", {"C": 0.1})}
    scores = M.run_configs(wide, runs, ["x", "z"], ["c"], ["flag"])
    assert len(calls) == 1 and {r.model for r in scores.select("model").distinct().collect()} == {"gbt", "lr"}
    for first, then in (("gbt", "lr"), ("lr", "gbt")):
        alone = M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], then)
        like = M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], then, like=M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], first))
        assert alone.names == like.names
        assert sorted(map(str, alone.data.collect())) == sorted(map(str, like.data.collect()))


def test_a_store_holds_shared_features_once(spark, wide):
    """Numeric columns and flags are stored once, and each fold's array is what its own medians and cells give."""
    store = M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], "lr")
    assert {"_x", "_c0", "_c1", "_c2"} <= set(store.data.columns)
    assert ("z", 0) not in store.feats.medians and ("x", 0) in store.feats.medians  # z has no NULL to fill
    rows = [r.asDict() for r in store.data.collect()]
    own = {r.id: r for r in wide.collect()}
    for k in range(3):
        seen = sorted(r.x for r in own.values() if r.fold != k and r.x is not None)
        median = float(np.median(seen))
        for r in rows:
            x = own[r["id"]]
            assert r["_x"][0] == x.x and r[f"_f{k}"][:3] == pytest.approx([median if x.x is None else x.x, x.z, x.flag])
            assert r[f"_f{k}"][3:] == r[f"_c{k}"]
    # columns that only the test rows have NULLs in get their medians as well
    test = wide.select("id", "x", F.lit(None).cast("double").alias("z"), "c", "flag")
    got = {r.id: r["_f1"] for r in store.test_rows(test, [0, 1, 2]).collect()}
    assert all(v[1] == pytest.approx(np.median([r.z for r in own.values() if r.fold != 1])) for v in got.values())


def test_steps_reuse_the_hessian_and_end_at_the_optimum(spark, monkeypatch):
    """All folds and penalties at once: most passes add up no Hessian once the steps are short."""
    t = as_table(spark, rows_of(600, 4, 7)).repartition(3)
    fits = [LG.Fit(k, c, cols) for k in range(3) for c in (0.1, 10.0) for cols in (None, (1, 3))]
    sizes, passes = [], LG._passes

    def recorded(*a):
        got = passes(*a)
        sizes.append(max((len(v) for v in got.values()), default=0))
        return got

    monkeypatch.setattr(LG, "_passes", recorded)
    models = LG.fit_logistic(t, fits, "f")
    assert max(np.abs(m.gradient).max() for m in models) <= LG.TOLERANCE
    assert max(abs(r.gradient) for r in LG.certificate(t, models, list("abcd"), "f").collect()) < 1e-9
    assert sum(n == 1 + 5 for n in sizes[2:]) >= 1  # passes of losses and gradients alone


def test_forests_keep_node_ids(spark, wide):
    """Forests keep the node of each row and tree, and are the forests that walking down from the root gives."""
    from pyspark.ml.classification import RandomForestClassifier

    params = {"numTrees": 7, "maxDepth": 5}
    kept = M._classifier("rf", 2, params, 3)
    assert kept.getCacheNodeIds() and not M._classifier("rf", 2, {**params, "cacheNodeIds": False}, 3).getCacheNodeIds()
    store = M.FoldStore(wide, ["x", "z"], ["c"], ["flag"], "rf")
    got = {(r.id, r.fold): r.score for r in M.cv_train(None, ["x", "z"], ["c"], ["flag"], "rf", params, store=store).collect()}
    walked = M.cv_train(None, ["x", "z"], ["c"], ["flag"], "rf", {**params, "cacheNodeIds": False}, store=store).collect()
    assert got == {(r.id, r.fold): r.score for r in walked} and len(got) == 400
    deep = {"minInstancesPerNode": 1, "maxDepth": 12, "featuresCol": "_f0", "labelCol": "_label", "seed": 3, "numTrees": 3}
    rows = store.data.select("_label", array_to_vector("_f0").alias("_f0"))
    plain, own = (RandomForestClassifier(**deep, **k).fit(rows).toDebugString.split("\n", 1)[1] for k in ({}, {"cacheNodeIds": True, "checkpointInterval": -1}))
    assert plain == own


def test_forests_at_once_fill_the_cores():
    assert [M._fits_at_once("rf", n, 12) for n in (4, 17, 24, 101)] == [3, 2, 1, 1]
    assert M._fits_at_once("extra_trees", 101, 12) == 1 and M._fits_at_once("gbt", 101, 12) == 3


@pytest.mark.parametrize("least, group_bytes", [(1, 256 << 20), (5, 1 << 20)])
def test_forests_of_all_folds_are_sparks(spark, least, group_bytes, monkeypatch):
    """All folds' forests grown together, without Spark's fit, are its forests: sampled thresholds, NULL labels, nodes in several groups."""
    monkeypatch.setattr(RF, "GROUP_BYTES", group_bytes)
    i = F.col("id")
    rows = spark.range(0, 15_000, 1, 3).select(
        "id", F.when(i % 7 != 0, F.rand(1) + i % 3).alias("x"), (F.floor(F.rand(2) * 9) - 4).cast("double").alias("z"), F.lit(2.0).alias("same"),
        F.when(i % 5 != 0, F.substring(F.md5(i.cast("string")), 1, 1)).alias("c"), (i % 4).cast("int").alias("fold"),
        F.when(i % 11 != 0, ((F.rand(1) + F.rand(3) * 2 + F.floor(F.rand(2) * 9) / 9) > 2).cast("int")).alias("y"))
    rows = rows.withColumn("flag", F.col("x").isNull().cast("int")).localCheckpoint()
    args = (["x", "z", "same"], ["c"], ["flag"], "rf")
    params = {"numTrees": 30, "maxDepth": 7, "minInstancesPerNode": least}
    test = rows.where("id < 500")
    store = M.FoldStore(rows, *args)

    def scores(p):
        return {(r.id, r.split, r.fold): r.score for r in M.cv_train(None, *args, p, test, store=store, seed=5).collect()}

    want = scores({**params, "maxMemoryInMB": group_bytes >> 20})  # a setting that is left to Spark's own fit
    monkeypatch.setattr(M, "build_pipeline", None)
    assert scores(params) == want and len(want) == 15_500
