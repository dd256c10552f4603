"""Sources/sinks round trips, streaming feature application, CV training shape."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tables import SF_SMALL
from foldwise.operators import features as FE
from foldwise.operators import folds as FO
from foldwise.operators import models as M
from foldwise.sources import fixtures as FX
from foldwise.sources import io as IO
from foldwise.streaming import features as SF


def test_prediction_round_trip_and_pruning(spark):
    d = tempfile.mkdtemp(prefix="fw-io-")
    p = FX.preds(spark, SF_SMALL)
    IO.write_predictions(p, f"{d}/preds")
    back = IO.read_predictions(spark, f"{d}/preds", split="train", seed=42, model="m_a")
    assert back.count() == p.where("split = 'train' AND seed = 42 AND model = 'm_a'").count()
    assert IO.read_predictions(spark, f"{d}/missing").count() == 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_csv_nan_to_null_and_scored_csv(spark):
    d = tempfile.mkdtemp(prefix="fw-csv-")
    with open(f"{d}/t.csv", "w") as f:
        f.write("id,a,b\n1,1.5,x\n2,NaN,\n3,,y\n")
    df = IO.read_table(spark, f"{d}/t.csv", "id long, a double, b string", fmt="csv")
    rows = {r.id: r for r in df.collect()}
    assert rows[2].a is None and rows[3].a is None and rows[2].b is None
    scored = spark.createDataFrame([(1, 1.7), (2, -0.2), (3, 0.4), (4, None)], "id long, score double")
    IO.write_scored_csv(scored, f"{d}/sub", "label")
    back = spark.read.option("header", True).csv(f"{d}/sub").collect()
    assert {int(r.id): r.label and float(r.label) for r in back} == {1: 1.0, 2: 0.0, 3: 0.4, 4: None}


def test_metrics_json(spark):
    d = tempfile.mkdtemp(prefix="fw-json-")
    IO.write_metrics(spark, {"seed_results": {"42": {"fold_aucs": {"m": [0.9, 0.91, 0.92]}}}}, f"{d}/m")
    df = IO.read_metrics(spark, f"{d}/m")
    vals = [r.value for r in IO.metric_array(df, ["seed_results", "42", "fold_aucs", "m"]).orderBy("pos").collect()]
    assert vals == [0.9, 0.91, 0.92]


def test_schema_advisor(spark):
    df = spark.createDataFrame([(1, 300, 1.5, "a")], "a long, b long, c double, d string")
    sug = {r.column_name: r.suggested for r in IO.schema_advisor(df).collect()}
    assert sug == {"a": "tinyint", "b": "smallint", "c": "float", "d": "string"}


def test_streaming_features(spark):
    src = tempfile.mkdtemp(prefix="fw-stream-")
    ev = FX.obs_events(spark, SF_SMALL)
    ev.where("split = 'test'").select("id", "x1", "x2", "c1").write.mode("overwrite").parquet(f"{src}/in")
    stream = SF.read_stream(spark, f"{src}/in", "id long, x1 double, x2 double, c1 string")
    feats = SF.apply_spec(stream, FE.isna_spec(["x1", "x2"]), keep=["id", "c1"])
    enc = SF.apply_encodings(feats, ev.where("split = 'train'"), ["c1"])
    SF.run_to_memory(enc, "fw_stream_out", f"{src}/ckpt")
    out = spark.sql("SELECT * FROM fw_stream_out")
    assert out.count() == ev.where("split = 'test'").count()
    assert {"x1_isna", "c1_freq_enc", "c1_target_enc"} <= set(out.columns)


def test_cv_train_shape(spark):
    ev = FX.obs_events(spark, SF_SMALL)
    tr = FO.stratified_folds(ev.where("split = 'train'"))
    te = ev.where("split = 'test'")
    p = M.cv_train(tr, ["x1", "x2", "x3"], ["c1"], [], "lr", test=te)
    oof = p.where("split = 'train'")
    assert oof.count() == tr.count() and oof.select("id").distinct().count() == tr.count()
    assert p.where("split = 'test'").count() == te.count()
    j = oof.join(tr.select("id", F.col("fold").alias("f0")), "id")
    assert j.where(F.col("fold") != F.col("f0")).count() == 0


def test_canonical_run_end_to_end(spark):
    import json as _json

    from foldwise.plans.canonical import canonical_run
    from foldwise.plans.common import O_NUM, O_ROLES

    o = FX.obs_orders(spark, SF_SMALL)
    tr = o.where(F.col("c1").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    te = o.where(~F.col("c1").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).drop("y")
    out = tempfile.mkdtemp(prefix="fw-canon-")
    # c2 (order status) is the label's source: keep it out of the model
    m = canonical_run(tr.drop("c2"), te.drop("c2"), O_NUM, ["c1"], O_ROLES, {"lr": ("lr", {"C": 0.1})},
                      [42, 100], out, k=3)
    assert set(m["seed_results"]) == {"42", "100"}
    assert len(m["seed_results"]["42"]["fold_aucs"]["lr"]) == 3
    assert 0.0 <= m["super_ensemble_auc"] < 1.0  # no leaked label column: not perfect
    assert IO.read_predictions(spark, f"{out}/predictions", split="test").count() == 2 * te.count()
    back = _json.loads(spark.read.text(f"{out}/metrics").first().value)
    assert back["super_ensemble_auc"] == m["super_ensemble_auc"]


def test_recommended_conf_scales_with_input():
    from foldwise.session import recommended_conf
    small, big = recommended_conf(10 ** 9), recommended_conf(100 * 10 ** 12)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 372_530
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_reference_model_names_map_to_spark_families(spark):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    assert isinstance(M._classifier("lgbm", 3, {"maxIter": 2}, 1), GBTClassifier)
    assert isinstance(M._classifier("extra_trees", 3, {"numTrees": 2}, 1), RandomForestClassifier)


def test_fold_medians_are_exact(spark):
    import numpy as np
    df = spark.range(2001).select(F.col("id"), (F.col("id") % 5).cast("int").alias("fold"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("a"),
                                  F.lit(None).cast("double").alias("none"), (F.col("id") % 2).alias("y"))
    pdf = df.toPandas()
    got = {(r.column_name, r.fold): r["median"] for r in M.fold_medians(df, ["a", "none"], range(5)).collect()}
    assert got == {("a", k): float(np.nanmedian(pdf[pdf.fold != k]["a"].astype(float))) for k in range(5)}


@pytest.mark.parametrize("model_type,params", [("gbt", {"maxIter": 3, "maxDepth": 3}), ("lr", {}), ("extra_trees", {"numTrees": 3, "maxDepth": 3})])
def test_wide_categories_train_and_score(spark, model_type, params):
    """A category of 400 levels, unseen levels, NULL categories and labels."""
    df = spark.range(1200).select("id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), (F.col("id") % 400).cast("string"))).alias("wide"),
                                  F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101) * 1.0).alias("x"),
                                  F.when(F.col("id") != 5, (F.col("id") % 400 < 150).cast("int")).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    test = spark.createDataFrame([(5000, "never seen", 3.0), (5001, None, None), (5002, "c7", 1.0), (5002, "c7", 1.0)], "id long, wide string, x double")
    p = M.cv_train(df, ["x"], ["wide"], [], model_type, params, test=test)
    assert p.where("split = 'train'").count() == 1200 and p.where("split = 'test'").count() == 4
    assert p.where("score is null or score < 0 or score > 1").count() == 0


def test_target_encoding_leaves_out_both_folds(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 3, int(i % 5 == 0), 1.0) for i in range(90)], "id long, c string, fold int, y int, x double")
    feats = M.FoldFeatures(df, ["x"], ["c"], [], "lr", "id", "y", "fold")
    pdf = df.toPandas()
    data = feats.attach(df)
    for training in (True, False):
        for r in data.select("id", "c", "fold", *feats.columns(0, training)).collect():
            if (r.fold != 0) != training:
                continue
            away = {0, r.fold} if training else {0}
            own = pdf[(pdf.c == r.c) & ~pdf.fold.isin(away)]
            assert abs(r._x_c_target - own.y.mean()) < 1e-12
            assert abs(r._x_c_freq - len(pdf[(pdf.c == r.c) & (pdf.fold != 0)]) / len(pdf[pdf.fold != 0])) < 1e-12


def test_clip_and_logit_keep_null(spark):
    from foldwise.functions import exprs as X
    rows = spark.createDataFrame([(None,), (-1.0,), (0.5,), (2.0,)], "s double").select(X.clip("s").alias("c")).collect()
    assert [r.c for r in rows] == [None, 0.0, 0.5, 1.0]


def test_stack_keeps_seeds_apart(spark):
    ev = FX.obs_events(spark, SF_SMALL)
    tr = FO.stratified_folds(ev.where("split = 'train'"), k=3)
    oof = FX.preds(spark, SF_SMALL)
    p = M.stack(oof, tr.select("id", "y", "fold"), ["m_a", "m_b"], seeds=[42, 100])
    assert p.where("split = 'train'").count() == tr.count()
    assert p.where("split = 'test'").count() == ev.where("split = 'test'").count()
