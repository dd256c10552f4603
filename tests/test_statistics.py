"""Distinct counts, correlations, lookups, sources and sinks: edge cases and plans."""

import json
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tables import SF_SMALL
from foldwise.functions import exprs as X
from foldwise.operators import constraints as K
from foldwise.operators import encode as EN
from foldwise.operators import features as FE
from foldwise.operators import folds as FO
from foldwise.operators import profile as P
from foldwise.sources import fixtures as FX
from foldwise.sources import io as IO


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 0.0, "a", True, 2 ** 53), (2, -0.0, "", None, 2 ** 53 + 1), (3, float("nan"), None, False, None), (4, float("nan"), "a", True, 1), (5, None, "b", True, 1)]
    return spark.createDataFrame(rows, "id int, d double, s string, t boolean, l bigint")


def test_distinct_by_type(spark, odd):
    exprs = {c: F.col(c) for c in odd.columns} | {"none": F.lit(None).cast("double")}
    got = P.distinct_counts(odd, exprs).first().asDict()
    assert got == {"id": 5, "d": 2, "s": 3, "t": 2, "l": 3, "none": 0}  # NaN is a value, and so is the empty text
    assert P.distinct_counts(odd, exprs, approx=True).first().asDict() == got  # sketches of few values are exact
    assert {(r.t, r.name): r.n_distinct for r in P.distinct_rows(odd, {"s": F.col("s")}, ["t"]).collect()} == {(True, "s"): 2, (None, "s"): 1}
    assert "Expand" not in plan_of(P.distinct_counts(odd, exprs))


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9_000).alias("v"))
    stored = P.distinct_sketches(df, {"v": F.col("v")}, ["day"])
    est = P.merged_distinct(stored).first().n_distinct
    assert abs(est - 9_000) < 450


def test_quantization_without_expand(spark, odd):
    got = {r.column_name: r for r in K.quantization(odd.where("id <> 3 AND id <> 4"), ["d", "l", "id"]).collect()}
    assert got["d"].n_distinct_round == 1 and got["d"].frac_non_integer == 0 and got["id"].max == 5
    near = {r.column_name: r.n_distinct_round for r in K.quantization(odd, ["l", "id"], approx=True).collect()}
    assert near["id"] == 5
    assert "Expand" not in plan_of(K.quantization(odd, ["d", "id"])) and "Expand" not in plan_of(FE.column_roles(odd, ["d", "s"]))


def test_correlations_of_many_pairs_and_groups(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 9))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 8] = 4.0
    pdf = pd.DataFrame(x, columns=list("abcdefghi"))
    pdf["grp"] = np.where(np.arange(200) % 3 == 0, None, "k")
    df = spark.createDataFrame([tuple(None if v is not None and v != v else v for v in r) for r in pdf[[*"abcdefghi", "grp"]].itertuples(index=False)],
                               ", ".join(f"{c} double" for c in "abcdefghi") + ", grp string").repartition(3)
    pairs = [(a, b) for i, a in enumerate("abcdefghi") for b in "abcdefghi"[i + 1:]]
    for by, frames in (([], {(): pdf}), (["grp"], {("k",): pdf[pdf.grp == "k"], (None,): pdf[pdf.grp.isna()]})):
        out = P.corr_panel(df, pairs, by)
        got = {(tuple(r[c] for c in by), r.a, r.b): r for r in out.collect()}
        assert len(got) == len(pairs) * len(frames)
        for key, f in frames.items():
            for a, b in pairs:
                both = f[[a, b]].dropna()
                r = got[key, a, b]
                assert r.n == len(both)
                if "i" in (a, b):
                    assert r.r is None
                else:
                    assert r.r == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)
        assert plan_of(out).count("Scan ExistingRDD") <= 2  # the initial and the final plan of one scan


@pytest.mark.parametrize("rows", [None, 1])
def test_lookup_by_measured_size(spark, rows):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 50 + ["b", None, "zz"])], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, v int")
    out = EN.lookup(df, table, ["k"], rows)
    got = {r.id: r.v for r in out.collect()}
    assert len(got) == out.count() == 53 and got[0] == 1 and got[50] == 2 and got[51] is None and got[52] is None
    assert set(out.columns) == {"id", "k", "v"}
    if rows is None:
        assert "Exchange hashpartitioning" not in plan_of(out)


def test_encodings_do_not_shuffle_the_large_side(spark):
    df = FX.obs_events(spark, SF_SMALL)
    train = FO.stratified_folds(df.where("split = 'train'"), "id", "y", 5, 42, store=True)
    for out in (EN.frequency_encode(train, df, "c1"), EN.oof_target_encode(train, "c1"), EN.test_target_encode(train, df, "c2"), EN.category_codes(train, df, "c2")):
        plan = plan_of(out.drop("_"))
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert "Exchange hashpartitioning" not in plan.split("== Initial Plan ==")[0].split("Subquery")[0]


def test_clip_and_levels(spark, odd):
    got = [r.c for r in odd.orderBy("id").select(X.clip(F.col("d") + 0.5, 0.1, 0.4).alias("c")).collect()]
    assert got == [0.4, 0.4, None, None, None]
    assert FE.fitted_levels(odd, "s") == ["", "a", "b"]
    with pytest.raises(ValueError):
        FE.fitted_levels(odd, "s", most=2)


def test_fold_table_equals_folds_of_each_seed(spark):
    df = FX.obs_events(spark, SF_SMALL).where("split = 'train'")
    every = {(r.id, r.seed): r.fold for r in FO.fold_table(df, [1, 42, 7]).collect()}
    for s in (1, 42, 7):
        own = {(r.id, s): r.fold for r in FO.stratified_folds(df, seed=s).collect()}
        assert own.items() <= every.items()
    assert plan_of(FO.fold_table(df, [1, 42, 7])).split("Initial Plan")[0].count("FileScan") <= 2


def test_broken_csv_lines(spark):
    d = tempfile.mkdtemp(prefix="fw-csv-")
    with open(f"{d}/t.csv", "w") as f:
        f.write("id,a,b\n1,1.5,x\n2,NaN,\nthree,1,y\n4,,\"q,\nr\"\n5,1,z,extra\n6,oops,k\n")
    good, broken = IO.read_csv(spark, f"{d}/t.csv", "id long, a double, b string")
    assert [(r.id, r.a) for r in good.where("id <= 2").orderBy("id").collect()] == [(1, 1.5), (2, None)]
    lines = {r[0] for r in broken.collect()}
    assert {"three,1,y", "5,1,z,extra", "6,oops,k"} <= lines and good.where("id in (5, 6)").count() == 0
    assert good.select("id").where("id = 6").count() == 0  # pruned columns still decide
    assert broken.count() == len(lines)


def test_partitions_are_replaced_and_checked(spark):
    d = tempfile.mkdtemp(prefix="fw-pred-")
    p = spark.createDataFrame([(i, float(i), "train", s, "m") for i in range(4) for s in (1, 2)], IO.PRED_SCHEMA)
    assert {(r.seed, r.n) for r in IO.write_predictions(p, f"{d}/p").collect()} == {(1, 4), (2, 4)}
    again = spark.createDataFrame([(9, None, "train", 2, "m")], IO.PRED_SCHEMA)
    assert {(r.seed, r.n) for r in IO.write_predictions(again, f"{d}/p").collect()} == {(1, 4), (2, 1)}
    assert IO.read_predictions(spark, f"{d}/p").count() == 5 and IO.check_predictions(spark, f"{d}/p").count() == 0
    # rows that no commit wrote are found
    p.where("seed = 1").drop("split", "seed", "model").write.mode("append").parquet(f"{d}/p/split=train/seed=1/model=m")
    assert [(r.seed, r.n, r.found) for r in IO.check_predictions(spark, f"{d}/p").collect()] == [(1, 4, 8)]


def test_records_of_any_shape(spark):
    docs = [{"id": 1, "v": [0.5, None, "x"]}, {"id": 2, "v": {"m": [1, 2], "n": 3}}, {"id": 3, "v": 7}, {"id": 4}, {"id": 5, "v": []}, {"id": 6, "v": None}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("no json {",), (None,)], "doc string")
    rec = IO.parse_records(df, "doc").withColumn("id", F.try_variant_get("record", "$.id", "int"))
    found = IO.variant_values(rec, "record", "$.v", ["id"]).where("id < 4").collect()
    got = sorted(((r.id, r.key or "", r.pos, r.value) for r in found), key=lambda t: t[:3])
    assert got == [(1, "", 0, 0.5), (1, "", 1, None), (1, "", 2, None), (2, "m", 0, 1.0), (2, "m", 1, 2.0), (2, "n", 0, 3.0), (3, "", 0, 7.0)]


def test_correlations_share_short_compiled_steps(spark):
    """Pairs with both orders and a repeated pair; the aggregate is compiled, and no step lists all pairs."""
    rng = np.random.default_rng(1)
    cols = [f"c{i}" for i in range(20)]
    x = rng.normal(size=(60, 20))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    pairs = [(a, b) for a in cols for b in cols] + [("c3", "c1")]
    out = P.corr_panel(df, pairs)
    got = [(r.a, r.b, r.r, r.n) for r in out.collect()]
    assert sorted((a, b) for a, b, _, _ in got) == sorted(pairs)
    want = np.corrcoef(x.T)
    assert all(n == 60 and r == pytest.approx(want[cols.index(a), cols.index(b)], abs=1e-9) for a, b, r, n in got)
    partial = [line for line in plan_of(out).splitlines() if "partial_covar_samp" in line]
    assert any("*(" in line for line in partial)  # inside code generation
    assert max(len(line) for line in plan_of(out).splitlines() if "Generate stack" in line) < 5000
