import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import kmeans_tree as kt

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, k, step):
    ok, seen = [], set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) or len(v) != 8:
            continue
        key = (i, tuple(np.float32(v)))
        if key not in seen:
            seen.add(key)
            ok.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for q in sorted({i for i, _ in ok if i % step == 0}):
        qv = min((v.tolist() for i, v in ok if i == q))
        near = sorted((-(v * np.array(qv)).sum(), i) for i, v in ok if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    out = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.3 * rng.normal(size=8)]) for i in range(600)]
    same = [1.0] * 8
    out += [(1000 + i, same) for i in range(80)]  # one very common vector
    out += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [1.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8),
            (2005, [1.0, 2.0]), (None, [9.0] * 8), (20, out[20][1]), (40, [0.5] * 8), (2010, [])]
    return out


def result(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


@pytest.mark.parametrize("block", [8192, 16])
def test_all_leaves_give_the_exact_result(spark, block):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], SCHEMA + ", leaf int, id string")
    got = result(kt.search(df, F.col("id") % 20 == 0, recall=1.0, calibrate=10_000, leaf_size=32, block=block))
    want = slow(rows(), 20, 20)
    assert got.keys() == want.keys()
    hits = total = 0
    for q in want:
        assert [r for r, _, _ in got[q]] == list(range(1, len(want[q]) + 1))
        hits += len({i for _, i, _ in got[q]} & {i for i, _ in want[q]})
        total += len(want[q])
        scores = [s for _, _, s in got[q]]
        assert scores == sorted(scores, reverse=True) and q not in {i for _, i, _ in got[q]}
        if [i for _, i, _ in got[q]] == [i for i, _ in want[q]]:
            assert np.allclose(scores, [s for _, s in want[q]], atol=1e-12)
    assert hits == total  # every query was in the calibration


def test_recall_of_a_narrow_search(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(3000)]
    got = result(kt.search(spark.createDataFrame(data, SCHEMA), F.col("id") % 20 == 0, recall=0.95, calibrate=60, leaf_size=64))
    want = slow(data, 20, 20)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_one_id_with_many_vectors(spark):
    """They are candidates of their own, dealt over blocks by id and vector; the smallest is the id's query."""
    rng = np.random.default_rng(5)
    data = [(40, [float(np.float32(x)) for x in rng.normal(size=8)]) for _ in range(300)] + [
        (i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(100, 160)]
    df = spark.createDataFrame(data, SCHEMA)
    got = result(kt.search(df, F.col("id") % 20 == 0, recall=1.0, calibrate=10_000, leaf_size=32, block=64))
    want = slow(data, 20, 20)
    assert got.keys() == want.keys() == {40, 100, 120, 140}
    for q in want:
        assert sorted(s for _, _, s in got[q]) == pytest.approx(sorted(s for _, s in want[q]), abs=1e-9)


def test_few_or_no_rows(spark):
    few = [(0, [1.0] * 8), (1, [2.0] * 8), (2, [1.0] * 8)]
    got = result(kt.search(spark.createDataFrame(few, SCHEMA), F.col("id") % 20 == 0))
    assert got == {0: [(1, 1, 16.0), (2, 2, 8.0)]}
    for none in ([], [(0, None)], [(0, [0.0] * 8)], [(1, [1.0] * 8)]):
        out = kt.search(spark.createDataFrame(none, SCHEMA), F.col("id") % 20 == 0)
        assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_best_bins_visits_each_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    tree = kt.fit(x, leaf_size=50)
    assert set(tree.place(x)) == set(range(tree.n_leaves))
    for q in x[:5]:
        assert sorted(tree.best_bins(q)) == list(range(tree.n_leaves))
    same = kt.fit(np.ones((500, 8)), leaf_size=50)
    assert same.n_leaves == 1
