import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import q_vectors
from foldwise.llm import whitening as wh

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def xs(rows):
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]


def plain(rows, components=32):
    """n, exact covariance by products (not by polarisation), deviations, components."""
    x = [v for _, v in xs(rows)]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    z = [[n * v[i] - s[i] for i in range(d)] for v in x]
    cov = [[Fraction(sum(a[i] * a[j] for a in z), n ** 3) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = np.array([[float(Fraction(c, n)) for c in a] for a in z]) @ vectors / np.sqrt(values)
    return n, cov, [sum(c * c for c in a) for a in z], white, values / float(sum(cov[i][i] for i in range(d)))


def check(got, rows, components=32):
    n, _, deviations, white, explained = plain(rows, components)
    ids = [i for i, _ in xs(rows)]
    k = white.shape[1]
    assert len(got) == n * k
    for j in range(k):
        mine = sorted((r.vec_id, r.whitened, r.deviation) for r in got if r.component == j + 1)
        want = sorted(zip(ids, white[:, j].tolist(), deviations))
        sign = 1 if np.dot([a[1] for a in mine], [b[1] for b in want]) > 0 else -1
        if sign < 0:
            want = sorted((i, -w, d) for i, w, d in want)
        assert [a[0] for a in mine] == [b[0] for b in want] and [a[2] for a in mine] == [b[2] for b in want]
        assert np.allclose([a[1] for a in mine], [b[1] for b in want], rtol=1e-7, atol=1e-7)
    assert {r.n for r in got} == {n}
    assert np.allclose([next(r.explained for r in got if r.component == j + 1) for j in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def table(spark, rows, kind=T.FloatType()):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind))]))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = q_vectors.op12_whitening(spark, sf)
    assert got.columns == COLUMNS
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    check(got.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_moments_are_exact(spark):
    rng = random.Random(2)
    for reach, size in ((3.0, 200), (1e9, 40), (6e13, 9)):  # the last needs Python's integers
        rows = [(i, [rng.uniform(-reach, reach) for _ in range(4)]) for i in range(size)]
        t = wh.usable(table(spark, rows, T.DoubleType()).repartition(3), "vec_id", "embedding", 64.0, 4)
        model = wh.fit(t, 4)
        n, cov, _, _, _ = plain(rows)
        assert model.n == n == size
        assert [[Fraction(m, n ** 3) for m in row] for row in model.moments] == cov


def test_unusable_rows_repeats_and_clashing_names(spark):
    rng = random.Random(7)
    good = [(i % 20 or None, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(60)]
    good += [good[3]] * 10
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in good]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0, 0.0])]
    t = table(spark, good + bad)
    for name in ("v", "w", "n", "id", "item", "component", "at", "whitened"):
        t = t.withColumn(name, F.lit(name))
    got = wh.whiten(t.repartition(4)).collect()
    key = {None: -1}
    check([r if r.vec_id is not None else type(r)(**(r.asDict() | {"vec_id": -1})) for r in got], [(key.get(i, i), v) for i, v in good])


def test_few_rows_and_no_variance(spark):
    assert wh.whiten(table(spark, [])).collect() == [] and wh.whiten(table(spark, [])).columns == COLUMNS
    assert wh.whiten(table(spark, [(1, None), (2, [float("nan")])])).collect() == []
    (a, b) = wh.whiten(table(spark, [(1, [0.5, 2.0])])).orderBy("component").collect()
    assert (a.n, a.deviation, a.whitened, a.explained, a.identity_error) == (1, 0, None, None, 0.0) and b.component == 2
    got = wh.whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in got] == [False, True, False, False, True, True] and got[0].explained == 1.0
    assert abs(abs(got[0].whitened) - math.sqrt(2)) < 1e-12 and got[0].identity_error < 1e-12
    assert [r.component for r in wh.whiten(table(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.0])]), components=1).collect()] == [1, 1]


def test_deviation_beyond_a_long_is_null(spark):
    big = 2.0 ** 40
    got = wh.whiten(table(spark, [(i, [big * (i % 2), 1.0 * i]) for i in range(6)], T.DoubleType())).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 10 ** 9])
def test_nearest(n):
    for total in (-10 ** 12 - 1, -8, -1, 0, 1, 3, 4, 5, 10 ** 15 + 7):
        m = wh.nearest(total, n)
        assert abs(total - n * m) * 2 <= n
