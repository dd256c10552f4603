"""Embedding whitening from exact variances only (polarisation).

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2

so the squares of d dimensions and of d * (d - 1) / 2 sums of two dimensions are all that is
aggregated; no product of two different dimensions is ever formed.

Entries become integers x = floor(scale * entry) + offset, which makes every sum exact:

1. per task the count and the sum of each dimension; together n and S;
2. entries centred on the integer nearest to S / n, y = x - m, with the remainder r = S - n * m
   left over.  Per task the squares of y for each dimension and each sum of two.  The squares about
   the true mean follow exactly: sum (n * x - S)^2 = n^2 * sum y^2 - n * r^2;
3. covariances by the identity above, as fractions of integers, each rounded to a double once;
   ``eigh`` gives the components.

Each step is one pass over the input with a result of d * (d + 1) / 2 rows at most, so
nothing that grows with the rows is shuffled, broadcast or collected.  A lost executor
costs the tasks it ran.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers up to this size are exact as doubles; larger entries cannot be x.
LARGEST = 2 ** 52
#: Sums leave a task as high * 2^32 + low, so that they stay exact in Spark's sums too.
LOW = 32

SUMS = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("high", T.DecimalType(38, 0)), T.StructField("low", T.LongType())])


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: bounded by the number of dimensions."""

    n: int
    sums: list[int]
    #: centred exactly: sum over rows of (n * x_i - S_i) * (n * x_j - S_j)
    moments: list[list[int]]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centres(self) -> np.ndarray:
        return np.array([nearest(s, self.n) for s in self.sums], np.int64)

    @property
    def remainders(self) -> list[int]:
        return [s - self.n * nearest(s, self.n) for s in self.sums]


def nearest(total: int, n: int) -> int:
    """The integer nearest to total / n."""
    return (2 * total + n) // (2 * n)


def usable(table: DataFrame, id_col: str, vec_col: str, scale: float, dims: int | None = None) -> DataFrame:
    """(id, v): rows with a vector of finite numbers whose x is exact; of ``dims`` entries if given."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).alias("id"), v.alias("v"))
    # a comparison with NaN is false but for "greater": abs(NaN) > LARGEST holds
    good = F.forall("v", lambda c: c.isNotNull() & ~(F.abs(c * F.lit(float(scale))) > F.lit(float(LARGEST))))
    size = F.size("v") > 0 if dims is None else F.size("v") == dims
    return rows.where(F.col("v").isNotNull() & size & F.coalesce(good, F.lit(False)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of lists of ``dims`` doubles as rows of an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dims)


def integers(values: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64) + offset


def squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of each column of ``y``, then of each sum of two columns."""
    d = y.shape[1]
    total = [0] * (d * (d + 1) // 2)
    reach = 2 * max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))), 1)
    if reach * reach >= 2 ** 62:  # Python's integers
        y, step = y.astype(object), 256
    else:
        step = max(1, min(2048, 2 ** 62 // (reach * reach)))
    for at in range(0, len(y), step):
        part = np.ascontiguousarray(y[at:at + step].T)
        k = 0
        for block in chain([part], (part[i] + part[i + 1:] for i in range(d - 1))):
            for s in (block * block).sum(1).tolist():
                total[k] += s
                k += 1
    return total


def sum_rows(total: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    high = [Decimal(t >> LOW) for t in total]
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(high, pa.decimal128(38, 0)),
                                       pa.array([t & (2 ** LOW - 1) for t in total], pa.int64())], names=SUMS.names)


def totals(parts: DataFrame, n: int) -> list[int]:
    """The sums of all tasks; ``n`` of them."""
    rows = parts.groupBy("item").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    out = [0] * n
    for r in rows:
        out[r.item] = (int(r.high) << LOW) + int(r.low)
    return out


def dimensions(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> int:
    """The commonest length of a usable vector (ties: the longer); 0 if there is none."""
    sizes = usable(table, id_col, vec_col, scale).groupBy(F.size("v").alias("d")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("d")).head()
    return found.d if found else 0


def fit(rows: DataFrame, dims: int, scale: float = 64.0, offset: int = 1_000_000) -> Fit | None:
    """Exact moments and components of (id, v) rows as ``usable`` gives them; None without rows."""
    def first(batches):
        n, total = 0, [0] * dims
        for b in batches:
            x = integers(matrix(b.column(0), dims), scale, offset)
            n += len(x)
            # |x| <= 2^53, so that a thousand fit in a long
            for at in range(0, len(x), 512):
                total = [t + s for t, s in zip(total, x[at:at + 512].sum(0).tolist())]
        if n:
            yield sum_rows([*total, n])

    *sums, n = totals(rows.select("v").mapInArrow(first, SUMS), dims + 1)
    if not n:
        return None
    centres = np.array([nearest(s, n) for s in sums], np.int64)

    def second(batches):
        total = None
        for b in batches:
            found = squares(integers(matrix(b.column(0), dims), scale, offset) - centres)
            total = found if total is None else [t + s for t, s in zip(total, found)]
        if total:
            yield sum_rows(total)

    found = totals(rows.select("v").mapInArrow(second, SUMS), dims * (dims + 1) // 2)
    rest = [s - n * int(c) for s, c in zip(sums, centres)]
    # sums of squares about the true means: of n * x - S, and of sums of two of them
    own = [n * n * q - n * r * r for q, r in zip(found, rest)]
    moments = [[0] * dims for _ in range(dims)]
    k = dims
    for i in range(dims):
        moments[i][i] = own[i]
        for j in range(i + 1, dims):
            both = n * n * found[k] - n * (rest[i] + rest[j]) ** 2
            moments[i][j] = moments[j][i] = (both - own[i] - own[j]) // 2
            k += 1
    cov = np.array([[m / n ** 3 for m in row] for row in moments])
    values, vectors = np.linalg.eigh(cov)
    return Fit(n, sums, moments, cov, values[::-1].copy(), vectors[:, ::-1].copy())


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32,
           scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row.

    - A vector that is null, empty or holds null or non-finite entries takes no part, nor does
      one with an entry beyond 2^52 / ``scale`` (its x would not be exact) or of another
      length than the commonest (ties: the longer).
    - ``deviation`` is the row's sum over the dimensions of (n * x - S)^2, null if a long
      cannot hold it.
    - Rows count as often as they come; a null id is returned as it is.
    - ``whitened`` is (x - S / n) on the unit eigenvector, over the root of the eigenvalue;
      null for a component without variance (its eigenvalue is at most d * 2^-52 of the
      largest), which ``identity_error`` leaves out (0 if none is left).  ``explained`` is
      the eigenvalue over the trace, null if the trace is 0.
    - ``identity_error`` is measured on the whitened rows.  Their sums of doubles can differ in
      the last digits from run to run; all else is the same in every run up to the sign
      of an eigenvector.
    - No usable row gives no rows.  No column but the two named is read.
    """
    id_type = table.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("deviation", T.LongType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])
    tail = {"n": "long", "explained": "double", "identity_error": "double"}
    order = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    dims = dimensions(table, id_col, vec_col, scale)
    rows = usable(table, id_col, vec_col, scale, dims)
    model = fit(rows, dims, scale, offset) if dims else None
    if model is None:
        empty = table.sparkSession.createDataFrame([], schema).select(id_col, "deviation", F.posexplode("w").alias("component", "whitened"))
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in tail.items()]).select(order)

    n, k = model.n, min(components, dims)
    centres, rest = model.centres, model.remainders
    shift = np.array([r / n for r in rest])
    real = (model.values[:k] > max(float(model.values[0]), 0.0) * dims * 2.0 ** -52) & (model.values[:k] > 0)
    turn = np.where(real, model.vectors[:, :k] / np.sqrt(np.where(real, model.values[:k], 1.0)), 0.0)
    trace = sum(model.moments[i][i] for i in range(dims))
    explained = [float(v) / (trace / n ** 3) if trace else None for v in model.values[:k]]

    def centred(b):
        return integers(matrix(b.column(0), dims), scale, offset) - centres

    def deviations(y: np.ndarray):
        """Sum of (n * y - r)^2 of each row."""
        reach = n * (max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) + 1)
        if reach * reach * dims < 2 ** 63:
            z = n * y - np.array(rest, np.int64)
            return (z * z).sum(1)
        z = n * y.astype(object) - np.array(rest, object)
        return [s if s < 2 ** 63 else None for s in (z * z).sum(1).tolist()]

    # the covariance of the whitened rows, to be the identity
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def products(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = (centred(b) - shift) @ turn
            total += w.T @ w
            mean += w.sum(0)
        flat = [*(total[i, j] for i, j in pairs), *mean]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["item", "total"])

    found = {r.item: r.total for r in rows.select("v").mapInArrow(products, "item int, total double").groupBy("item").agg(F.sum("total").alias("total")).collect()}
    mean = [found[len(pairs) + i] / n for i in range(k)]
    error = max((abs(found[p] / n - mean[i] * mean[j] - (i == j)) for p, (i, j) in enumerate(pairs) if real[i] and real[j]), default=0.0)

    def project(batches):
        for b in batches:
            y = integers(matrix(b.column(1), dims), scale, offset) - centres
            w = (y - shift) @ turn
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()),
                                           pa.array(w.reshape(-1), mask=np.tile(~real, len(w))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(y), pa.int64()), out], names=schema.names)

    out = rows.mapInArrow(project, schema).select(id_col, "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return out.select(id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
