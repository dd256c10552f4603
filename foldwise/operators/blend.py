"""Blend-weight sweeps, run comparison and promotion verdicts.

The reference optimises linear blend weights with a finite-difference solver on a
piecewise-constant objective; here the search is a deterministic grid sweep.  Predictions
are pivoted to one column per model (a shuffle by id) and stored; each weight vector is one
generated expression over them.  Bin counts of every weight's scores bound its AUC without
a shuffle of rows x weights, so that the best weight needs exact scores of few; a sweep that
reports the exact AUC of every weight shuffles each weight's scores once, by bin (``Blend``).
The weight list is a driver-side parameter (bounded), never a data cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import auc as A
from foldwise.operators import ranks as R
from foldwise.session import by_id, materialize, parallelism

# The blend ratios (first:second source, percent) of the
# reference's raw and rank-scaled two-model sweeps.
FIXED_RATIOS = [(100, 0), (95, 5), (90, 10), (80, 20), (75, 25), (67, 33), (50, 50)]


def simplex_grid(k: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors of k non-negative multiples of 1/steps summing to 1."""
    out = []

    def rec(prefix, left):
        if len(prefix) == k - 1:
            out.append(tuple(p / steps for p in prefix) + (left / steps,))
            return
        for i in range(left + 1):
            rec(prefix + [i], left - i)

    rec([], steps)
    return out


def ratio_weights(ratios: Sequence[tuple[int, int]] = FIXED_RATIOS) -> list[tuple[float, float]]:
    return [(a / 100.0, b / 100.0) for a, b in ratios]


def pivot_models(preds: DataFrame, models: Sequence[str], id_col: str = "id", model_col: str = "model",
                 score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by, id, m1, m2, ...) from long predictions; the model list is passed so no
    distinct-values job is needed."""
    return by_id(preds, *by, id_col).groupBy(*by, id_col).pivot(model_col, list(models)).agg(F.first(score))


def rank_scale(preds: DataFrame, by: Sequence[str] = (), model_col: str = "model", score: str = "score",
               id_col: str = "id") -> DataFrame:
    """B2 companion: replace each model's score by rankdata(score) / n."""
    r = R.rank01(preds, score, list(by) + [model_col], out="_r01")
    return r.select(*by, id_col, model_col, F.col("_r01").alias(score))


#: Bins of a weight's scores.
BINS = 1024
#: Rows of a group and weight that a bucket (neighbouring bins, ordered as one) should hold; rows that a task scores at once.
ROWS_PER_BUCKET = 200_000
ROWS_AT_ONCE = 1_000_000
#: Scores that a task orders, bucket by bucket.
SCORES_PER_TASK = 4_000_000


class Blend:
    """Scores of many weight vectors over one wide table, read a few times and never shuffled
    by row and weight unless a weight's exact AUC is asked for.

    ``wide`` has a column per model, the label and the ``by`` columns; it is stored.  A weight's
    scores are binned between the bounds that the models' extremes give, and positives and
    negatives are counted by (by, weight, bin).  Bin counts merge: what is shuffled is bounded by
    weights x bins for each million rows, whatever the number of rows.  Pairs in different bins are in
    order, so the counts bound each AUC from both sides."""

    def __init__(self, wide: DataFrame, models: Sequence[str], weights: Sequence[Sequence[float]], y: str = "y",
                 by: Sequence[str] = (), bins: int = BINS):
        self.models, self.weights, self.y, self.by, self.bins = list(models), [tuple(map(float, w)) for w in weights], y, list(by), bins
        spark = wide.sparkSession
        n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        # AQE sizes the stage by its small input, while every row is scored once for each weight
        rows = wide.where(F.col(y).isNotNull()).select(*self.by, F.col(y).cast("long").alias("__fw_y"), *self.models)
        self.wide = materialize(rows.repartition(n))
        # NaN and infinities are left to the clamp of the bins
        finite = [F.when(F.abs(F.col(m).cast("double")) < F.lit(float("inf")), F.col(m).cast("double")) for m in self.models]
        ends = self.wide.agg(*[f(c) for c in finite for f in (F.min, F.max)]).head()
        low, high = [0.0 if e is None else e for e in ends[0::2]], [0.0 if e is None else e for e in ends[1::2]]
        self.low = [sum(w * (a if w >= 0 else b) for w, a, b in zip(ws, low, high)) for ws in self.weights]
        self.high = [sum(w * (b if w >= 0 else a) for w, a, b in zip(ws, low, high)) for ws in self.weights]
        self.counts = materialize(self._counted())

    def _place(self, i: int) -> tuple[float, float]:
        """(low, scale) of a weight's bins; scale 0: one bin."""
        scale = self.bins / (self.high[i] - self.low[i]) if self.high[i] > self.low[i] else 0.0
        return self.low[i], scale if 0 < scale < float("inf") else 0.0

    def _binned(self, chosen: Sequence[int]) -> DataFrame:
        """(by, __fw_y, w_id, score, __fw_bin) of the chosen weights."""
        cells = []
        for i in list(chosen):
            terms = [F.lit(w) * F.col(m) for w, m in zip(self.weights[i], self.models)]
            score = sum(terms[1:], terms[0])
            low, scale = self._place(i)
            if scale:
                # a non-decreasing function of the score; NaN, the largest score, has the last bin
                at = (score - F.lit(low)) * F.lit(scale)
                place = F.greatest(F.least(at, F.lit(self.bins - 1.0)), F.lit(0.0)).cast("int")
            else:
                place = F.lit(0)
            cells += [F.lit(i), score, place]
        # one generated expression per cell: several times faster than exploding arrays and looking constants up
        long = self.wide.select(*self.by, "__fw_y", F.stack(F.lit(len(cells) // 3), *cells).alias("w_id", "score", "__fw_bin"))
        return long.where(F.col("score").isNotNull())

    def _each(self, chosen: Sequence[int], work, more: list[T.StructField]) -> DataFrame:
        """(by, w_id, more...): ``work(group, y, score, bin)`` of each weight over some million rows; ``work`` gives the
        columns of ``more``, after the number of the by-group of each of its rows.

        ``score`` and ``bin`` are those of ``_binned``, computed for a task's rows at once."""
        import pyarrow as pa

        k, bins, at_once = len(self.by), self.bins, ROWS_AT_ONCE
        weights = [(i, self.weights[i], *self._place(i)) for i in chosen]
        schema = T.StructType([*[self.wide.schema[c] for c in self.by], T.StructField("w_id", T.IntegerType()), *more])

        def scored(held):
            t = pa.Table.from_batches(held).combine_chunks()
            group, first = _group_numbers([t.column(j) for j in range(k)], t.num_rows)
            own = [t.column(j).take(pa.array(first)).combine_chunks() for j in range(k)]
            y = t.column(k).to_numpy()
            x = [t.column(j).to_numpy() for j in range(k + 1, t.num_columns)]
            for i, ws, low, scale in weights:
                with np.errstate(all="ignore"):
                    score = ws[0] * x[0]
                    for w, m in zip(ws[1:], x[1:]):
                        score = score + w * m
                    place = np.maximum(np.fmin((score - low) * scale, bins - 1.0), 0.0).astype(np.int64) if scale else np.zeros(len(y), np.int64)
                g, *columns = work(group, y, score, place)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(g)) for c in own], pa.array(np.full(len(g), i, np.int32)), *columns],
                                                 names=schema.names)

        def run(batches):
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= at_once:
                    yield from scored(held)
                    held, n = [], 0
            if n:
                yield from scored(held)

        models = [F.col(m).cast("double").alias(f"__fw_m{j}") for j, m in enumerate(self.models)]
        rows = self.wide.select(*self.by, "__fw_y", *models).where(" AND ".join(f"__fw_m{j} IS NOT NULL" for j in range(len(models))))
        return rows.mapInArrow(run, schema)

    def _counted(self) -> DataFrame:
        """(by, w_id, __fw_bin, pos, neg) of all weights."""
        import pyarrow as pa

        bins = self.bins

        def count(group, y, score, place):
            cell = group * bins + place
            if cell.max() < 4 * len(cell) + 65536:
                rows = np.bincount(cell)
                key = np.flatnonzero(rows)
                pos, rows = np.bincount(cell, weights=y)[key].astype(np.int64), rows[key]
            else:
                key, n = np.unique(cell, return_inverse=True)
                pos, rows = np.bincount(n, weights=y).astype(np.int64), np.bincount(n)
            return key // bins, pa.array((key % bins).astype(np.int32)), pa.array(pos), pa.array(rows - pos)

        more = [T.StructField("__fw_bin", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())]
        parts = self._each(range(len(self.weights)), count, more)
        return parts.groupBy(*self.by, "w_id", "__fw_bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def _across(self, counts: DataFrame | None = None) -> DataFrame:
        """(by, w_id, num, pos, neg): twice the pairs in order across bins, and the pairs within bins."""
        before = Window.partitionBy(*self.by, "w_id").orderBy("__fw_bin").rowsBetween(Window.unboundedPreceding, -1)
        big = "decimal(38,0)"
        c = (self.counts if counts is None else counts).withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
        return c.groupBy(*self.by, "w_id").agg(
            F.sum(F.col("pos").cast(big) * (F.col("below") * 2).cast(big)).cast(big).alias("num"),
            F.sum(F.col("pos").cast(big) * F.col("neg").cast(big)).cast(big).alias("within"),
            F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))

    def bounds(self) -> DataFrame:
        """(by, w_id, auc_low, auc_high, n_pos, n_neg): bounds of every weight's AUC, from the bins alone."""
        c = self._across().withColumn("top", F.col("num") + F.col("within") * 2)
        return c.select(*self.by, "w_id", A.auc_of_pairs("num").alias("auc_low"), A.auc_of_pairs("top").alias("auc_high"),
                        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))

    def exact(self, chosen: Sequence[int] | None = None) -> DataFrame:
        """(by, w_id, auc, n_pos, n_neg) of the chosen weights (all by default), exact.

        Neighbouring bins make a bucket.  Pairs across buckets come from the counts, pairs within a bucket from one
        shuffle of the chosen weights' scores, packed: a task hands over one row per (by, weight, bucket) and million
        rows, which holds the scores of its negatives and positives.  A bucket that holds many times its share (a hot
        score, an outlier that stretches the scale) goes through ranges of rows instead (``auc.pair_counts``)."""
        chosen = list(range(len(self.weights)) if chosen is None else chosen)
        key = [*self.by, "w_id", "__fw_bin"]
        total = Window.partitionBy(*self.by, "w_id")
        sizes = self.counts.where(F.col("w_id").isin(chosen)).groupBy(*self.by, "w_id").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
        largest, every = sizes.agg(F.max("n"), F.sum("n")).head()
        span = max(1, min(self.bins, int(self.bins * ROWS_PER_BUCKET / max(largest or 0, 1))))
        bucket = F.floor(F.col("__fw_bin") / span).cast("int")
        counts = self.counts.where(F.col("w_id").isin(chosen)).withColumn("__fw_bin", bucket).groupBy(*key).agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        mean = F.sum(F.col("pos") + F.col("neg")).over(total) / -(-self.bins // span)
        hot = (counts.withColumn("mean", mean).where((F.col("pos") > 0) & (F.col("neg") > 0))
               .where(F.col("pos") + F.col("neg") > F.greatest(F.col("mean") * 16, F.lit(HOT_BIN))).select(*key))
        hot = materialize(hot)  # at most buckets / 16 for each weight
        n_hot = hot.count()
        within = []
        if n_hot:
            rows = _matching(self._binned(chosen).withColumn("__fw_bin", bucket), hot, key, "left_semi")
            within.append(A.pair_counts(rows, "score", "__fw_y", key).select(*self.by, "w_id", "num"))
        packed = self._packed(chosen, span)
        if n_hot:
            packed = _matching(packed, hot, key, "left_anti")
        n_parts = max(-(-(every or 0) // SCORES_PER_TASK), parallelism(self.wide.sparkSession))
        within.append(self._pairs_within(packed.repartition(n_parts, *key), key))
        parts = self._across(counts).select(*self.by, "w_id", "num", "n_pos", "n_neg")
        big = "decimal(38,0)"
        for w in within:
            parts = parts.unionByName(w.select(*self.by, "w_id", F.col("num").cast(big).alias("num"), F.lit(0).cast("long").alias("n_pos"),
                                               F.lit(0).cast("long").alias("n_neg")))
        g = parts.groupBy(*self.by, "w_id").agg(F.sum("num").alias("num"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
        return g.select(*self.by, "w_id", A.auc_of_pairs().alias("auc"), F.col("n_pos").cast("long").alias("n_pos"),
                        F.col("n_neg").cast("long").alias("n_neg"))

    def _packed(self, chosen: Sequence[int], span: int) -> DataFrame:
        """(by, w_id, __fw_bin, n_neg, scores): the scores of each bucket, negatives first, as bytes of doubles."""
        import pyarrow as pa

        buckets = -(-self.bins // span)

        def pack(group, y, score, place):
            key = (group * buckets + place // span) * 2 + (y == 1)
            if len(key) and key.max() < 65536:
                key = key.astype(np.uint16)  # sorted in linear time
            order = np.argsort(key, kind="stable")
            key = key[order].astype(np.int64)
            cells = np.unique(key // 2)
            starts = np.searchsorted(key, np.append(cells * 2, len(cells) and cells[-1] * 2 + 2))
            n_neg = np.searchsorted(key, cells * 2 + 1) - starts[:-1]
            bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cells), [None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(score[order])])
            return cells // buckets, pa.array((cells % buckets).astype(np.int32)), pa.array(n_neg.astype(np.int64)), bytes_.cast(pa.binary())

        more = [T.StructField("__fw_bin", T.IntegerType()), T.StructField("n_neg", T.LongType()), T.StructField("scores", T.BinaryType())]
        return self._each(chosen, pack, more)

    def _pairs_within(self, packed: DataFrame, key: Sequence[str]) -> DataFrame:
        """(by, w_id, num): twice the pairs in order within each bucket, ties as one."""
        import pyarrow as pa

        n_by = len(self.by)
        schema = T.StructType([*[packed.schema[c] for c in (*self.by, "w_id")], T.StructField("num", T.LongType())])

        def count(t):
            neg, pos = [], []
            for n, b in zip(t.column("n_neg").to_pylist(), t.column("scores")):
                s = np.frombuffer(b.as_buffer(), np.float64)
                neg.append(s[:n])
                pos.append(s[n:])
            neg, pos = np.sort(np.concatenate(neg)), np.sort(np.concatenate(pos))
            num = int(np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum())
            return t.select(range(n_by + 1)).slice(0, 1).append_column("num", pa.array([num], pa.int64()))

        return packed.groupBy(*key).applyInArrow(count, schema)

    def with_weights(self, scored: DataFrame) -> DataFrame:
        """Add the weights of each ``w_id``."""
        wt = scored.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(self.weights)],
                                                 "w_id int, " + ", ".join(f"w_{m} double" for m in self.models))
        # the weight table is the parameter list itself: bounded, so broadcast it
        return scored.join(F.broadcast(wt), "w_id", "inner")

    def best(self) -> DataFrame:
        """The weight of the highest AUC in each ``by`` group (ties: lowest w_id), exact: only weights
        whose upper bound reaches the highest lower bound are scored row by row."""
        b = self.bounds().withColumn("bar", F.max("auc_low").over(Window.partitionBy(*self.by)))
        # at most one row for each weight of the parameter list
        chosen = [r.w_id for r in b.where(F.col("auc_high") >= F.col("bar")).select("w_id").distinct().collect()]
        return blend_best(self.with_weights(self.exact(sorted(chosen) or [0])), self.by)


#: Rows of a bucket below which it is never hot.
HOT_BIN = 100_000


def _group_numbers(columns, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group of equal values, a row of each group); NULL is a value."""
    number, first = np.zeros(n, np.int64), np.zeros(min(n, 1), np.int64)
    for c in columns:
        d = c.combine_chunks().dictionary_encode(null_encoding="encode")
        _, first, number = np.unique(number * len(d.dictionary) + d.indices.to_numpy(), return_index=True, return_inverse=True)
    return number, first


def _matching(rows: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    right = keys.select(*[F.col(c).alias(f"__fw_m{i}") for i, c in enumerate(on)])
    cond = [F.col(c).eqNullSafe(F.col(f"__fw_m{i}")) for i, c in enumerate(on)]
    return rows.join(F.broadcast(right), cond, how)


def blend_sweep(wide: DataFrame, models: Sequence[str], weights: Sequence[Sequence[float]],
                y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """B1/B2: (by, w_id, weights..., auc, n_pos, n_neg), exact for every weight vector."""
    b = Blend(wide, models, weights, y, by)
    return b.with_weights(b.exact())


def blend_bounds(wide: DataFrame, models: Sequence[str], weights: Sequence[Sequence[float]],
                 y: str = "y", by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """B1: (by, w_id, weights..., auc_low, auc_high, n_pos, n_neg) without sorting any weight's scores."""
    b = Blend(wide, models, weights, y, by, bins)
    return b.with_weights(b.bounds())


def best_weights(wide: DataFrame, models: Sequence[str], weights: Sequence[Sequence[float]],
                 y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """B1: the weight vector with the highest AUC in each ``by`` group (``Blend.best``)."""
    return Blend(wide, models, weights, y, by).best()


def blend_best(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top-1 report of a sweep: the highest AUC in each ``by`` group (ties -> lowest w_id)."""
    order = Window.partitionBy(*by).orderBy(F.desc("auc"), F.asc("w_id"))
    return sweep.withColumn("__fw_i", F.row_number().over(order)).where(F.col("__fw_i") == 1).drop("__fw_i")


def compare_runs(scored: DataFrame, run_col: str, base: str, cand: str, score: str = "score",
                 fold: str = "fold", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Per-fold AUC of a baseline and a candidate run and their difference (J4), within ``by``."""
    per = A.auc(scored.where(F.col(run_col).isin(base, cand)), score, y, [*by, run_col, fold])
    g = per.groupBy(*by, fold).agg(*[F.max(F.when(F.col(run_col) == run, F.col("auc"))).alias(n) for run, n in ((base, "auc_base"), (cand, "auc_cand"))],
                                   F.count(F.lit(1)).alias("__fw_n"))
    # a fold that one of the runs lacks has no difference
    return g.where(F.col("__fw_n") == 2).drop("__fw_n").withColumn("delta", F.col("auc_cand") - F.col("auc_base"))


def promotion_verdict(deltas: DataFrame, threshold: float = 0.0003, by: Sequence[str] = ()) -> DataFrame:
    """Mean delta, sd of paired deltas, folds improved and a verdict, within ``by``.

    promote: mean delta above the noise threshold AND a majority of folds improved;
    reject: mean delta below zero; otherwise neutral.
    """
    g = deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta"),
                   F.count_if(F.col("delta") > 0).alias("folds_improved"), F.count("delta").alias("n_folds"))
    verdict = (F.when((F.col("mean_delta") > threshold) & (F.col("folds_improved") * 2 > F.col("n_folds")),
                      F.lit("promote"))
               .when(F.col("mean_delta") < 0, F.lit("reject")).otherwise(F.lit("neutral")))
    return g.withColumn("verdict", verdict)
