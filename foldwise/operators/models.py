"""Cross-validated training and model-level ensembling.

Everything a fold's model learns comes from the training folds only, so the scored fold
never enters medians, category codes, encodings or scaling:

* medians (E5) are exact, for all columns and folds from one rank selection;
* categories enter trees and MLP as codes where they have at most ``CODE_LEVELS`` levels;
  wider ones, and all of them in the families that take numeric columns only
  (logistic regression, forests), as frequency and target encodings (E1, E3) computed by
  "total minus fold" from one (category, fold) table;
* then Newton steps for logistic regressions (``logistic``), or ``VectorAssembler`` [-> ``StandardScaler``]
  -> classifier.

The features of all folds are computed and stored once (``FoldStore``), for any number of candidates; every
prediction is a keyed row (id, fold, model, score), never a positional array.  Logistic fits of all folds
and candidates share their passes, and so do the forests of all folds (``forest``); the k fits of other families
run a few at a time.  The test table is read once.

Spark ML trees reject NaN and NULL vectors, hence the imputation and the explicit
``_isna`` flags.  Mapping of the reference's boosting knobs (SURVEY 2.8.1):
learning_rate -> stepSize, n_estimators -> maxIter, num_leaves -> maxDepth,
min_child_samples -> minInstancesPerNode, subsample -> subsamplingRate,
colsample -> featureSubsetStrategy.  Early stopping draws its validation rows
from the TRAINING folds (md5 of the id), not from the scored fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import exprs as X
from foldwise.operators import auc as A
from foldwise.operators import forest as RF
from foldwise.operators import logistic as LG
from foldwise.operators import ranks as R
from foldwise.session import by_id, materialize, parallelism, small

# Default hyper-parameters of the reference's model families,
# re-expressed with Spark ML parameter names.
DEFAULTS = {
    "gbt": {"maxIter": 50, "maxDepth": 6, "stepSize": 0.12, "subsamplingRate": 0.8,
            "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
    "rf": {"numTrees": 150, "maxDepth": 10, "minInstancesPerNode": 5},
    "lr": {"C": 0.1},
    "mlp": {"layers": [64, 32], "maxIter": 100},
}

ROWS_PER_PARTITION = 250_000
#: Levels that a category may have to enter a tree as codes (with the code of unseen levels,
#: the bins that Spark's trees have by default); wider categories are encoded.
CODE_LEVELS = 31
#: Folds that are fitted at the same time.
FIT_THREADS = 3

# The reference's model-family names, mapped to the Spark ML family
# that replaces each (boosters -> GBTClassifier, extra trees -> random forest).
MODEL_ALIASES = {"lgbm": "gbt", "xgb": "gbt", "hist_gb": "gbt", "catboost": "gbt", "extra_trees": "rf", "et": "rf",
                 "rf": "rf", "lr": "lr", "gbt": "gbt", "mlp": "mlp"}
#: Families that take numeric columns only.
NUMERIC_ONLY = ("rf", "lr")


def family(model_type: str) -> str:
    if model_type not in MODEL_ALIASES:
        raise ValueError(f"unknown model_type {model_type}")
    return MODEL_ALIASES[model_type]


def _classifier(model_type: str, n_features: int, params: dict, seed: int):
    model_type = family(model_type)
    p = {**DEFAULTS.get(model_type, {}), **(params or {})}
    if model_type == "gbt":
        extra = {}
        if p.pop("early_stopping", False):
            extra = {"validationIndicatorCol": "_is_val", "validationTol": p.pop("validationTol", 0.0001)}
        return GBTClassifier(featuresCol="features", labelCol="_label", seed=seed, **p, **extra)
    if model_type == "rf":
        # Kept node ids: a pass over a level does not walk every row down every tree from the root again (same
        # forest).  They are derived again from at most maxDepth steps if lost, so no copy goes to shared storage.
        kept = {"cacheNodeIds": True, "checkpointInterval": -1}
        return RandomForestClassifier(featuresCol="features", labelCol="_label", seed=seed, **{**kept, **p})
    hidden = p.pop("layers", [64, 32])
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="_label", seed=seed,
                                          layers=[n_features, *hidden, 2], **p)


def _fits_at_once(model_type: str, n_parts: int, cores: int) -> int:
    """How many folds are fitted at the same time.  A forest holds two numbers for each row and tree, so no more
    forests than keep the cores busy."""
    return max(1, min(FIT_THREADS, math.ceil(2 * cores / n_parts))) if family(model_type) == "rf" else FIT_THREADS


def build_pipeline(features: Sequence[str], model_type: str, params: dict | None = None, seed: int = 42) -> Pipeline:
    """Assembler, scaling (E6: StandardScaler for the MLP) and classifier over feature columns
    without NULLs.  Logistic regressions are fitted by ``logistic.fit_logistic``."""
    scaled = family(model_type) == "mlp"
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw" if scaled else "features", handleInvalid="error")]
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    stages.append(_classifier(model_type, len(features), dict(params or {}), seed))
    return Pipeline(stages=stages)


def fold_medians(train: DataFrame, numeric: Sequence[str], ks: Sequence[int], fold: str = "fold") -> DataFrame:
    """E5: (column_name, fold, median): the exact median of each column over the rows outside
    each fold, from one rank selection over all columns: a value's tie row counts it once
    for every fold that does not hold it.  NULL where a column has no value there."""
    long = train.where(F.col(fold).isNotNull()).select(fold, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [fold], list(numeric), "column_name", "_v")
    ties = long.where(F.col("_v").isNotNull()).groupBy("column_name", "_v").agg(
        *[F.count(F.when(F.col(fold) != k, 1)).alias(f"n{k}") for k in ks])
    c = R.cumulative_below(ties, ["column_name"], "_v", [f"n{k}" for k in ks])

    def at(k: int, place: Column) -> Column:
        below = F.col(f"n{k}_below")
        return F.max(F.when((below <= place) & (below + F.col(f"n{k}") > place), F.col("_v")))

    def median(k: int) -> Column:
        last = F.col(f"n{k}_total") - 1
        return (at(k, F.floor(last / 2)) + at(k, F.ceil(last / 2))) / 2

    wide = c.groupBy("column_name").agg(F.array(*[F.struct(F.lit(k).alias("fold"), median(k).alias("median")) for k in ks]).alias("m"))
    return wide.select("column_name", F.inline("m"))


def category_cells(train: DataFrame, c: str, y: str = "y", fold: str = "fold") -> DataFrame:
    """(c, _cells, _all): by fold, and over all folds, of each level: the label's sum (s), labelled rows (n)
    and all rows (m).

    ``_cells`` has one entry per fold, so a level's row is bounded by the number of folds."""
    own = train.where(F.col(c).isNotNull() & F.col(fold).isNotNull())
    cells = own.groupBy(c, fold).agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("s"), F.count(y).alias("n"),
                                     F.count(F.lit(1)).alias("m"))
    return cells.groupBy(c).agg(F.map_from_entries(F.collect_list(F.struct(fold, F.struct("s", "n", "m")))).alias("_cells"),
                                F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("m").alias("m")).alias("_all"))


def _without(c: str, folds: Sequence[Column], field: str) -> Column:
    """Sum over the level's folds except these (NULL: the level has no row)."""
    out = F.col(f"_all_{c}")[field]
    for f in folds:
        out = out - F.coalesce(F.try_element_at(F.col(f"_cells_{c}"), f)[field], F.lit(0))
    return out


class FoldFeatures:
    """Feature columns of each fold, over a training table and others made like it."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], flags: Sequence[str],
                 model_type: str, id_col: str, y: str, fold: str, learned: FoldFeatures | None = None):
        """``learned``: the features of another model family over the same table and columns, whose counts, medians
        and category cells (of folds, not of families) serve again."""
        self.numeric, self.categorical, self.flags = list(numeric), list(categorical), list(flags)
        self.id_col, self.y, self.fold = id_col, y, fold
        self.train, self.medians = train, {}
        if learned:
            self.sizes, self.ks, self.cells = learned.sizes, learned.ks, learned.cells
            self.medians |= learned.medians
        else:
            self._learn(train)
        self.codes = {}
        if family(model_type) not in NUMERIC_ONLY:
            for c, cells in self.cells.items():
                levels = [r[0] for r in cells.select(F.col(c).cast("string")).limit(CODE_LEVELS + 1).collect()]
                if len(levels) <= CODE_LEVELS:  # else the category is encoded
                    self.codes[c] = sorted(levels)

    def _learn(self, train: DataFrame) -> None:
        fold, y = self.fold, self.y
        stats = train.groupBy(fold).agg(F.count(F.lit(1)), F.sum(F.col(y).cast("double")), F.count(y),
                                        *[F.count(c) for c in [*self.categorical, *self.numeric]]).collect()
        self.sizes = {r[0]: tuple(r[1:]) for r in stats if r[0] is not None}
        self.ks = sorted(self.sizes)
        filled = 3 + len(self.categorical)
        # a column without NULLs takes no median (the order of its values is not sought)
        self.learn_medians([c for i, c in enumerate(self.numeric) if any(v[filled + i] < v[0] for v in self.sizes.values())])
        # stored and counted: broadcast up to a bound, so that the training table is not shuffled for them
        self.cells = {c: small(category_cells(train, c, y, fold)) for c in self.categorical}

    def learn_medians(self, columns: Sequence[str]) -> None:
        """The medians (E5) of columns that have NULLs to fill."""
        if columns:
            found = fold_medians(self.train, columns, self.ks, self.fold).collect()
            known = {(r.column_name, r.fold): r["median"] for r in found}
            self.medians |= {(c, k): known.get((c, k)) for c in columns for k in self.ks}

    def fills(self, k: int) -> list[float]:
        """What a NULL of each numeric column becomes in fold k's features; 0 where the fold has no value."""
        found = [self.medians.get((c, k)) for c in self.numeric]
        return [0.0 if v is None else float(v) for v in found]

    def attach(self, df: DataFrame) -> DataFrame:
        """Join the level tables of the encoded categories."""
        for c, cells in self.cells.items():
            if c not in self.codes:
                t = cells.select(F.col(c).alias(f"_level_{c}"), F.col("_cells").alias(f"_cells_{c}"), F.col("_all").alias(f"_all_{c}"))
                df = df.join(t, F.col(c) == F.col(f"_level_{c}"), "left").drop(f"_level_{c}")
        return df

    def columns(self, k: int, training: bool) -> list[Column]:
        """Fold k's features, without NULLs; ``training``: the rows it is fitted on, whose target
        encoding leaves out their own fold as well."""
        n, s, labelled = (sum(self.sizes[j][i] for j in self.ks if j != k) for i in range(3))
        mean = s / labelled if labelled else 0.0
        out = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get((c, k))), F.lit(0.0)).alias(f"_x_{c}") for c in self.numeric]
        out += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x_{c}") for c in self.flags]
        for i, c in enumerate(self.categorical):
            if c in self.codes:
                code = F.array_position(F.array(*map(F.lit, self.codes[c])), F.col(c).cast("string")) if self.codes[c] else F.lit(0)
                # position 0: not found; unseen and NULL share the code after the last
                out.append(F.coalesce(F.nullif(code, F.lit(0)) - 1, F.lit(len(self.codes[c]))).cast("double").alias(f"_x_{c}"))
                continue
            seen = sum(self.sizes[j][3 + i] for j in self.ks if j != k)
            away = [F.lit(k), F.col(self.fold)] if training else [F.lit(k)]
            target = _without(c, away, "s") / F.nullif(_without(c, away, "n"), F.lit(0))
            out.append(F.coalesce(target, F.lit(mean)).alias(f"_x_{c}_target"))
            out.append((F.coalesce(_without(c, [F.lit(k)], "m"), F.lit(0)) / F.lit(float(max(seen, 1)))).alias(f"_x_{c}_freq"))
        return out

    def names(self) -> list[str]:
        cats = [n for c in self.categorical for n in ([f"_x_{c}"] if c in self.codes else [f"_x_{c}_target", f"_x_{c}_freq"])]
        return [f"_x_{c}" for c in [*self.numeric, *self.flags]] + cats


def _positive_prob(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability").getItem(1))


class FoldStore:
    """The features of every fold, computed and stored once for any number of fits on them.

    A row holds the numeric columns and flags once (``_x``: NULLs are filled by the fold's medians when it is
    read) and the category features of each left-out fold k (``_c{k}``): in the rows of fold k as the model
    that left it out scores them, in the others as it is fitted on them.  ``column(k)`` is the array of all
    features of fold k, made of these.  Candidates (feature groups, hyper-parameters, model families of one
    kind) take positions of these arrays.

    Only stores for logistic fits are kept so: the others draw their samples by the places of the rows, which
    depend on what a row holds, and store the arrays themselves."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), flags: Sequence[str] = (),
                 model_type: str = "gbt", id_col: str = "id", y: str = "y", fold: str = "fold", like: FoldStore | None = None):
        """``like``: a store over the same table and columns for another family; what its features learned is not sought again."""
        self.id_col, self.fold, self.shared = id_col, fold, family(model_type) == "lr"
        data = train.where(F.col(fold).isNotNull()).select(id_col, y, fold, *numeric, *categorical, *flags)
        self.feats = FoldFeatures(data, numeric, categorical, flags, model_type, id_col, y, fold, like.feats if like else None)
        self.ks, self.names = self.feats.ks, self.feats.names()
        n_rows = sum(v[0] for v in self.feats.sizes.values())
        # Iterative fits launch one job per iteration, so the task count matters:
        # about ROWS_PER_PARTITION rows per partition, never fewer than a few.
        n_parts = self.n_parts = max(math.ceil(n_rows / ROWS_PER_PARTITION), min(4, parallelism(train.sparkSession)))
        arrays = [F.when(F.col(fold) == k, F.array(*self._stored(k, False))).otherwise(F.array(*self._stored(k, True))).alias(self._name(k))
                  for k in self.ks] if categorical or not self.shared else []
        base = [self._base()] if self.shared else []
        rows = self.feats.attach(data).select(id_col, F.col(fold).cast("int").alias(fold), F.col(y).cast("double").alias("_label"), *base, *arrays)
        self.data = self._read(materialize(rows.repartition(n_parts)), self.ks)

    def _name(self, k: int) -> str:
        return f"_c{k}" if self.shared else self.column(k)

    def _read(self, stored: DataFrame, ks: Sequence[int]) -> DataFrame:
        return stored.select("*", *[self._whole(k) for k in ks]) if self.shared else stored

    def _base(self) -> Column:
        f = self.feats
        return F.array(*[F.col(c).cast("double") for c in f.numeric], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in f.flags]).cast(
            "array<double>").alias("_x")

    def _stored(self, k: int, training: bool) -> list[Column]:
        """What a row holds for fold k alone."""
        return self.feats.columns(k, training)[len(self.feats.numeric) + len(self.feats.flags) if self.shared else 0:]

    def _whole(self, k: int) -> Column:
        f = self.feats
        base = [F.coalesce(F.col("_x")[i], F.lit(v)) for i, v in enumerate(f.fills(k))]
        base += [F.col("_x")[len(f.numeric) + i] for i in range(len(f.flags))]
        own = [F.col(f"_c{k}")[i] for i in range(len(self.names) - len(base))]
        return F.array(*base, *own).alias(self.column(k))

    def label_counts(self) -> dict[int, tuple[int, int, int]]:
        """Labelled rows of each fold, and those labelled 0 and 1."""
        y = F.col("_label")
        found = self.data.groupBy(self.fold).agg(F.count(y), F.count_if(y == 0), F.count_if(y == 1)).collect()
        return {r[0]: tuple(r[1:]) for r in found}

    def layouts(self, ks: Sequence[int]) -> dict[int, LG.Filled | str]:
        """The stored columns of each fold's features, for the logistic fits: what the folds share is passed once."""
        if not self.shared:
            return {k: self.column(k) for k in ks}
        own = bool(self.feats.categorical)
        return {k: LG.Filled("_x", (*self.feats.fills(k), *[0.0] * len(self.feats.flags)), f"_c{k}" if own else None) for k in ks}

    @staticmethod
    def column(k: int) -> str:
        return f"_f{k}"

    def positions(self, numeric: Sequence[str], categorical: Sequence[str] = (), flags: Sequence[str] = ()) -> list[int]:
        """Where the features of these columns are in the arrays."""
        cats = [n for c in categorical for n in ([f"_x_{c}"] if c in self.feats.codes else [f"_x_{c}_target", f"_x_{c}_freq"])]
        return [self.names.index(n) for n in [*(f"_x_{c}" for c in [*numeric, *flags]), *cats]]

    def test_rows(self, test: DataFrame, ks: Sequence[int]) -> DataFrame:
        """(id, arrays) of rows that no fold holds."""
        f = self.feats
        unseen = [c for c in f.numeric if (c, self.ks[0]) not in f.medians] if self.ks else []
        if unseen:  # columns that only these rows have NULLs in
            gone = test.agg(*[F.count_if(F.col(c).isNull()) for c in unseen]).head()
            f.learn_medians([c for c, n in zip(unseen, gone) if n])
        t = f.attach(test.select(self.id_col, *f.numeric, *f.categorical, *f.flags))
        own = [F.array(*self._stored(k, False)).alias(self._name(k)) for k in ks] if f.categorical or not self.shared else []
        return self._read(t.select(self.id_col, *([self._base()] if self.shared else []), *own), ks)


def _long_scores(scored: DataFrame, id_col: str, split: str, fold, names: Sequence[str]) -> DataFrame:
    name = F.get(F.array(*map(F.lit, names)), F.col("_at"))
    return scored.select(id_col, fold, F.posexplode("scores").alias("_at", "score")).select(
        id_col, F.lit(split).alias("split"), name.alias("model"), "fold", "score")


def cv_logistic(store: FoldStore, runs: dict[str, tuple[Sequence[int], dict]], test: DataFrame | None = None,
                folds: Sequence[int] | None = None) -> tuple[DataFrame, list]:
    """M1 for logistic regressions: ``runs`` (name -> feature positions, parameters) on all folds, fitted
    together (``logistic.fit_logistic``).  Returns (predictions as ``cv_train`` gives them, the fits)."""
    ks = list(folds) if folds is not None else store.ks
    by_run, models, features = _fit_runs(store, runs, ks)
    scored = materialize(_own_scores(store, by_run, features, ks))  # a row holds the scores of all runs
    out = _long_scores(scored, store.id_col, "train", F.col(store.fold).alias("fold"), list(runs))
    if test is not None:
        rows = LG.score_logistic(store.test_rows(test, ks), by_run, store.layouts(ks), [store.id_col])
        out = out.unionByName(_long_scores(materialize(rows), store.id_col, "test", F.lit(None).cast("int").alias("fold"), list(runs)))
    return out, models


def _fit_runs(store: FoldStore, runs: dict[str, tuple[Sequence[int], dict]], ks: Sequence[int]) -> tuple[list, list, dict]:
    """(the fits by run and fold, all fits, the features' columns)."""
    features = store.layouts(ks)
    fits = []
    for at, params in runs.values():
        p = {**DEFAULTS["lr"], **(params or {})}
        fits += [LG.Fit(k, float(p["C"]), tuple(at), bool(p.get("standardization", True))) for k in ks]
    models = LG.fit_logistic(store.data, fits, features, "_label", store.fold)
    return [models[i * len(ks):(i + 1) * len(ks)] for i in range(len(runs))], models, features


def _own_scores(store: FoldStore, by_run: list, features: dict, ks: Sequence[int]) -> DataFrame:
    own = store.data.where(F.col(store.fold).isin(list(ks)))
    return LG.score_logistic(own, by_run, features, [store.id_col, store.fold], store.fold)


def cv_train(train: DataFrame | None, numeric: Sequence[str], categorical: Sequence[str] = (),
             flags: Sequence[str] = (), model_type: str = "gbt", params: dict | None = None,
             test: DataFrame | None = None, id_col: str = "id", y: str = "y", fold: str = "fold",
             seed: int = 42, model_name: str | None = None, folds: Sequence[int] | None = None,
             store: FoldStore | None = None) -> DataFrame:
    """M1: out-of-fold scores for ``train`` and fold-averaged scores for ``test``.

    Returns (id, split, model, fold, score): OOF rows carry their fold; test rows
    carry fold = NULL and the mean over the k fold models.  Rows without a label are scored,
    not fitted on; rows without a fold take no part.  The features of all folds are stored in
    shared storage once (the fits read them many times); ``store`` gives those of an earlier
    run, of which the named columns are used.  The test table is read once.
    """
    name = model_name or model_type
    store = store or FoldStore(train, numeric, categorical, flags, model_type, id_col, y, fold)
    at = store.positions(numeric, categorical, flags)
    if family(model_type) == "lr":
        return cv_logistic(store, {name: (at, params)}, test, folds)[0]
    id_col, fold, data, names = store.id_col, store.fold, store.data, [store.names[i] for i in at]
    if family(model_type) == "rf":
        p, ks = {**DEFAULTS["rf"], **(params or {})}, list(folds) if folds is not None else store.ks
        labels = store.label_counts()
        if RF.fits(data.sparkSession, p, labels, ks):
            return cv_forest(store, name, at, p, test, ks, seed, labels)
    extra = [X.hash_sample_pred(id_col, f"val{seed}", 0.1).alias("_is_val")] if params and params.get("early_stopping") else []
    k_list = list(folds) if folds is not None else store.ks

    def columns(k: int) -> list[Column]:
        return [F.col(store.column(k))[i].alias(n) for i, n in zip(at, names)]

    def fit(k: int):
        tr = data.where((F.col(fold) != k) & F.col("_label").isNotNull()).select("_label", *extra, *columns(k))
        return build_pipeline(names, model_type, params, seed).fit(tr)

    at_once = _fits_at_once(model_type, store.n_parts, parallelism(data.sparkSession))
    with ThreadPool(min(at_once, max(1, len(k_list)))) as pool:
        models = pool.map(inheritable_thread_target(data.sparkSession)(fit), k_list)
    out = None
    for k, model in zip(k_list, models):
        rows = data.where(F.col(fold) == k).select(id_col, fold, *columns(k))
        part = _positive_prob(model.transform(rows)).select(id_col, F.lit("train").alias("split"), F.lit(name).alias("model"),
                                                            F.col(fold).alias("fold"), "score")
        out = part if out is None else out.unionByName(part)
    if test is not None:
        t = store.test_rows(test, k_list)
        keep = t.columns
        for i, (k, model) in enumerate(zip(k_list, models)):
            scored = model.transform(t.select("*", *columns(k)))
            keep = [*keep, f"_score{i}"]
            t = _positive_prob(scored, f"_score{i}").select(*keep)
        mean = X.sum_of([f"_score{i}" for i in range(len(k_list))]) / F.lit(float(len(k_list)))
        out = out.unionByName(t.select(id_col, F.lit("test").alias("split"), F.lit(name).alias("model"),
                                       F.lit(None).cast("int").alias("fold"), mean.alias("score")))
    return materialize(out)


def cv_forest(store: FoldStore, name: str, at: Sequence[int], params: dict, test: DataFrame | None, ks: Sequence[int], seed: int,
              labels: dict[int, tuple[int, int, int]]) -> DataFrame:
    """M1 for forests: those of all folds, grown together (``forest.grow``); predictions as ``cv_train`` gives them."""
    i, fold, data = store.id_col, store.fold, store.data

    def features(k: int) -> Column:
        own = F.col(store.column(k))
        return own if list(at) == list(range(len(store.names))) else F.array(*[own[j] for j in at])

    forests, cuts = RF.grow(data, data.rdd.getNumPartitions(), ks, [features(k) for k in ks], len(at), labels, params, seed, fold)
    number = F.array_position(F.array(*map(F.lit, ks)), F.col(fold)) - 1
    own = data.where(F.col(fold).isin(list(ks))).select(
        i, F.col(fold).alias("fold"), number.cast("int").alias("_forest"), F.coalesce(*[F.when(F.col(fold) == k, features(k)) for k in ks]).alias("_x"))
    scored = RF.score(own, [i, "fold"], dict.fromkeys(range(len(ks)), "_x"), forests, cuts, "_forest")
    out = scored.select(i, F.lit("train").alias("split"), F.lit(name).alias("model"), "fold", F.col("scores")[0].alias("score"))
    if test is not None:
        rows = store.test_rows(test, ks).select(i, *[features(k).alias(f"_x{k}") for k in ks])
        scored = RF.score(rows, [i], {j: f"_x{k}" for j, k in enumerate(ks)}, forests, cuts).select(
            i, *[F.col("scores")[j].alias(f"_score{j}") for j in range(len(ks))])
        mean = X.sum_of([f"_score{j}" for j in range(len(ks))]) / F.lit(float(len(ks)))
        out = out.unionByName(scored.select(i, F.lit("test").alias("split"), F.lit(name).alias("model"),
                                            F.lit(None).cast("int").alias("fold"), mean.alias("score")))
    return materialize(out)


def _runs(store: FoldStore, runs: dict[str, tuple[dict, dict]], model_type: str, labels: DataFrame, y: str,
          folds: Sequence[int] | None = None) -> DataFrame:
    """(id, model, fold, score, y): labelled OOF scores of named runs (columns by kind, parameters) over one store.

    Logistic runs are fitted together, and labels join a row of all their scores, not each score."""
    spec = {n: (c.get("numeric", []), c.get("categorical", []), c.get("flags", []), p) for n, (c, p) in runs.items()}
    i, labels = store.id_col, labels.select(store.id_col, y)
    if family(model_type) == "lr":
        ks = list(folds) if folds is not None else store.ks
        by_run, _, features = _fit_runs(store, {n: (store.positions(*s[:3]), s[3]) for n, s in spec.items()}, ks)
        scored = materialize(_own_scores(store, by_run, features, ks).join(labels, i, "inner"))
        name = F.get(F.array(*map(F.lit, spec)), F.col("_at"))
        return scored.select(i, F.col(store.fold).alias("fold"), y, F.posexplode("scores").alias("_at", "score")).select(
            i, name.alias("model"), "fold", "score", y)
    out = None
    for n, s in spec.items():
        part = cv_train(None, *s[:3], model_type, s[3], model_name=n, folds=folds, store=store)
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("split") == "train").drop("split").join(labels, i, "inner")


def oof_auc(preds: DataFrame, labels: DataFrame, id_col: str = "id", y: str = "y",
            keys: Sequence[str] = ("model",)) -> tuple[DataFrame, DataFrame]:
    """A18/A19 over cv_train output: (per-fold AUC, overall OOF AUC)."""
    oof = preds.where(F.col("split") == "train").join(labels.select(id_col, y), id_col, "inner")
    per = A.auc(oof, "score", y, [*keys, "fold"])
    overall = A.auc(oof, "score", y, list(keys))
    return per, overall


def run_configs(train, configs: dict[str, tuple[str, dict]], numeric, categorical=(), flags=(), test=None,
                seed: int = 42, **kw) -> DataFrame:
    """M2: several model configs on the same folds -> long (id, split, model, fold, score, seed)."""
    stores: dict[bool, FoldStore] = {}
    parts = []
    for name, (mt, p) in configs.items():
        kind = family(mt) in NUMERIC_ONLY
        if kind not in stores:
            ids = {c: kw[c] for c in ("id_col", "y", "fold") if c in kw}
            # a store that a forest shares holds its rows as forests need them
            mts = [m for m, _ in configs.values() if (family(m) in NUMERIC_ONLY) == kind]
            stores[kind] = FoldStore(train, numeric, categorical, flags, next((m for m in mts if family(m) != "lr"), mt), **ids,
                                     like=next(iter(stores.values()), None))
        parts.append(cv_train(train, numeric, categorical, flags, mt, p, test, seed=seed, model_name=name, store=stores[kind], **kw))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seed", F.lit(seed))


def multi_seed(train_by_seed: dict[int, DataFrame], configs, numeric, categorical=(), flags=(), test=None,
               id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """M2 per seed (folds re-drawn per seed) then the W3 rank super-ensemble.

    Returns (all predictions, super-ensemble per (split, id))."""
    parts = [run_configs(tr, configs, numeric, categorical, flags, test, seed=s) for s, tr in train_by_seed.items()]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    ens = R.super_ensemble(allp.select(id_col, "split", "seed", "model", "score"), id_col, ["split"])
    return allp, ens


#: The meta-model: C = 1 on the columns as they are.
STACK_PARAMS = {"C": 1.0, "standardization": False}


def _score_matrix(oof: DataFrame, models: Sequence[str], transform: str, id_col: str, seeds: Sequence[int] | None) -> tuple[DataFrame, list[str]]:
    """(id, split, a column per model [and seed]) and those columns' names."""
    src = oof.where(F.col("model").isin(list(models)))
    names = list(models)
    if seeds is not None:
        names = [f"{m}_{s}" for m in models for s in seeds]
        src = src.where(F.col("seed").isin(list(seeds))).withColumn("model", F.concat_ws("_", "model", F.col("seed").cast("string")))
    if transform == "rank":
        src = R.rank01(src, "score", ["split", "model"], out="_s").drop("score").withColumnRenamed("_s", "score")
    elif transform == "logit":
        p = X.clip("score", 1e-6, 1 - 1e-6)
        src = src.withColumn("score", F.log(p / (F.lit(1.0) - p)))
    return by_id(src, id_col, "split").groupBy(id_col, "split").pivot("model", names).agg(F.first("score")), names


def stack_store(oof: DataFrame, labels_folds: DataFrame, models: Sequence[str], transform: str = "raw", id_col: str = "id",
                y: str = "y", fold: str = "fold", seeds: Sequence[int] | None = None) -> tuple[FoldStore, list[str]]:
    """The OOF score matrix as the features of a meta-model."""
    wide, names = _score_matrix(oof, models, transform, id_col, seeds)
    tr = wide.where(F.col("split") == "train").join(labels_folds.select(id_col, y, fold), id_col, "inner")
    return FoldStore(tr, names, model_type="lr", id_col=id_col, y=y, fold=fold), names


def stack(oof: DataFrame, labels_folds: DataFrame, models: Sequence[str], transform: str = "raw",
          id_col: str = "id", y: str = "y", fold: str = "fold", test: DataFrame | None = None,
          seeds: Sequence[int] | None = None) -> DataFrame:
    """Logistic meta-model (C = 1, no scaling) over the OOF score matrix, cross-validated
    on the same folds; ``transform`` = raw | rank (rank / n per model) | logit.

    With ``seeds`` (column ``seed``) every model and seed is a column of its own."""
    wide, names = _score_matrix(oof, models, transform, id_col, seeds)
    tr = wide.where(F.col("split") == "train").join(labels_folds.select(id_col, y, fold), id_col, "inner")
    te = wide.where(F.col("split") == "test") if test is None else test
    return cv_train(tr, names, model_type="lr", params=STACK_PARAMS, test=te, id_col=id_col, y=y, fold=fold,
                    model_name=f"stack_{transform}")


def ablation(train, groups: dict[str, Sequence[str]], numeric, categorical=(), flags=(), model_type="gbt",
             params=None, id_col="id", y="y", labels=None) -> DataFrame:
    """M8: leave-one-group-out CV; (group, auc, delta vs the full feature set).  One store serves all runs."""
    labels = labels if labels is not None else train.select(id_col, y)
    store = FoldStore(train, numeric, categorical, flags, model_type, id_col, y)
    runs = {}
    for g, cols in {"__full__": (), **groups}.items():
        drop = set(cols)
        runs[g] = ({n: [c for c in own if c not in drop] for n, own in
                    (("numeric", numeric), ("categorical", categorical), ("flags", flags))}, params)
    overall = A.auc(_runs(store, runs, model_type, labels, y), "score", y, ["model"])
    full_auc = overall.where(F.col("model") == "__full__").select("auc").scalar()
    return (overall.where(F.col("model") != "__full__")
            .select(F.col("model").alias("group"), "auc", (F.col("auc") - full_auc).alias("delta")))


def tune_scan(train, candidates: dict[str, dict], numeric, categorical=(), flags=(), model_type="gbt",
              id_col="id", y="y", labels=None) -> DataFrame:
    """Every hyper-parameter candidate on the same folds and store -> (candidate, auc), best first."""
    labels = labels if labels is not None else train.select(id_col, y)
    store = FoldStore(train, numeric, categorical, flags, model_type, id_col, y)
    columns = {"numeric": numeric, "categorical": categorical, "flags": flags}
    overall = A.auc(_runs(store, {n: (columns, p) for n, p in candidates.items()}, model_type, labels, y), "score", y, ["model"])
    return overall.select(F.col("model").alias("candidate"), "auc").orderBy(F.desc("auc"), "candidate")


def screen(train, base: dict, candidate: dict, model_type="gbt", params=None, id_col="id", y="y",
           folds: Sequence[int] | None = None) -> DataFrame:
    """M9: baseline vs candidate feature bundle on the same folds -> per-fold deltas.

    ``base`` / ``candidate``: dicts with keys numeric, categorical, flags.
    ``folds=[0]`` gives the single-fold screen."""
    from foldwise.operators.blend import compare_runs

    every = {n: list(dict.fromkeys([*base.get(n, []), *candidate.get(n, [])])) for n in ("numeric", "categorical", "flags")}
    store = FoldStore(train, every["numeric"], every["categorical"], every["flags"], model_type, id_col, y)
    scored = _runs(store, {"baseline": (base, params), "candidate": (candidate, params)}, model_type, train, y, folds)
    return compare_runs(scored, "model", "baseline", "candidate")
