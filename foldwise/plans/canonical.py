"""The canonical end-to-end run as one function:

scan -> canonical features (one projection) -> folds per seed -> configs x folds x
seeds fits -> rank within seed -> re-rank across seeds -> AUCs -> sinks
(partitioned prediction parquet, clipped scored CSV, metrics JSON).

Only metric rows (a few per model / seed / fold) reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import auc as A
from foldwise.operators import features as FE
from foldwise.operators import folds as FO
from foldwise.operators import models as M
from foldwise.operators import ranks as R
from foldwise.sources import io as IO


def canonical_run(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  roles: Mapping[str, str], configs: dict, seeds: Sequence[int], out_dir: str | None = None,
                  id_col: str = "id", y: str = "y", k: int = 5) -> dict:
    t0 = time.time()
    spark = train.sparkSession
    ftr = FE.build_features(train, id_col, y, numeric, categorical, roles)
    fte = FE.build_features(test, id_col, None, numeric, categorical, roles)
    flags = [c for c in ftr.columns if c.endswith("_isna")]
    num = [c for c in ftr.columns if c not in (id_col, y, *categorical, *flags)]
    by_seed = {s: FO.stratified_folds(ftr, id_col, y, k, s, store=True) for s in seeds}
    allp, ens = M.multi_seed(by_seed, configs, num, list(categorical), flags, test=fte, id_col=id_col)
    labels = train.select(id_col, y)

    oof = allp.where(F.col("split") == "train").join(labels, id_col, "inner")
    per_model = A.auc(oof, "score", y, ["seed", "model"])
    per_fold = A.auc(oof, "score", y, ["seed", "model", "fold"])
    seed_ens = R.rank_average(allp.where(F.col("split") == "train").select(id_col, "seed", "model", "score"),
                              id_col, ["seed"])
    seed_auc = A.auc(seed_ens.join(labels, id_col, "inner"), "score", y, ["seed"])
    super_auc = A.auc(ens.where(F.col("split") == "train").join(labels, id_col, "inner"), "score", y)

    metrics = {
        "n_features": len(num) + len(categorical) + len(flags),
        "seed_results": {},
        "super_ensemble_auc": super_auc.first().auc,
    }
    for r in per_model.collect():
        sr = metrics["seed_results"].setdefault(str(r.seed), {"model_auc": {}, "fold_aucs": {}})
        sr["model_auc"][r.model] = r.auc
    for r in per_fold.orderBy("seed", "model", "fold").collect():
        metrics["seed_results"][str(r.seed)]["fold_aucs"].setdefault(r.model, []).append(r.auc)
    for r in seed_auc.collect():
        metrics["seed_results"][str(r.seed)]["ensemble_auc"] = r.auc
    metrics["runtime_sec"] = round(time.time() - t0, 3)

    if out_dir:
        IO.write_predictions(allp.select(id_col, "score", "split", "seed", "model")
                             .withColumnRenamed(id_col, "id"), f"{out_dir}/predictions")
        IO.write_scored_csv(ens.where(F.col("split") == "test"), f"{out_dir}/submission", y, id_col=id_col)
        IO.write_metrics(spark, metrics, f"{out_dir}/metrics")
    return metrics
