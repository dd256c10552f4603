"""Catalog step 4: folds, encodings, leakage audit, fold AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import auc as A
from foldwise.operators import encode as EN
from foldwise.operators import folds as FO
from foldwise.plans.common import r6, sql_r6
from foldwise.plans.q_rank import auc_sql
from foldwise.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}

SEED = 42
K = 5


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fold_sql(src: str, seed: int = SEED, k: int = K, y: str = "y") -> str:
    return (f"SELECT *, CAST((row_number() OVER (PARTITION BY {y} ORDER BY md5(CAST(id AS VARCHAR) || '-{seed}'), id)"
            f" - 1) % {k} AS INTEGER) AS fold FROM {src} WHERE {y} IS NOT NULL")


def train_folds(spark, sf):
    tr = FX.obs_events(spark, sf).where(F.col("split") == "train")
    return FO.stratified_folds(tr, "id", "y", K, SEED, store=True)


TRAIN_CTES = [("_tr", "SELECT * FROM obs_events WHERE split = 'train'"), ("_f", fold_sql("_tr"))]


@q("fold_assign")
def fold_assign(spark, sf):
    return train_folds(spark, sf).select("id", "y", "fold")


ORACLE["fold_assign"] = FX.with_views("SELECT id, y, fold FROM _f", "obs_events", extra=TRAIN_CTES)


@q("fold_sizes")
def fold_sizes(spark, sf):
    """Per (class, fold) sizes: differ by at most one within a class."""
    return train_folds(spark, sf).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


ORACLE["fold_sizes"] = FX.with_views("SELECT y, fold, count(*) AS n FROM _f GROUP BY y, fold", "obs_events",
                                     extra=TRAIN_CTES)


@q("freq_encode")
def freq_encode(spark, sf):
    df = FX.obs_events(spark, sf)
    tr = df.where(F.col("split") == "train")
    return _round_doubles(EN.frequency_encode(tr, df, "c2").select("id", "c2_freq_enc"))


ORACLE["freq_encode"] = FX.with_views(
    "SELECT e.id, " + sql_r6("COALESCE(m.freq, 0.0)") + " AS c2_freq_enc FROM obs_events e LEFT JOIN "
    "(SELECT c2, count(*) / (SELECT count(c2) FROM obs_events WHERE split = 'train') AS freq FROM obs_events "
    "WHERE split = 'train' AND c2 IS NOT NULL GROUP BY c2) m ON e.c2 = m.c2", "obs_events")


def _oof_ctes(src_ctes, c, y="y"):
    return src_ctes + [
        ("_cells", f"SELECT {c}, fold, sum(CAST({y} AS DOUBLE)) AS s, count({y}) AS n FROM _f "
                   f"WHERE {c} IS NOT NULL GROUP BY {c}, fold"),
        ("_enc", f"SELECT {c}, fold, (sum(s) OVER (PARTITION BY {c}) - s) / "
                 f"NULLIF(sum(n) OVER (PARTITION BY {c}) - n, 0) AS enc FROM _cells")]


@q("oof_target_encode")
def oof_target_encode(spark, sf):
    out = EN.oof_target_encode(train_folds(spark, sf), "c1")
    return _round_doubles(out.select("id", "fold", "c1_target_enc"))


ORACLE["oof_target_encode"] = FX.with_views(
    "SELECT f.id, f.fold, " + sql_r6("COALESCE(e.enc, (SELECT avg(y) FROM _f))") + " AS c1_target_enc "
    "FROM _f f LEFT JOIN _enc e ON f.c1 = e.c1 AND f.fold = e.fold", "obs_events",
    extra=_oof_ctes(TRAIN_CTES, "c1"))


@q("test_target_encode")
def test_target_encode(spark, sf):
    df = FX.obs_events(spark, sf)
    tr, te = df.where(F.col("split") == "train"), df.where(F.col("split") == "test")
    return _round_doubles(EN.test_target_encode(tr, te, "c1").select("id", "c1_target_enc"))


ORACLE["test_target_encode"] = FX.with_views(
    "SELECT t.id, " + sql_r6("COALESCE(m.te, (SELECT avg(y) FROM obs_events WHERE split = 'train'))")
    + " AS c1_target_enc FROM (SELECT * FROM obs_events WHERE split = 'test') t LEFT JOIN "
    "(SELECT c1, avg(y) AS te FROM obs_events WHERE split = 'train' AND c1 IS NOT NULL GROUP BY c1) m "
    "ON t.c1 = m.c1", "obs_events")

DOC_CTES = [("_tr", "SELECT * FROM obs_docs WHERE split = 'train'"), ("_f", fold_sql("_tr"))]


def doc_folds(spark, sf):
    docs = FX.obs_docs(spark, sf)
    return docs, FO.stratified_folds(docs.where(F.col("split") == "train"), "id", "y", K, SEED, store=True)


@q("oof_target_encode_docs")
def oof_target_encode_docs(spark, sf):
    """E3 on the document table: source -> out-of-fold quality rate."""
    _, tr = doc_folds(spark, sf)
    return _round_doubles(EN.oof_target_encode(tr, "c2").select("id", "fold", "c2_target_enc"))


ORACLE["oof_target_encode_docs"] = FX.with_views(
    "SELECT f.id, f.fold, " + sql_r6("COALESCE(e.enc, (SELECT avg(y) FROM _f))") + " AS c2_target_enc "
    "FROM _f f LEFT JOIN _enc e ON f.c2 = e.c2 AND f.fold = e.fold", "obs_docs",
    extra=_oof_ctes(DOC_CTES, "c2"))


@q("test_target_encode_docs")
def test_target_encode_docs(spark, sf):
    """E2 on the real unlabelled documents."""
    docs = FX.obs_docs(spark, sf)
    tr, te = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    return _round_doubles(EN.test_target_encode(tr, te, "c2").select("id", "c2_target_enc"))


ORACLE["test_target_encode_docs"] = FX.with_views(
    "SELECT t.id, " + sql_r6("COALESCE(m.te, (SELECT avg(y) FROM obs_docs WHERE split = 'train'))")
    + " AS c2_target_enc FROM (SELECT * FROM obs_docs WHERE split = 'test') t LEFT JOIN "
    "(SELECT c2, avg(y) AS te FROM obs_docs WHERE split = 'train' AND c2 IS NOT NULL GROUP BY c2) m "
    "ON t.c2 = m.c2", "obs_docs")


@q("fold_leakage")
def fold_leakage(spark, sf):
    """Identical document texts placed in different folds or in both splits."""
    docs, tr = doc_folds(spark, sf)
    te = docs.where(F.col("split") == "test").withColumn("fold", F.lit(None).cast("int"))
    both = tr.select("id", "text", "split", "fold").unionByName(te.select("id", "text", "split", "fold"))
    return FO.fold_leakage(both, ["text"])


ORACLE["fold_leakage"] = FX.with_views(
    "SELECT count(*) AS n, min(id) AS first_id, count(DISTINCT split) AS n_splits, count(DISTINCT fold) AS n_folds "
    "FROM (SELECT id, text, split, fold FROM _f UNION ALL "
    "SELECT id, text, split, CAST(NULL AS INTEGER) AS fold FROM obs_docs WHERE split = 'test') u "
    "GROUP BY text HAVING count(DISTINCT split) > 1 OR count(DISTINCT fold) > 1", "obs_docs", extra=DOC_CTES)


@q("auc_by_fold")
def auc_by_fold(spark, sf):
    per, _ = A.auc_by_fold(train_folds(spark, sf), "s_a")
    return _round_doubles(per)


def _fold_auc_sql(summary: bool):
    extra, final = auc_sql("_f", ["fold"], "s_a")
    if not summary:
        return FX.with_views(final, "obs_events", extra=TRAIN_CTES + extra)
    raw = final.replace(sql_r6(
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)"),
        "CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE) / NULLIF(CAST(sum(pos) AS DOUBLE)"
        " * CAST(sum(neg) AS DOUBLE) * 2.0, 0)")
    return FX.with_views(f"SELECT {sql_r6('avg(auc)')} AS mean_auc, {sql_r6('stddev_pop(auc)')} AS std_auc, "
                         f"count(auc) AS n_folds FROM ({raw}) z", "obs_events", extra=TRAIN_CTES + extra)


ORACLE["auc_by_fold"] = _fold_auc_sql(False)


@q("auc_fold_summary")
def auc_fold_summary(spark, sf):
    """Mean and population std of the fold AUCs."""
    _, summ = A.auc_by_fold(train_folds(spark, sf), "s_a")
    return _round_doubles(summ)


ORACLE["auc_fold_summary"] = _fold_auc_sql(True)


@q("fold_table_seeds")
def fold_table_seeds(spark, sf):
    """E4 for several seeds: long (id, seed, fold) table, one union."""
    tr = FX.obs_events(spark, sf).where(F.col("split") == "train")
    return FO.fold_table(tr, [42, 100], "id", "y", K)


ORACLE["fold_table_seeds"] = FX.with_views(
    " UNION ALL ".join(f"SELECT id, CAST({s} AS INTEGER) AS seed, fold FROM ({fold_sql('_tr', s)}) f{s}"
                       for s in (42, 100)), "obs_events", extra=[TRAIN_CTES[0]])
