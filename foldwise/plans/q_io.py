"""Catalog step 8: sources and sinks (S1-S8), written to a fresh folder of shared storage and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.plans.common import r6, sql_r6
from foldwise.session import fresh_folder
from foldwise.sources import fixtures as FX
from foldwise.sources import io as IO

QUERIES: dict = {}
ORACLE: dict = {}

COLUMNS = "id bigint, x1 double, x2 double, c1 string, s_a double"


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round_doubles(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: NaN and infinities on fixed rows, beside the view's NULLs.
_ODD = "CASE WHEN id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE s_a END"


def _csv(spark, sf, split, label):
    """A split of the observations as CSV, with two lines that fit no schema in every file's place."""
    folder = fresh_folder(spark, f"csv-{split}")
    rows = FX.obs_events(spark, sf).where(F.col("split") == split).withColumn("s_a", F.expr(_ODD))
    text = rows.select(*[F.col(c).cast("string") for c in ("id", "x1", "x2", "c1", "s_a")], *([F.col("y").cast("string")] if label else []))
    broken = text.where(F.col("id").cast("long") % 97 == 3).select(F.concat(F.lit("row "), "id").alias("id"), *text.columns[1:])
    text.unionByName(broken).write.option("header", True).csv(folder)
    return IO.read_csv(spark, folder, COLUMNS + (", y int" if label else ""))


@q("csv_labelled")
def csv_labelled(spark, sf):
    """Labelled CSV with an explicit schema; NaN and empty fields are NULL, broken lines are set apart."""
    return _round_doubles(_csv(spark, sf, "train", True)[0])


ORACLE["csv_labelled"] = FX.with_views(
    f"SELECT id, {sql_r6('x1')} AS x1, {sql_r6('x2')} AS x2, c1, CASE WHEN id % 23 <> 0 THEN {sql_r6('s_a')} END AS s_a, y "
    "FROM obs_events WHERE split = 'train'", "obs_events")


@q("csv_unlabelled")
def csv_unlabelled(spark, sf):
    """The unlabelled table, its rows and its broken lines counted by group."""
    good, broken = _csv(spark, sf, "test", False)
    rows = good.groupBy("c1").agg(F.count(F.lit(1)).alias("n"), F.count("x1").alias("n_x1"), F.count("s_a").alias("n_s_a"), F.avg("s_a").alias("mean"))
    bad = broken.groupBy(F.lit("broken").alias("c1")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_x1"), F.lit(0).cast("long").alias("n_s_a"), F.lit(None).cast("double").alias("mean"))
    return _round_doubles(rows.unionByName(bad))


ORACLE["csv_unlabelled"] = FX.with_views(
    f"SELECT c1, count(*) AS n, count(x1) AS n_x1, count(CASE WHEN id % 23 <> 0 THEN s_a END) AS n_s_a, "
    f"{sql_r6('avg(CASE WHEN id % 23 <> 0 THEN s_a END)')} AS mean FROM obs_events WHERE split = 'test' GROUP BY c1 "
    "UNION ALL SELECT 'broken', count(*), 0, 0, NULL FROM obs_events WHERE split = 'test' AND id % 97 = 3 HAVING count(*) > 0", "obs_events")


def _written(spark, sf):
    """All predictions, then two partitions again with other scores."""
    folder = fresh_folder(spark, "predictions")
    p = FX.preds(spark, sf)
    IO.write_predictions(p, folder)
    again = p.where((F.col("seed") == 100) & (F.col("model") == "m_c")).withColumn("score", F.col("score") + 1)
    return folder, IO.write_predictions(again, folder)


@q("prediction_sink")
def prediction_sink(spark, sf):
    """Dynamic partition overwrite; the manifest lists what each partition holds, and agrees with it."""
    folder, manifest = _written(spark, sf)
    wrong = IO.check_predictions(spark, folder).select("split", "seed", "model", F.lit(1).alias("wrong"))
    return manifest.join(wrong, ["split", "seed", "model"], "left").select("split", "seed", "model", "n", F.coalesce("wrong", F.lit(0)).alias("wrong"))


ORACLE["prediction_sink"] = FX.with_views("SELECT split, seed, model, count(*) AS n, 0 AS wrong FROM preds GROUP BY split, seed, model", "preds")


@q("prediction_source")
def prediction_source(spark, sf):
    """Partitions read back by name, one of them replaced; absent ones give no row."""
    folder, _ = _written(spark, sf)
    found = [IO.read_predictions(spark, folder, split="test", seed=s, model=m) for s, m in ((42, "m_a"), (100, "m_c"), (7, "m_a"))]
    found.append(IO.read_predictions(spark, folder + "-absent"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _round_doubles(out)


ORACLE["prediction_source"] = FX.with_views(
    f"SELECT id, {sql_r6('CASE WHEN seed = 100 THEN score + 1 ELSE score END')} AS score, split, seed, model FROM preds "
    "WHERE split = 'test' AND ((seed = 42 AND model = 'm_a') OR (seed = 100 AND model = 'm_c'))", "preds")


@q("scored_csv")
def scored_csv(spark, sf):
    """Scores clipped to [0, 1] as text; a missing or NaN score is an empty field."""
    folder = fresh_folder(spark, "scored")
    rows = FX.obs_events(spark, sf).where(F.col("split") == "test").select("id", (F.expr(_ODD) / 100 - F.lit(0.1)).alias("score"), "x1")
    IO.write_scored_csv(rows.withColumn("score", F.when(F.col("x1").isNotNull(), F.col("score"))), folder, "label")
    back = spark.read.option("header", True).schema("id bigint, label string").csv(folder)
    return back.select("id", r6(F.col("label").cast("double")).alias("label"), F.col("label").isNull().cast("int").alias("empty"))


ORACLE["scored_csv"] = FX.with_views(
    "SELECT id, CASE WHEN id % 23 <> 0 AND x1 IS NOT NULL THEN " + sql_r6("greatest(least(s_a / 100 - 0.1, 1.0), 0.0)") + " END AS label, "
    "CAST(id % 23 = 0 OR x1 IS NULL AS INTEGER) AS empty FROM obs_events WHERE split = 'test'", "obs_events")


def _records(spark, sf):
    """One JSON record per c1: fold means as an array for some, by model for others, one number for the rest."""
    ev = FX.obs_events(spark, sf).where(F.col("c1").isNotNull())
    cells = ev.groupBy("c1", (F.col("id") % 3).cast("int").alias("fold")).agg(F.round(F.avg("s_a"), 4).alias("a"), F.round(F.avg("s_b"), 4).alias("b"))
    by_fold = F.array_sort(F.collect_list(F.struct("fold", "a", "b")))
    g = cells.groupBy("c1").agg(by_fold.alias("f"))
    a, b = F.transform("f", lambda x: x["a"]), F.transform("f", lambda x: x["b"])
    doc = (F.when(F.length("c1") % 3 == 0, F.to_json(F.struct(F.col("c1").alias("id"), a.alias("fold_auc"))))
           .when(F.length("c1") % 3 == 1, F.to_json(F.struct(F.col("c1").alias("id"), F.struct(a.alias("m_a"), b.alias("m_b")).alias("fold_auc"))))
           .otherwise(F.to_json(F.struct(F.col("c1").alias("id"), a[0].alias("fold_auc")))))
    return g.select("c1", doc.alias("doc"))


@q("metric_records")
def metric_records(spark, sf):
    """S4 + S8: records of three shapes written as JSON text, read back as VARIANT, looked up at one path."""
    folder = fresh_folder(spark, "records")
    _records(spark, sf).select("doc").write.text(folder)
    docs = IO.parse_records(spark.read.text(folder), "value").select(F.variant_get("record", "$.id", "string").alias("c1"), "record")
    return _round_doubles(IO.variant_values(docs, "record", "$.fold_auc", ["c1"]))


ORACLE["metric_records"] = FX.with_views(
    "SELECT c1, CASE WHEN length(c1) % 3 = 1 THEN m END AS key, CASE WHEN length(c1) % 3 = 2 THEN 0 ELSE fold END AS pos, " + sql_r6("round(v, 4)")
    + " AS value FROM (SELECT c1, CAST(id % 3 AS INTEGER) AS fold, 'm_a' AS m, avg(s_a) AS v FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1, id % 3 "
    "UNION ALL SELECT c1, CAST(id % 3 AS INTEGER), 'm_b', avg(s_b) FROM obs_events WHERE c1 IS NOT NULL GROUP BY c1, id % 3) z "
    "WHERE length(c1) % 3 = 1 OR (m = 'm_a' AND (length(c1) % 3 = 0 OR fold = 0))", "obs_events")


@q("metrics_sink")
def metrics_sink(spark, sf):
    """A run's nested metrics, one document, read back by path."""
    folder = fresh_folder(spark, "metrics")
    # one number per seed and model: a run's report, not data
    rows = FX.preds(spark, sf).groupBy("seed", "model").agg(F.avg("score").alias("v")).collect()
    tree: dict = {}
    for r in rows:
        tree.setdefault(str(r.seed), {})[r.model] = [r.v]
    IO.write_metrics(spark, {"seed_results": tree}, folder)
    docs = IO.parse_records(spark.read.text(folder), "value")
    parts = [IO.variant_values(docs, "record", f"$.seed_results.{s}").select(F.lit(s).alias("seed"), F.col("key").alias("model"), "value") for s in (42, 100)]
    return _round_doubles(parts[0].unionByName(parts[1]))


ORACLE["metrics_sink"] = FX.with_views(f"SELECT seed, model, {sql_r6('avg(score)')} AS value FROM preds GROUP BY seed, model", "preds")
