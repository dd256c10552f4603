"""Sources and sinks (S1-S8) and the schema advisor.

* labelled / unlabelled tables: CSV with an explicit schema (no inference pass)
  or parquet; NaN is turned into NULL on ingest so Spark's NaN ordering never
  leaks into ranks or bins;
* prediction tables: hive-partitioned parquet by (split, seed, model), replaced partition by
  partition with a manifest of row counts; readers filter on the partition columns so absent
  partitions are pruned, not scanned;
* scored CSV: probabilities clipped to [0, 1]; written by every task in
  parallel (no coalesce to one file, which would funnel the table through one task);
* metrics: small nested structures written / read as JSON, records of mixed shape as VARIANT.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions import exprs as X

PRED_SCHEMA = "id bigint, score double, split string, seed int, model string"


def nan_to_null_all(df: DataFrame) -> DataFrame:
    return df.select(*[X.nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """Labelled or unlabelled table; ``columns`` prunes at the scan."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return nan_to_null_all(df)


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None,
             corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """S1/S2 for CSV that may hold broken lines: (rows, broken lines).

    A line that does not fit the schema is not dropped and not turned into NULLs: it is in the second table as
    it stands in the file.  An empty field and NaN are NULL."""
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN").option("mode", "PERMISSIVE")
    lines = reader.option("columnNameOfCorruptRecord", corrupt).schema(f"{schema}, {corrupt} string").csv(path)
    names = [f.name for f in lines.schema if f.name != corrupt]
    # a line is only found broken by parsing it whole: the condition, always true, names every column
    lines = lines.where(F.length(F.concat_ws("", *[F.col(n).cast("string") for n in names])) >= 0)
    good = nan_to_null_all(lines.where(F.col(corrupt).isNull()).select(names))
    return (good.select(*columns) if columns else good), lines.where(F.col(corrupt).isNotNull()).select(corrupt)


def write_predictions(preds: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """(id, score) per (split, seed, model) partition; returns the manifest of the commit.

    ``overwrite`` replaces the partitions that ``preds`` holds and leaves the others (dynamic partition
    overwrite); ``append`` adds to them.  The manifest (split, seed, model, n) counts what the partitions hold
    afterwards and is stored beside them: a reader can tell a whole table from one that is being written."""
    (preds.select("id", "score", "split", "seed", "model")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("split", "seed", "model").parquet(path))
    spark = preds.sparkSession
    manifest = spark.read.schema(PRED_SCHEMA).parquet(path).groupBy("split", "seed", "model").agg(F.count(F.lit(1)).alias("n"))
    # a folder whose name starts with _ is no data to readers of the table
    manifest.write.mode("overwrite").json(f"{path.rstrip('/')}/_manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, seed int, model string, n bigint").json(f"{path.rstrip('/')}/_manifest")


def check_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(split, seed, model, n, found): partitions whose rows are not those of the manifest; none in a whole table."""
    found = read_predictions(spark, path).groupBy("split", "seed", "model").agg(F.count(F.lit(1)).alias("found"))
    both = read_manifest(spark, path).join(found, ["split", "seed", "model"], "full")
    return both.where(~F.col("n").eqNullSafe(F.col("found")))


def read_predictions(spark: SparkSession, path: str, split: str | None = None, seed: int | None = None,
                     model: str | None = None) -> DataFrame:
    """Partition-pruned read; a missing table or partition yields no rows
    (local or remote paths alike)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(PRED_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], PRED_SCHEMA)
        raise
    if split is not None:
        df = df.where(F.col("split") == split)
    if seed is not None:
        df = df.where(F.col("seed") == seed)
    if model is not None:
        df = df.where(F.col("model") == model)
    return df


def write_scored_csv(df: DataFrame, path: str, target: str, id_col: str = "id", score: str = "score",
                     mode: str = "overwrite") -> None:
    """Id, clipped probability named ``target``; header on every part file.  A missing score
    is an empty field."""
    (df.select(F.col(id_col).alias("id"), X.clip(score).alias(target))
     .write.mode(mode).option("header", True).csv(path))


def write_metrics(spark: SparkSession, metrics: dict, path: str, mode: str = "overwrite") -> None:
    """One JSON document per call (metrics are small driver-side results)."""
    spark.createDataFrame([(json.dumps(metrics),)], "doc string").write.mode(mode).text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Nested metrics JSON (multi-line files allowed)."""
    return spark.read.option("multiLine", True).json(path)


def parse_records(df: DataFrame, c: str, out: str = "record") -> DataFrame:
    """S4 for records of mixed shape: JSON text as VARIANT; text that is no JSON gives NULL."""
    return df.withColumn(out, F.try_parse_json(F.col(c)))


def variant_values(df: DataFrame, c: str, path: str, keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """(keep..., key, pos, value) of what a VARIANT holds at ``path``, whichever shape it has.

    An array gives its elements with key NULL; an object of arrays gives the elements of each, with the
    member's name as key; a single value is an array of one.  A missing path gives no row, an element
    of another type a NULL value."""
    at = F.try_variant_get(F.col(c), path, "variant")
    found = df.select(*keep, at.alias("_v")).where(F.col("_v").isNotNull())
    kind = F.schema_of_variant("_v")
    spark = df.sparkSession

    def elements(rows: DataFrame, v: str, *names: str) -> DataFrame:
        each = spark.tvf.variant_explode(F.col(v).outer()).withColumnsRenamed(dict(zip(("pos", "key", "value"), names)))
        return rows.lateralJoin(each)

    members = elements(found.where(kind.startswith("OBJECT")), "_v", "_p", "key", "_w").drop("_p", "_v")
    lists = found.where(kind.startswith("ARRAY")).select(*keep, F.lit(None).cast("string").alias("key"), F.col("_v").alias("_w"))
    inner = members.where(F.schema_of_variant("_w").startswith("ARRAY")).select(*keep, "key", "_w").unionByName(lists)
    deep = elements(inner, "_w", "pos", "_k", "_x").select(*keep, "key", "pos", F.try_variant_get("_x", "$", dtype).alias("value"))
    plain = found.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(*keep, F.lit(None).cast("string").alias("key"), F.col("_v").alias("_w"))
    single = members.where(~F.schema_of_variant("_w").startswith("ARRAY")).select(*keep, "key", "_w").unionByName(plain)
    return deep.unionByName(single.select(*keep, "key", F.lit(0).alias("pos"), F.try_variant_get("_w", "$", dtype).alias("value")))


def metric_array(df: DataFrame, path: Sequence[str], name: str = "value") -> DataFrame:
    """S4 path lookup: follow nested field names, then posexplode the array found there."""
    c = F.col(f"`{path[0]}`")
    for p in path[1:]:
        c = c.getField(p)
    return df.select(F.posexplode(c).alias("pos", name))


def schema_advisor(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One min/max pass -> the narrowest type per column (strict bounds).

    Integral columns narrow to byte/short/int/long; floating columns to float;
    strings stay strings (dictionary-encoded by parquet).
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        if types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal"):
            aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"mn{i}"), F.lit(None).cast("double").alias(f"mx{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        t = types[c]
        mn, mx = F.col(f"mn{i}"), F.col(f"mx{i}")
        if t in ("tinyint", "smallint", "int", "bigint"):
            sug = (F.when((mn > -128) & (mx < 127), F.lit("tinyint"))
                   .when((mn > -32768) & (mx < 32767), F.lit("smallint"))
                   .when((mn > -2147483648) & (mx < 2147483647), F.lit("int"))
                   .otherwise(F.lit("bigint")))
        elif t in ("float", "double"):
            sug = F.lit("float")
        else:
            sug = F.lit(t)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), mn.alias("min"),
                             mx.alias("max"), sug.alias("suggested")))
    return wide.select(F.inline(F.array(*rows)))


def json_path(c: str, path: str, dtype: str = "double"):
    """S4 path lookup on a JSON string column (``$.a.b`` syntax), typed."""
    return F.get_json_object(F.col(c), path).cast(dtype)
