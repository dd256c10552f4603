"""Scoring-time feature application on a Structured Streaming DataFrame.

The reference has no streaming operator.  What carries over to a stream is the
row-local part of the feature spec (P4-P12, W6) and the lookup of encodings that
were FITTED on the static labelled table (E1, E2): both are stateless, so a
micro-batch never needs state, watermarks or a shuffle -- the fitted maps join
as stream-static LEFT joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import encode as EN
from foldwise.operators.features import FeatureSpec
from foldwise.session import materialize


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def apply_spec(stream: DataFrame, spec: FeatureSpec, keep: Sequence[str]) -> DataFrame:
    """Row-local features: one projection per micro-batch."""
    return spec.apply(stream, keep=keep)


def apply_encodings(stream: DataFrame, train: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """E1 + E2 fitted on the static labelled table, looked up per streaming row.

    The global-mean fallback is fitted once (one scalar) and shipped as a literal;
    the maps are fitted once and stored (a stream-static join re-evaluates its
    static side every micro-batch, which would re-aggregate the whole labelled
    table), then joined stream-static (LEFT) on the category.
    """
    g = train.agg(F.avg(y)).collect()[0][0]
    out = stream
    for c in cols:
        fm = materialize(EN.frequency_map(train, c))
        tm = materialize(EN.target_map(train, c, y))
        out = (out.join(fm, c, "left").join(tm, c, "left")
               .withColumn(f"{c}_freq_enc", F.coalesce(F.col("_freq"), F.lit(0.0)))
               .withColumn(f"{c}_target_enc", F.coalesce(F.col("_te"), F.lit(g)))
               .drop("_freq", "_te"))
    return out


def run_to_memory(df: DataFrame, name: str, checkpoint: str):
    """Drive a streaming query to completion into a memory table (tests / smoke)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
