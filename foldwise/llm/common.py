"""Shared helpers of the corpus operators: row keys, shared folders, text columns."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import checkpoint_dir, materialize

__all__ = ["ascii_lower", "materialize", "new_dir", "open_fs", "row_key", "sf_table", "ship", "token_count"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, as ``--py-files`` would:
    the functions that run there import it."""
    sc = spark.sparkContext
    if getattr(sc, "_foldwise_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="foldwise-")  # on the driver; Spark serves the file from there
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "foldwise"), "zip", os.path.dirname(package), os.path.basename(package)))
    sc._foldwise_shipped = True


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name (URI) below ``spark.checkpoint.dir``, the storage that the
    driver and all executors share."""
    base = checkpoint_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(file system, path) of a folder or file in shared storage; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the fast form of the same for pure ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a (doc_id, text) row: rows share it only if both are equal (null is a value)."""
    return F.md5(F.concat(
        F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit("\x1f"),
        F.coalesce(F.concat(F.lit("t"), text), F.lit("n"))))


def token_count(text: Column) -> Column:
    """Number of white-space separated words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")
