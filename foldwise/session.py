"""Session helpers.

The library never assumes it owns the session: operators take DataFrames and read
settings from ``df.sparkSession``.  ``get_spark`` is for tests, benchmarks and
scripts only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "foldwise") -> SparkSession:
    master = master or os.environ.get("FOLDWISE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("FOLDWISE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOLDWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def parallelism(spark: SparkSession) -> int:
    """Cluster parallelism: the scheduler's default when reachable (classic
    sessions), else ``spark.sql.shuffle.partitions`` (e.g. Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext behind a Connect session
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.  Only
    when it is unset (local tests) a private scratch folder is created.  Behind
    Spark Connect the server's configured folder is used (returns None).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        return None
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            # one process only; elsewhere (local-cluster too) executors do not share a machine-local folder
            raise RuntimeError("spark.checkpoint.dir must name shared storage (HDFS/S3/...) on a cluster")
        conf = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder name (URI) that nothing else uses, below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Cut lineage: reliable checkpoint into ``spark.checkpoint.dir`` (shared storage
    on a cluster), so a nested computation plans and runs against the stored
    result instead of re-deriving it; survives executor loss, unlike a local
    checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables up to this number of rows are broadcast, after they were stored and counted.
BROADCAST_ROWS = 100_000


def small(df, rows: int = BROADCAST_ROWS):
    """Store a table that is expected to be small, count it, and mark it for broadcast up to
    ``rows`` rows; a larger one is joined by a shuffle."""
    stored = materialize(df)
    return F.broadcast(stored) if stored.count() <= rows else stored


#: Rows of a task that holds a group for each id.
ROWS_PER_TASK = 1_000_000


def by_id(df, *keys: str):
    """Repartition by keys that hardly repeat, before a grouping by them: tasks of about ``ROWS_PER_TASK`` rows.

    Adaptive execution sizes tasks by compressed bytes, of which ids and scores take few, so that the hash
    table of a task grew with the input.  With the rows in place there is no partial aggregate either, which would
    hold a group for each row of a map task.  Tables of one such task are left as they are."""
    n = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(max(n, parallelism(df.sparkSession)), *keys) if n > 1 else df


def recommended_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
                     max_partitions: int = 1_000_000) -> dict[str, str]:
    """Cluster settings sized to the input, for a cluster session builder.

    The large shuffles of this library (tie tables, window inputs, fold and
    encoding joins) carry roughly the scanned columns, so the shuffle partition
    count follows the input at ~256 MB per partition (100 TB -> ~400k).
    Ranges follow ``spark.sql.shuffle.partitions`` too (see ranks.range_buckets).
    """
    parts = max(200, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        # broadcast only what AQE measured as small
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
