"""Observation views over the driver tables.

The driver tables carry no NULLs and no binary target, so each view plants
missingness with CASE expressions (every row is kept), derives a 0/1 label and
deterministic "model scores".  The SQL text is shared verbatim by the Spark side
and the DuckDB oracle, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

OBS_EVENTS_SQL = """
SELECT event_id AS id, user_id, value,
  CASE WHEN event_id % 7  = 0 THEN NULL ELSE value END AS x1,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS x2,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37) % 24 AS DOUBLE) END AS x3,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS c1,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(user_id % 7 AS STRING) END AS c2,
  CASE WHEN value + (event_id * 7919) % 101 > 100 THEN 1 ELSE 0 END AS y,
  value * 0.7 + (event_id * 31) % 97 AS s_a,
  value * 0.4 + (event_id * 53) % 89 AS s_b,
  round(value, 0) AS s_c,
  CASE WHEN event_id % 10 < 7 THEN 'train' ELSE 'test' END AS split
FROM events
"""

OBS_ORDERS_SQL = """
SELECT o.o_orderkey AS id, o.o_orderpriority AS c1, o.o_orderstatus AS c2,
  CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  l.n_lines, l.qty_total, l.qty_a, l.qty_n, l.qty_r, l.price_total, l.price_max, l.price_min
FROM orders o LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty_total,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS qty_a,
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qty_n,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS qty_r,
    sum(l_extendedprice) AS price_total, max(l_extendedprice) AS price_max,
    min(l_extendedprice) AS price_min
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""

OBS_DOCS_SQL = """
SELECT d.doc_id AS id, d.lang AS c1, d.source AS c2, d.n_chars, d.text,
  b.quality AS y, b.toxic,
  CASE WHEN b.doc_id IS NULL THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id
"""

# Long-form prediction table: three deterministic "models" for two seeds.
PREDS_SQL = """
SELECT id, 42 AS seed, 'm_a' AS model, split, s_a AS score FROM obs_events
UNION ALL SELECT id, 42 AS seed, 'm_b' AS model, split, s_b AS score FROM obs_events
UNION ALL SELECT id, 42 AS seed, 'm_c' AS model, split, s_c AS score FROM obs_events
UNION ALL SELECT id, 100 AS seed, 'm_a' AS model, split, s_a + CAST((id * 17) % 5 AS DOUBLE) AS score FROM obs_events
UNION ALL SELECT id, 100 AS seed, 'm_b' AS model, split, s_b + CAST((id * 17) % 5 AS DOUBLE) AS score FROM obs_events
UNION ALL SELECT id, 100 AS seed, 'm_c' AS model, split, s_c + CAST((id * 17) % 5 AS DOUBLE) AS score FROM obs_events
"""

VIEW_SQL = {
    "obs_events": OBS_EVENTS_SQL,
    "obs_orders": OBS_ORDERS_SQL,
    "obs_docs": OBS_DOCS_SQL,
}


def with_views(sql: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named observation views (oracle side),
    followed by ``extra`` (name, body) CTEs."""
    parts = []
    for v in views:
        if v == "preds" and "obs_events" not in views:
            parts.append(f"obs_events AS ({OBS_EVENTS_SQL})")
        body = PREDS_SQL if v == "preds" else VIEW_SQL[v]
        parts.append(f"{v} AS ({body})")
    for name, body in extra or []:
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _register_base(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register_base(spark, sf_dir, ["events"])
    return spark.sql(OBS_EVENTS_SQL)


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register_base(spark, sf_dir, ["orders", "lineitem"])
    return spark.sql(OBS_ORDERS_SQL)


def obs_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register_base(spark, sf_dir, ["documents", "labels"])
    return spark.sql(OBS_DOCS_SQL)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seed, model, split, score) long-form predictions over obs_events."""
    obs_events(spark, sf_dir).createOrReplaceTempView("obs_events")
    return spark.sql(PREDS_SQL)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, split) label table of obs_events, the other side of prediction joins."""
    return obs_events(spark, sf_dir).select("id", "y", "split")
