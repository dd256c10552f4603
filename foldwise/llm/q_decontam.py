"""Queries and SQL on benchmark decontamination."""

from __future__ import annotations

from foldwise.llm.common import LOWER, UPPER, sf_table
from foldwise.llm.decontam import SEPARATORS, contamination


def op5_decontamination(spark, sf_dir):
    return contamination(sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "benchmark"))


_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"

OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w,
         md5(coalesce('i' || CAST(doc_id AS VARCHAR), 'n') || chr(31) || coalesce('t' || text, 'n')) AS row_key
  FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i + 1:i + 10], ' ') AS t, len(w[i + 1:i + 10]) AS n
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes),
hit AS (SELECT p.r, p.s, p.n, win.item FROM p JOIN win ON win.n = p.n AND win.t = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM hit) GROUP BY r),
listed AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT d.doc_id, d.row_key, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, coalesce(items, CAST([] AS VARCHAR[])) AS items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE = {"op5_decontamination": OP5_SQL}
