"""Query and SQL of the source divergence audit."""

from __future__ import annotations

from foldwise.llm.common import LOWER, UPPER, sf_table
from foldwise.llm.divergence import audit


def op13_divergence(spark, sf_dir):
    return audit(sf_table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}

ORACLE = {"op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS doc, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                  regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, COALESCE(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n,
                  1 + (CAST(1000000000 AS HUGEINT) * (COALESCE(c.n, 0) + 5)) // (g.total + 5 * s.v) AS p
           FROM groups g JOIN sizes s USING (lang) JOIN kept k USING (lang)
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
          FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(sum(abs(x.p - y.p)), 0) AS value
          FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""}
