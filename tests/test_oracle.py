"""Every SQL-expressible catalog query equals its DuckDB oracle (sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tables import SF_SMALL
from foldwise.plans import catalog
from foldwise.sources.fixtures import BASE_TABLES

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6))
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, got) == _rows(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_iterative():
    missing = sorted(set(QUERIES) - set(ORACLE))
    iterative = {"cv_lr", "cv_rf", "cv_gbt", "cv_mlp", "stack_lr", "stack_ranks", "stack_logit", "isotonic", "ablation",
                 "screen", "tune_scan", "multi_seed"}
    assert set(missing) == iterative


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["x1_quintile", "auc", "n_pos", "n_neg"]
