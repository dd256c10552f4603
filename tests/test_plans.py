"""Plan-shape guards over the catalog: no cross joins anywhere, and the forced
scale path really windows on (keys, bucket)."""

import pytest

from tables import SF_SMALL
from foldwise.operators import auc as A
from foldwise.plans import catalog
from foldwise.sources import fixtures as FX

QUERIES = catalog.queries()
ITERATIVE = {"cv_lr", "cv_rf", "cv_gbt", "cv_mlp", "stack_lr", "stack_ranks", "stack_logit", "isotonic",
             "ablation", "screen", "tune_scan", "multi_seed"}
#: Keys with SQL whose fits run in Arrow or pandas functions inside tasks.
FITTED = {"isotonic_fit", "lr_certificate", "stack_certificate", "stack_rows"}


def _executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapCoGroupsInPandas", "AggregateInPandas")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE - FITTED))
def test_no_cross_join_no_python(spark, name):
    plan = _executed_plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not any(node in plan for node in PYTHON_NODES)  # everything stays JVM-side


def test_bucketed_auc_windows_on_bucket(spark):
    df = FX.obs_events(spark, SF_SMALL)
    plan = _executed_plan(A.auc(df, "s_a", keys=["c1"], buckets=16))
    assert "_bkt" in plan and "Window" in plan


def _read_schemas(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [seg.split("]")[0] for seg in plan.split("ReadSchema: ")[1:]]


def test_scans_read_only_referenced_columns(spark):
    schemas = _read_schemas(QUERIES["label_scan"](spark, SF_SMALL))
    assert schemas and all(s.startswith("struct<event_id:bigint,value:double>") for s in schemas)
    schemas = _read_schemas(QUERIES["schema_advisor"](spark, SF_SMALL))
    assert schemas and all("l_returnflag" not in s and "l_shipdate" not in s for s in schemas)
