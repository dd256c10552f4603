"""foldwise: Spark-native feature building, leakage-safe encoding, fold assignment,
rank/AUC analytics, ensembling and data forensics for wide, null-bearing tables
with a binary target.

Every operator is a ``DataFrame -> DataFrame`` transformation expressed with the
DataFrame / SQL API so Catalyst can push filters, prune columns and plan joins.
"""

from foldwise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
