"""Query on near-duplicates."""

from __future__ import annotations

from foldwise.llm.common import sf_table
from foldwise.llm.simhash import near_duplicates


def op4_simhash_groups(spark, sf_dir):
    return near_duplicates(sf_table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_groups": op4_simhash_groups}
ORACLE: dict[str, str] = {}
