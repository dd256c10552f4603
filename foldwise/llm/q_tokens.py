"""Queries on token counts and token files."""

from __future__ import annotations

from foldwise.llm.common import sf_table
from foldwise.llm.token_files import token_table
from foldwise.llm.tokens import count_tokens


def op6_token_counts(spark, sf_dir):
    return count_tokens(sf_table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    return token_table(sf_table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts, "op9_token_files": op9_token_files}
ORACLE: dict[str, str] = {}
