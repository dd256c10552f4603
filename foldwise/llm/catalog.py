"""Queries and SQL of the corpus operators."""

from __future__ import annotations

import functools

from foldwise.llm import q_bpe, q_decontam, q_dedup, q_lang, q_licenses, q_mix, q_pages, q_sources, q_tokens, q_vectors
from foldwise.llm.common import ship

MODULES = (q_lang, q_mix, q_pages, q_dedup, q_decontam, q_tokens, q_vectors, q_licenses, q_bpe, q_sources)


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)
    return run


def queries():
    return {k: _shipped(v) for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
