"""A corpus pipeline from ``documents`` to token files.

Each stage takes what the one before kept, written as Parquet in shared storage, and
applies one corpus operator with its production parameters.  Stages before the last
return the columns of ``documents``.
"""

from __future__ import annotations

from foldwise.llm.common import new_dir, sf_table, ship
from foldwise.llm.decontam import clean
from foldwise.llm.langid import known_language, train
from foldwise.llm.mixing import mix
from foldwise.llm.q_lang import held_out
from foldwise.llm.simhash import one_per_group
from foldwise.llm.token_files import token_table


def language(spark, docs, sf_dir):
    """Documents whose language the classifier tells; null texts and those without letters go."""
    return known_language(docs, train(docs, ~held_out()))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group: that with the smallest doc_id."""
    return one_per_group(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    return clean(docs, sf_table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Documents repeated to the target mixture; every document is used at least once."""
    return mix(docs).select("row.*")


def token_output(spark, docs, sf_dir):
    """Token files, and what reading them back gives for each document."""
    return token_table(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", token_output)]

#: Character n-grams, hash permutations and byte-pair merges are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    ship(spark)
    docs = sf_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
