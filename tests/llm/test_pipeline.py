"""The pipeline against a plain version of each stage."""

import random
import struct
import zlib

import pytest

from foldwise.llm import mixing
from foldwise.llm import tokens as tk
from test_decontam import slow as slow_contamination
from test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(8)
    en, fr = "the that with this from have were they which then".split(), "le la les des une est dans pour avec où".split()

    def prose(words, n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "é", "xi", "ob"]) for _ in range(n))
    items = [(i, prose(en, 14)) for i in range(6)]
    rows = [(i, prose(en if i % 3 else fr, rng.choice([6, 40, 90])), "en" if i % 3 else "fr", "a" if i % 4 else "b", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2], "c", 0) for i in range(10)]  # exact copies
    rows += [(300 + i, prose(en, 20) + " " + items[i][1] + ".", "en", "a", 0) for i in range(6)]  # benchmark passages
    rows += [(400, None, "en", "a", 0), (401, "12 34", "en", "a", 0), (402, "", None, None, 0), (403, prose(en, 30), "en", None, 0),
             (404, "the with that " * 2000, "en", "b", 0)]
    folder = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_and_run(spark, world):
    import corpus_pipeline as cp

    folder, rows, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.checkpoint()
        kept.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    texts = {r[0]: r[1] for r in rows}
    assert [i for i, _ in kept[0]] == [i for i in sorted(texts) if i not in (400, 401, 402)]
    ids = [i for i, _ in kept[0]]
    roots = slow_components([slow_fingerprint(texts[i]) for i in ids])
    assert [i for i, _ in kept[1]] == sorted({ids[r] for r in roots})
    dirty = {r[0] for r in slow_contamination(kept[1], items) if r[-1]}
    assert {300 + i for i in range(6)} <= dirty
    assert kept[2] == [x for x in kept[1] if x[0] not in dirty]
    assert {x[0] for x in kept[3]} == {x[0] for x in kept[2]}  # mixing repeats, and drops none
    again = mixing.mix(spark.createDataFrame([next(r for r in rows if r[0] == i) for i, _ in kept[2]], docs.schema)).select("row.doc_id").collect()
    assert sorted(r.doc_id for r in again) == [x[0] for x in kept[3]]
    enc, want, at = tk.Encoder(tk.tokenizer_path()), [], 0
    for i, text in kept[3]:
        ids = [*enc.encode(text), 2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert [tuple(r) for r in cp.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()] == want
    assert [tuple(r) for r in cp.run(spark, folder).orderBy("start").collect()] == want


def test_empty_documents(spark, world, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{world[0]}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert cp.run(spark, folder).count() == 0


def test_five_stages_each_call_their_operator():
    import corpus_pipeline as cp

    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_output"]
