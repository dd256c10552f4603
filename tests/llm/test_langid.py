import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import langid as li
from foldwise.llm import q_lang


def test_letters():
    def s(text):
        return "".join(map(chr, li.letters(text)))
    assert s("It's  É9x!") == " it s é x "
    assert s("") == s("12 !") == ""
    assert s("a") == " a "


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdé. "), 5000))
    m = li.Model(["x", "y"], np.log([0.5, 0.5]), rng.normal(size=(2, 1 << 10)).astype(np.float32), 10)
    whole, seen = m.scores([text, None, "", "7", "é"])
    parts, _ = m.scores([text, None, "", "7", "é"], most=37)
    grams = li.ngrams(li.letters(text), 10)
    assert np.allclose(whole, parts) and seen.tolist() == [True, False, False, False, True]
    # the two characters that end a text begin no n-gram of three, so parts hold all n-grams once
    assert np.allclose(whole[0], np.log(0.5) + m.log_prob.astype(float)[:, grams].sum(1))


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, x, lang, None, None) for i, (x, lang) in enumerate(
        [("the cat and the hat", "en"), ("this is that", "en"), ("le chat et la souris", "fr"), ("où est le café", "fr")] * 10)]
    rows += [(100, None, "en", None, None), (101, "the", None, None, None), (102, "", "fr", None, None), (None, "the hat", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_naive_bayes_by_hand(toy):
    m = li.train(toy, bits=10)
    counts = np.full((2, 1 << 10), 0.5)
    for r in toy.where("lang is not null and text is not null").collect():
        np.add.at(counts[["en", "fr"].index(r.lang)], li.ngrams(li.letters(r.text), 10), 1)
    assert m.languages == ["en", "fr"]
    assert np.allclose(m.log_prob, np.log(counts / counts.sum(1, keepdims=True)), atol=1e-5)
    assert np.allclose(np.exp(m.log_prior), [21 / 42, 21 / 42])


def test_predictions_and_edges(toy):
    m = li.train(toy)
    df = toy.sparkSession.createDataFrame([(1, "the hat"), (2, "la souris"), (3, None), (4, "42 !"), (None, "où est"), (1, "the hat")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in li.predict(df, m).collect()]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "fr"), (1, "en")]
    assert all(0 <= r.score <= 1 for r in li.predict(df, m).collect())
    empty = li.train(toy.where("false"))
    assert {r.lang_pred for r in li.predict(df, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        li.predict(df.withColumn("score", F.lit(1)), m)
    with pytest.raises(ValueError):
        li.train(toy, max_buckets=10)


def test_known_language_keeps_rows_and_columns(toy):
    clash = toy.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y")).withColumn("row", F.lit(1))
    out = li.known_language(clash, li.train(toy))
    assert out.columns == clash.columns
    assert {r.doc_id for r in toy.collect()} - {r.doc_id for r in out.collect()} == {100, 102}


def test_bounded_sample(toy):
    m = li.train(toy, rows_per_language=5)
    assert m.languages == ["en", "fr"] and np.allclose(np.exp(m.log_prior), 0.5)


def test_ties_go_to_the_first_name(spark):
    same = spark.createDataFrame([(i, "the cat", lang) for i, lang in enumerate(["b", "a"] * 5)], "doc_id long, text string, lang string")
    out = li.predict(same, li.train(same)).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("a", 0.5)}


def test_long_and_repeated_texts_through_the_query(spark, toy, tmp_path):
    """Texts of many parts, equal rows and columns of clashing names get what they get alone; no rows give none."""
    long = "le chat et la souris " * (3 * li.PART // 20)
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("le chat et la souris", "fr")] * 20)]
    rows += [(500, long, None, None, None)] * 3 + [(501, "the " + long, None, None, None)]
    spark.createDataFrame(rows, toy.schema).withColumn("held_out", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    out = q_lang.op1_language_id(spark, str(tmp_path))
    got = [r for r in out.collect() if r.doc_id >= 500]
    assert len(got) == 4 and {r.lang_pred for r in got} == {"fr"} and len({r.score for r in got if r.doc_id == 500}) == 1
    folder = tmp_path / "none"
    spark.createDataFrame([], toy.schema).write.parquet(str(folder / "documents.parquet"))
    assert q_lang.op1_language_id(spark, str(folder)).collect() == []


def test_held_out_accuracy(spark):
    out = q_lang.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
