import hashlib
import random
import re

import pytest

from foldwise.llm import decontam as dc


def slow_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items, window=10):
    wins = set()
    for item, text in items:
        w = slow_words(text)
        wins |= {(item, tuple(w[i:i + window])) for i in range(max(len(w) - window, 0) + 1)} if w else set()
    out = []
    for i, text in docs:
        w, hit, names = slow_words(text), set(), set()
        for item, x in wins:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s:s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    if item is not None:
                        names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    vocab = ["a", "b", "c", "d", "É", "f9"]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 12])]
    items += [(20, "a-B  c"), (3, "second text of id three is here"), (None, "null item words go here"), (22, None), (23, " .. "), (24, items[7][1])]
    docs = []
    for i in range(40):
        parts = [" ".join(rng.choices(vocab + ["x", "y", "z"] * 3, k=rng.randint(0, 30)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), (rng.choice(items)[1] or "").upper() if rng.random() < 0.5 else rng.choice(items)[1] or "")
        docs.append((i, " , ".join(parts)))
    docs += [(50, None), (51, ""), (52, "!!"), (53, "null item words go here"), (None, items[8][1]), (5, "repeated " + items[5][1]),
             (5, "repeated " + items[5][1]), (54, items[8][1] + " " + items[8][1])]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("short", [True, False])
def test_against_brute_force(spark, make_docs, cases, limit, short):
    docs, items = cases
    if not short:
        items = [x for x in items if len(slow_words(x[1])) >= 10]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(dc.contamination(make_docs(docs, clash=True), frame, broadcast_windows=limit))
    assert got == sorted(slow(docs, items), key=str)


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(dc.contamination(make_docs([(1, "a b"), (2, None)]), items)) == slow([(1, "a b"), (2, None)], [])
    assert dc.contamination(make_docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_clean_keeps_the_rest(spark, make_docs, cases):
    docs, items = cases
    items = [x for x in items if len(slow_words(x[1])) >= 10]
    frame = make_docs(docs, clash=True)
    out = dc.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == frame.columns
    keep = [d for d, r in zip(docs, slow(docs, items)) if not r[-1]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(keep, key=str)


def test_no_python_in_the_plan(spark, make_docs, cases):
    docs, items = cases
    df = dc.contamination(make_docs(docs), spark.createDataFrame(items[5:10], "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan)
