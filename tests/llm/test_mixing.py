import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import mixing as mx


def corpus(rng):
    rows = []
    for s, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(0, 40))), None, s, None) for i in range(n)]
    rows += [(len(rows), None, None, "blank", None), (len(rows) + 1, "", None, "blank", None), (None, "x y", None, "big", None), (0, rows[0][1], None, "big", None)]
    return rows


def tokens(text):
    return len((text or "").split())


def sizes(rows):
    t = Counter()
    for r in rows:
        t[r[3]] += tokens(r[1])
    return t


def weights(t, x):
    p = {s: n ** x for s, n in t.items() if n}
    return {s: v / sum(p.values()) for s, v in p.items()}


def entropy(w):
    return -sum(v * math.log(v) for v in w.values())


@pytest.fixture(scope="module")
def rows():
    return corpus(np.random.default_rng(1))


@pytest.mark.parametrize("target,limit,budget", [(0.9, None, None), (0.9, 4.0, None), (None, 2.0, 3000), (0.5, 50.0, 20_000), (0.99, None, 4000), (None, None, 500)])
def test_against_brute_force(spark, make_docs, rows, target, limit, budget):
    docs = make_docs(rows, clash=True)
    out = mx.mix(docs, target_entropy=target, max_repeats=limit, budget=budget, block_tokens=100).collect()
    t = sizes(rows)
    w = {r.source: r.weight for r in out if r.weight}
    # the exponent, from the weights of the two largest sources
    a, b = sorted((s for s in t if t[s]), key=lambda s: -t[s])[:2]
    full = mx.exponent(spark.createDataFrame([(n, math.log(n / t[a])) for n in t.values() if n], "tokens long, l double"), target, limit, budget)
    want = weights(t, full)
    assert all(abs(want[s] - w[s]) < 1e-9 for s in w)
    b_total = budget if budget is not None else max(n / want[s] for s, n in t.items() if n)
    if target is not None and limit is None:
        n = len([s for s in t if t[s]])
        assert entropy(want) >= target * math.log(n) - 1e-6
        assert full == 1 or entropy(weights(t, full + 1e-4)) < target * math.log(n)
    if limit is not None:
        repeats = max(want[s] * b_total / t[s] for s in want)
        assert repeats <= limit + 1e-6 or full == 1
    # blocks, whole epochs and the cut, source by source
    used = defaultdict(Counter)
    by_epoch = defaultdict(lambda: defaultdict(dict))
    for r in out:
        used[r.source][(r.row.doc_id, r.row.text)] += 1
        by_epoch[r.source][r.epoch].setdefault(r.block, (r.block_order, []))[1].append(r.n_tokens)
    own = defaultdict(Counter)
    for r in rows:
        own[r[3]][(r[0], r[1])] += 1
    for s, n in t.items():
        if not n:
            assert used[s] == own[s]
            continue
        quota = round(want[s] * b_total)
        whole = quota // n
        for e in range(whole):
            assert sum(sum(x[1]) for x in by_epoch[s][e].values()) == n
        if whole:
            blocks = by_epoch[s][0]
            assert all(len({by_epoch[s][e][b][0] for e in range(whole)}) == whole for b in blocks)  # other orders each epoch
            if whole < max(by_epoch[s]) + 1:
                last = by_epoch[s][whole]
                left, got = quota - whole * n, sum(sum(x[1]) for x in last.values())
                assert got <= left
                cut = max((x[0], b) for b, x in last.items())
                rest = [b for b in blocks if b not in last]
                order = {r.block: r.h for r in spark.createDataFrame([(s, b) for b in blocks], "source string, block long").select(
                    "block", F.xxhash64(F.lit(42), "source", F.lit(whole).cast("long"), "block").alias("h")).collect()}
                assert all((order[b], b) > cut for b in rest)
                if rest:
                    assert got + sum(blocks[min(rest, key=lambda b: (order[b], b))][1]) > left
        assert sum(sum(x[1]) for e in by_epoch[s].values() for x in e.values()) <= quota
        if budget is None:
            assert set(used[s]) == set(own[s])


def test_edges(spark, make_docs, rows):
    assert mx.mix(make_docs([])).count() == 0
    assert mx.mix(make_docs([(1, None, None, None), (2, "", None, "a")])).count() == 2
    out = mx.mix(make_docs(rows), broadcast_sources=0, block_tokens=100)
    same = mx.mix(make_docs(rows), block_tokens=100)
    key = ["source", "epoch", "block", "block_order", "n_tokens"]
    assert sorted(map(str, out.select(*key).collect())) == sorted(map(str, same.select(*key).collect()))
    assert out.select("row.*").columns == make_docs(rows).columns
