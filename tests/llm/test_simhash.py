import random
import re

import numpy as np
import pytest
import xxhash

from foldwise.llm import components as cc
from foldwise.llm import simhash as sh


def slow_fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_code():
    low, high, patterns = sh.golay()
    weights = [bin(int(p)).count("1") for p in patterns[:, 0]]
    assert max(weights) == 3 and len(patterns) == 2048  # perfect: every syndrome has one leader of weight 3 at most
    keys = sh.segment_keys(np.arange(1 << 23)[::997])
    assert set((keys >= 0).sum(1)) == {1, 6}


@pytest.mark.parametrize("bits", range(5))
def test_fingerprints_within_four_bits_share_a_key(bits):
    rng = np.random.default_rng(bits)
    f = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for p in rng.choice(64, bits, replace=False):
            g[i] ^= np.uint64(1) << np.uint64(p)
    a, b = (set(zip(*(x.tolist() for x in sh.keys(v)))) for v in (f, g))
    assert {r for r, _ in a & b} == set(range(len(f)))


def test_fingerprint_in_blocks_is_that_of_the_whole():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 300, 1000):
        words = [rng.choice(["a", "bb", "ccc", "é"]).encode() for _ in range(n)]
        want = slow_fingerprint(b" ".join(words).decode())
        assert sh.fingerprint(words, 4, 42) == sh.fingerprint(words, 4, 42, block=7) == want


def test_links_keep_connection():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 64, 6, dtype=np.uint64)
    f = np.array([b ^ (np.uint64(1) << np.uint64(rng.integers(64))) for b in base for _ in range(30)], np.uint64)
    group = np.sort(rng.integers(0, 4, len(f)))
    for small in (4, 24, 1000):
        u, v = sh.links(group, f, 4, small)
        assert (np.bitwise_count(u ^ v) <= 4).all()
        for g in range(4):
            own = [int(x) for x in np.unique(f[group == g])]
            root = {x: x for x in own}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for x, y in zip(u.tolist(), v.tolist()):
                if x in root and y in root:
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
            want = slow_components(own)
            assert [find(x) for x in own] == [own[i] for i in want] or len({find(x) for x in own}) <= len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 150), (150, 170)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 150, 150: 150, 170: 150}
    assert cc.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def corpus(rng, n=150):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "éta", "theta"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[1] or "").split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 60, 200])))))
    return rows + [(n, None), (n + 1, "  "), (n + 2, "ALPHA  beta"), (n + 3, "alpha beta")]


def test_near_duplicates_against_all_pairs(spark, make_docs):
    rows = corpus(random.Random(7))
    got = {r.doc_id: r for r in sh.near_duplicates(make_docs(rows, clash=True)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == [rows[r][0] for r in slow_components(fps)]


def test_hot_keys_are_dealt_into_blocks_without_loss(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2 ** 64, 3, dtype=np.uint64)
    f = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 64, (150, 2))}
    f = sorted(f)
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in f], "fp long")
    roots = slow_components(f)
    for hot, sample in ((16_384, 16), (8, 1)):
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in cc.components(sh.fingerprint_links(fps, hot=hot, sample=sample), "u", "v").collect()}
        groups = {}
        for i, x in enumerate(f):
            groups.setdefault(got.get(x, x), set()).add(roots[i])
        assert len(groups) == len(set(roots)) and all(len(g) == 1 for g in groups.values())


def test_one_per_group(spark, make_docs):
    same = "one two three four five six"
    rows = [(9, same, "en"), (4, same, "en"), (4, same, "de"), (None, same), (None, "only null id here now"), (7, "quite another text than that"), (1, None)]
    out = sh.one_per_group(make_docs(rows, clash=True))
    assert out.columns == make_docs(rows, clash=True).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(4, same), (None, "only null id here now"), (7, "quite another text than that"), (1, None)], key=str)
    assert sh.one_per_group(make_docs([])).count() == 0
    assert sh.near_duplicates(make_docs([])).count() == 0
