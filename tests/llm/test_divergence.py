import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import divergence as dv
from foldwise.llm import q_sources
from foldwise.llm import transducer as tr

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, min_docs=30, top=50):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    rows = [(TERM.findall((t or "").translate(LOW)), lang or "", source or "") for t, lang, source in rows]
    docs, sources = Counter(), defaultdict(set)
    for terms, lang, source in rows:
        docs.update((lang, t) for t in set(terms))
        sources[lang].add(source)
    out = []
    for lang in sources:
        kept = sorted((t for (g, t), n in docs.items() if g == lang and n >= min_docs), key=str.encode)
        n = {s: Counter() for s in sources[lang]}
        for terms, g, source in rows:
            if g == lang:
                n[source].update(terms)
        n[None] = sum(n.values(), Counter())
        p = {}
        for s, c in n.items():
            total = sum(c[t] for t in kept)
            p[s] = [1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept]
        for s in sources[lang]:
            pair = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources[lang] if o != s]
            term = [(a - q, t) for a, q, t in zip(p[s], p[None], kept) if n[s][t] and a > q]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def some_rows(seed, n=400, n_sources=6):
    rng = random.Random(seed)
    vocab = ["a", "A", "ab", "abc", "b", "été", "Été", "ÉTÉ", "straße", "中文", "z" * 50, "it's", "x-y", "q1q", "née", "𝔸"] + [
        "".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", "s é", *[f"s{i}" for i in range(n_sources)]])
        lang = rng.choice([None, "en", "en", "fr"])
        text = " ".join(rng.choices(vocab, weights=[1 + (hash((w, source)) % 5 if w.isascii() else 3) for w in vocab], k=rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]) if rng.random() < 0.1 else text, lang, source))
    rows += [rows[0]] * 40 + [("only, here", "xx", "lone"), (None, "yy", "a"), (None, "yy", "b"), ("..", "yy", None)]
    return rows


def as_docs(make_docs, rows, clash=False):
    return make_docs([(i, t, lang, source) for i, (t, lang, source) in enumerate(rows)], clash=clash)


@pytest.mark.parametrize("options", [{}, {"shard_terms": 5, "pass_bytes": 400}])
def test_against_plain_counts(spark, make_docs, options, monkeypatch):
    rows = some_rows(1)
    got = dv.audit(as_docs(make_docs, rows, clash=True).repartition(5), min_docs=10, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    want = plain(rows, 10)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 200


def test_tiles_and_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK", 7)
    monkeypatch.setattr(dv, "TILE", 2)
    monkeypatch.setattr(dv, "BROADCAST_GROUPS", 0)
    rows = some_rows(2)
    assert sorted(map(tuple, dv.audit(as_docs(make_docs, rows), min_docs=12, top=4).collect())) == plain(rows, 12, 4)


def test_nothing_kept_and_no_rows(spark, make_docs):
    rows = [("a b", "en", "s"), ("a", "en", "t"), (None, None, None), ("c", "", "u")]
    assert sorted(map(tuple, dv.audit(as_docs(make_docs, rows)).collect())) == plain(rows) == [
        ("", "", "pair", "u", 0, 1), ("", "u", "pair", "", 0, 1), ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert dv.audit(as_docs(make_docs, [])).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, q_sources.op13_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.execute(q_sources.ORACLE["op13_divergence"]).fetchall())
    assert len(got) > 1000


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(3)
    for size in (0, 1, 2, 50, 400):
        words = sorted({bytes(rng.choices(b"abc\xc3\xff", k=rng.randint(0, 6))) for _ in range(size)})
        t = tr.Transducer.from_bytes(tr.Transducer.of(words).to_bytes())
        assert t.n_words == len(words)
        assert [t.word(i) for i in range(len(words))] == words
        probes = words + [w + b"a" for w in words] + [b"", b"zz", b"abcabcabc"]
        block = np.frombuffer(b"".join(probes), np.uint8)
        lengths = np.array([len(p) for p in probes])
        where = {w: i for i, w in enumerate(words)}
        assert t.walk(block, np.cumsum(lengths) - lengths, lengths).tolist() == [where.get(p, -1) for p in probes]
        # as many states as there are different sets of endings
        endings = {w[:i]: None for w in words for i in range(len(w) + 1)} or {b"": None}
        rights = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in endings}
        assert len(t.final) == len(rights)
        with pytest.raises(IndexError):
            t.word(len(words))
    with pytest.raises(ValueError):
        tr.Transducer.of([b"b", b"a"])
    with pytest.raises(ValueError):
        tr.Transducer.of([b"a", b"a"])


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_blocks_keep_words_whole(size):
    rng = random.Random(size)
    texts = ["".join(rng.choices(["Ab", "é", " ", "x1", "中", "-", "\n"], k=rng.randint(0, 12))) for _ in range(60)] + ["w" * 300, "", "", "tail"]
    column = pa.array(["skipped", *texts]).slice(1)
    got = []
    for raw, ends, first in dv.blocks(column, size):
        low, starts, lengths, of = tr.words_of(raw, ends)
        got += [(first + int(o), low[s:s + n].tobytes().decode()) for s, n, o in zip(starts.tolist(), lengths.tolist(), of.tolist())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOW))]
