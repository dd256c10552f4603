import hashlib
import json
import random
import struct

import numpy as np
import pytest

from foldwise.llm import bpe, q_bpe
from foldwise.llm.ragged import Memo
from foldwise.llm.tokens import Encoder, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
BITS = [*"aZ é ß İ Σς '<| \x1c\x85\xa0 ́ ñ 9 ½ Ⅷ ＡＢ 中文 🙂 ×÷ÀÖ \t\r\n\x0b\x0c \x00\x7f.,", "<|endoftext|>", "<|startoftext|>",
        "'ll", "DON'T", "'S", "word", "...", "H̱", "  ", "aaaaaaa", "!!!!!", "hahahaha"]


def plain_merges(sym, table):
    """One merge at a time: the lowest rank, then the leftmost place."""
    sym = list(sym)
    while True:
        best = min(((table[p][0], i) for i in range(len(sym) - 1) if (p := (sym[i], sym[i + 1])) in table), default=None)
        if best is None:
            return sym
        i = best[1]
        sym[i:i + 2] = [table[sym[i], sym[i + 1]][1]]


def test_rounds_equal_single_merges():
    """Random tables too, whose products may merge again with a lower rank."""
    rng = random.Random(5)
    uneven = 0
    for _ in range(150):
        n = rng.randint(1, 25)
        pairs = [(rng.randrange(8), rng.randrange(8), rng.randrange(8)) for _ in range(n)]
        m = bpe.Merges(*(np.array(x, np.int32) for x in zip(*pairs)))
        table = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}
        uneven += not m.calm.all()
        words = [[rng.randrange(4) for _ in range(rng.choice([1, 2, 3, 9, 30]))] for _ in range(40)]
        flat, size = m.run(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]))
        got = [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]
        assert got == [plain_merges(w, table) for w in words]
    assert uneven > 20
    assert [len(x) for x in m.run(np.empty(0, np.int32), np.empty(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_text_are_the_librarys(name):
    coder, back = bpe.Bpe(tokenizer_path(name), words=50, parts=50, plain_parts=80), bpe.Decoder(tokenizer_path(name))
    tok = Encoder(tokenizer_path(name)).tok
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(4000)] + ["x" * 5000, "\U0010ffff"]
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        flat, size = coder.encode([t.encode() for t in part])
        for t, ids in zip(part, np.split(flat, np.cumsum(size)[:-1])):
            want = tok.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want, repr(t)
            assert back.decode(ids).decode() == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_decode_any_ids(name):
    coder, tok = bpe.Decoder(tokenizer_path(name)), Encoder(tokenizer_path(name)).tok
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(60_000), rng.randrange(256)]) for _ in range(rng.randint(0, 12))]
        assert coder.decode(np.array(ids, np.uint32)).decode() == tok.decode(ids, skip_special_tokens=False)


def test_other_models_are_refused(tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        conf = json.load(f)
    conf["model"]["byte_fallback"] = True
    path = tmp_path / "x.json"
    path.write_text(json.dumps(conf))
    with pytest.raises(ValueError):
        bpe.Bpe(str(path))
    conf["decoder"] = {"type": "WordPiece"}
    path.write_text(json.dumps(conf))
    with pytest.raises(ValueError):
        bpe.Decoder(str(path))


def test_memo_is_bounded_and_right():
    calls = []

    def make(keys):
        calls.extend(keys)
        return np.array([int(k) for k in keys for _ in range(int(k) % 3)], np.uint32), np.array([int(k) % 3 for k in keys])
    memo, rng = Memo(make, 20), random.Random(1)
    for _ in range(300):
        keys = [str(min(rng.randrange(200), rng.randrange(200))).encode() for _ in range(rng.randint(0, 12))]
        flat, size = memo.take(keys)
        assert flat.tolist() == [int(k) for k in keys for _ in range(int(k) % 3)] and size.tolist() == [int(k) % 3 for k in keys]
        assert len(memo.index) <= 32 and len(memo.old_index) <= 32
    assert len(calls) > len(set(calls))


def digests(rows):
    tok = Encoder(tokenizer_path()).tok
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_query_on_edge_cases(spark, make_docs, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "Hello, world!"), (5, "a b é " * 3000), (5, "a b é " * 3000), (7, "<|endoftext|> é"),
            (8, "q" * 40_000), (9, "\x00")]
    make_docs(rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    out = q_bpe.op11_bpe(spark, str(tmp_path))
    assert [f.simpleString() for f in out.schema] == [
        "doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(digests(rows), key=str)
    small = bpe.decode(bpe.encode(make_docs(rows), batch_bytes=100))
    assert sorted(len(r.ids) // 4 for r in small.collect()) == sorted(d[1] for d in digests(rows))
    assert bpe.decode(bpe.encode(make_docs([]))).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()
    assert [tuple(r) for r in nothing] == [(1, None, None)]


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, q_bpe.op11_bpe(spark, sf).collect())) == sorted(digests(docs))
