import random
import struct
import zlib

import numpy as np
import pytest

from foldwise.llm import token_files as tf
from foldwise.llm import tokens as tk


@pytest.fixture(scope="module")
def enc():
    return tk.Encoder(tk.tokenizer_path(), 50, 50, 80)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder_gives_the_librarys_ids(enc):
    rng = random.Random(3)
    bits = [*"aZ é ß İ Σς '<| \x1c\x85\xa0 ́ ñ 9 ½ Ⅷ ＡＢ 中文 🙂 ×÷ÀÖ \t\r\n\x0b\x0c \x00\x7f.,", "<|endoftext|>", "<|startoftext|>",
            "'ll", "DON'T", "'S", "word", "...", "H̱", "  "]
    for _ in range(4000):
        s = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        want = enc.tok.encode(s, add_special_tokens=False).ids
        assert enc.ids([s.encode()])[0].tolist() == want, repr(s)
        assert enc.lengths([s.encode()]) == [len(want)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_join_to_the_whole(name):
    e = tk.Encoder(tk.tokenizer_path(name))
    text = ("The quick brown  fox\n" * 50 + "x" * 500 + " é ́ end").encode()
    whole = packed(e.encode(text.decode()))
    for size in (1, 7, 64, 10_000):
        parts = list(e.split(text, size))
        assert b"".join(parts) == text
        assert b"".join(e.ids([p])[0].astype("<u4").tobytes() for p in parts) == whole
        assert e.ids(parts)[0].astype("<u4").tobytes() == whole


@pytest.mark.parametrize("mix", [None, 0, 1])
def test_blocks_of_words(mix, monkeypatch):
    """Parts of every width, letters of both cases, repeats over generations, and hashes that collide."""
    from foldwise.llm import parts
    if mix is not None:
        monkeypatch.setattr(parts, "MIX", [np.uint64(mix)] * 3)
    e = tk.Encoder(tk.tokenizer_path(), 10, 10, 40)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàéîõüßÀÉÎÕÜÞþÿ"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 23, 24, 25, 40]))) + rng.choice(["", "", ".", "...", "×", "7", "42x", "÷!", "'s", "<|endoftext|>"])
             for _ in range(60)]
    for _ in range(30):
        texts = [rng.choice(["", " ", "\n\t"]) + " ".join(rng.choices(words, k=rng.randint(0, 9))) + rng.choice(["", " "]) for _ in range(12)]
        flat, size = e.ids([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [e.encode(t) for t in texts]
        assert len(e.blocks.young.hash) <= 40 + 120
    assert e.ids([])[1].tolist() == [] and e.ids([b"", b" "])[1].tolist() == [0, 0]


def test_count_tokens_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "Hello, world!"), (5, "a b " * 3000), (5, "a b " * 3000), (7, "<|endoftext|> é")]
    out = tk.count_tokens(make_docs(rows, clash=True), batch_bytes=100).collect()
    e = tk.Encoder(tk.tokenizer_path())
    want = [(i, len((t or "").encode()), len(e.encode(t or "")), len(e.encode(t or "")) > 2048) for i, t in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert tk.count_tokens(make_docs([])).count() == 0


def test_pack_and_unpack_are_inverse():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (7, 3), (1000, 49408), (70_000, 2 ** 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        table, control, data = tf.pack(ids)
        assert (tf.unpack(table, control, data, n) == ids).all()
        counts = [int((ids == v).sum()) for v in table[:50]]
        assert counts == sorted(counts, reverse=True)
        assert len(control) == -(-n // 4)


def token_rows(rows):
    e = tk.Encoder(tk.tokenizer_path())
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*e.encode(t or ""), 2]
        out.append((i, at, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, make_docs, monkeypatch):
    rows = [(i, t) for i, t in zip(range(40, 0, -1), ["", None, "one", "two words", "é ñ", "x " * 900] * 7)]
    got = tf.token_table(make_docs(rows, clash=True), piece_bytes=50).orderBy("start").collect()
    assert [tuple(r) for r in got] == token_rows(rows)


def test_token_files_with_null_and_repeated_ids(spark, make_docs):
    rows = [(None, "n"), (3, "same"), (3, "same"), (3, "other text"), (1, "a")]
    got = tf.token_table(make_docs(rows)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 3, 3, 3]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((n, c) for _, _, n, c in token_rows(rows))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
    assert tf.token_table(make_docs([])).count() == 0


def test_long_documents_cross_segments(tmp_path):
    import pyarrow as pa
    docs = [(1, list(range(25))), (2, []), (3, [7] * 10), (None, list(range(300, 331))), (5, [1])]
    path = tmp_path / "x.tok"
    with open(path, "wb") as sink:
        w = tf.Writer(sink, pa.int64(), segment_ids=8)
        assert [w.add(k, [packed(ids[:3]), packed(ids[3:])]) for k, ids in docs] == [len(i) for _, i in docs]
        w.flush()
    got, held = [], []
    with open(path, "rb") as source:
        for k, part, ends in tf.read(source):
            held += part.tolist()
            if ends:
                got.append((k, held))
                held = []
    assert got == docs
    data = path.read_bytes()
    (tmp_path / "y.tok").write_bytes(data[:-1])
    with open(tmp_path / "y.tok", "rb") as source, pytest.raises(ValueError):
        list(tf.read(source))
