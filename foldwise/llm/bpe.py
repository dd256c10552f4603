"""Byte-pair encoding and decoding of whole texts in batched numpy merge rounds.

The symbols of many different words lie in one flat array.  A round looks up the rank of
every new pair of neighbours by binary search over the sorted pair keys, takes the lowest
rank of each word, and merges the pairs of that rank in all words at once; finished words
leave the array.  Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.

Taking all pairs of a word's lowest rank in one round equals taking them from left to
right one by one as long as no merge of the product has a lower rank.  That is looked up
for each merge when the file is read; where it does not hold, the round takes the leftmost
pair only.

Normal forms and the split into words are the tokenizer file's own; words of ASCII and
Latin-1 letters, on which they act character by character, take a short cut.
"""

from __future__ import annotations

import codecs
import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.parts import PartIds
from foldwise.llm.ragged import Memo, joined, spans
from foldwise.llm.tokens import Encoder, bundles, slices, tokenizer_path, utf8

#: Rank of a pair that does not merge.
NEVER = np.int32(2 ** 31 - 1)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """The merge table of a file: sorted pair keys with their ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray):
        ranks = np.arange(len(left), dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.lexsort((-ranks, keys))  # of a repeated pair, the last rank counts
        first = np.ones(len(keys), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        order = order[first]
        self.keys, self.ranks, self.product = keys[order], ranks[order], product.astype(np.int32)
        top = int(max(left.max(initial=0), right.max(initial=0), product.max(initial=0))) + 1
        lowest = np.full(top, NEVER, np.int32)
        for side in (left[self.ranks], right[self.ranks]):
            np.minimum.at(lowest, side, self.ranks)
        #: whether no merge of the rank's product comes before the rank
        self.calm = lowest[self.product] >= ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NEVER) if len(self.keys) else np.full(len(key), NEVER, np.int32)

    def run(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of ``lengths`` (1 or more) symbols: (symbols, lengths) after the last merge."""
        n_words, word = len(lengths), np.arange(len(lengths))
        sym, lengths = sym.astype(np.int32), lengths.astype(np.int64)
        rank = np.full(len(sym), NEVER, np.int32)
        inner = np.ones(len(sym), bool)
        inner[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(sym[at], sym[at + 1])
        done = []  # (word numbers, symbols, lengths)
        while len(word):
            starts = np.cumsum(lengths) - lengths
            low = np.minimum.reduceat(rank, starts)
            rest = low != NEVER
            if not rest.all():
                stay = np.repeat(rest, lengths)
                done.append((word[~rest], sym[~stay], lengths[~rest]))
                word, low, lengths, sym, rank = word[rest], low[rest], lengths[rest], sym[stay], rank[stay]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(rank == np.repeat(low, lengths))
            of = np.searchsorted(starts, at, "right") - 1
            # equal symbols in a row: every other pair, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            odd = (at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) & 1
            take = odd == 0
            wild = ~self.calm[low]
            if wild.any():
                take &= ~wild[of] | np.r_[True, of[1:] != of[:-1]]
            at, of = at[take], of[take]
            sym[at] = self.product[low[of]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NEVER at the end of a word
            merged = at - np.arange(len(at))  # where the products lie afterwards
            sym, rank = sym[keep], rank[keep]
            lengths = lengths - np.bincount(of, minlength=len(word))
            starts = np.cumsum(lengths) - lengths
            # only pairs with a product have a new rank
            ends = starts[of] + lengths[of] - 1
            before = merged[merged > starts[of]] - 1
            after = merged[merged < ends]
            new = np.concatenate([before, after])
            rank[new] = self.rank(sym[new], sym[new + 1])
            rank[merged[merged == ends]] = NEVER
        if not done:
            return sym, lengths
        word, flat, size = (np.concatenate([d[i] for d in done]) for i in range(3))
        out = np.empty(n_words, np.int64)
        out[word] = size
        where = np.empty(n_words, np.int64)
        where[word] = np.cumsum(size) - size
        return flat[spans(where, out)], out


class Bpe:
    """Encoder of a byte-level BPE file of the ``tokenizers`` library.

    Files with another model, unknown-token rules, dropout, or added tokens that strip or
    match normalized text are refused.  ``words``, ``parts`` and ``plain_parts`` bound what is remembered."""

    def __init__(self, path: str, words: int = 50_000, parts: int = 50_000, plain_parts: int = 400_000):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model, norm, pre = conf["model"], conf.get("normalizer"), conf.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [pre]
        added = conf.get("added_tokens", [])
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix")
                     or model.get("byte_fallback") or model.get("ignore_merges"))
        if (model.get("type", "BPE") != "BPE" or not plain or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space")
                or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and norm) for t in added)):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.first = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in chars], np.int32)
        if (self.first < 0).any() or (self.last < 0).any():
            raise ValueError(f"{path} does not know every byte")
        self.as_byte = {ord(c): chr(b) for b, c in enumerate(chars)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(*(np.array(x, np.int32) for x in (
            [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs])))
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if added else None
        self.text = Encoder(path, 0, 0, 0)  # the file's normal forms and word split
        self.words = Memo(self._words, words)
        self.parts = Memo(self._parts, parts)
        self.blocks = PartIds(self._parts, self.words, self.text.special, plain_parts) if self.text.pattern is not None else None

    def _parts(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts: bytes that merge among themselves, or the id of an added token."""
        real = [p for p in parts if isinstance(p, bytes)]
        size = np.fromiter(map(len, real), np.int64, len(real))
        flat = np.frombuffer(b"".join(real), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        ids, size = self.merges.run(sym, size)
        if len(real) < len(parts):
            lengths = np.ones(len(parts), np.int64)
            is_real = np.fromiter((isinstance(p, bytes) for p in parts), bool, len(parts))
            lengths[is_real] = size
            out = np.empty(int(lengths.sum()), np.uint32)
            mask = np.repeat(is_real, lengths)
            out[mask] = ids
            out[~mask] = [p for p in parts if not isinstance(p, bytes)]
            return out, lengths
        return ids.astype(np.uint32), size

    def _general(self, text: str) -> list:
        """The parts of any text, by the file's own normal form and pre-tokenizer."""
        out, at = [], 0
        cuts = [(m.start(), m.end(), self.added[m.group()]) for m in self.special.finditer(text)] if self.special else []
        for start, end, token in [*cuts, (len(text), len(text), None)]:
            piece = text[at:start]
            if piece:
                if self.text.tok.normalizer:
                    piece = self.text.tok.normalizer.normalize_str(piece)
                out += [p.translate(self.as_byte).encode("latin-1") for p, _ in self.text.tok.pre_tokenizer.pre_tokenize_str(piece)]
            if token is not None:
                out.append(token)
            at = end
        return out

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words."""
        return joined(self.parts, [self.text.plain_parts(w) or self._general(w.decode()) for w in words])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text)."""
        if self.blocks is not None:
            return self.blocks.ids(texts)
        if self.text.by_word:
            return joined(self.words, [t.split() for t in texts])
        return joined(self.parts, [self._general(t.decode()) for t in texts])


class Decoder:
    """Texts of ids of a BPE file without a decoder, whose tokens are joined by spaces, or with
    ``ByteLevel``, whose tokens are bytes; others are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        kind = (conf.get("decoder") or {}).get("type")
        if conf["model"].get("type", "BPE") != "BPE" or kind not in (None, "ByteLevel"):
            raise ValueError(f"{path} has another decoder")
        self.joined = kind is None
        as_byte = {ord(c): chr(b) for b, c in enumerate(_byte_chars())}
        tokens = {i: " " + t if self.joined else t.translate(as_byte).encode("latin-1") for t, i in conf["model"]["vocab"].items()}
        tokens |= {t["id"]: (" " if self.joined else "") + t["content"] for t in conf.get("added_tokens", [])}
        table = [t.encode() if isinstance(t, str) else t for t in (tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1))]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a sequence of ids in UTF-8; ids that the file does not have are left out,
        bytes that are not UTF-8 give U+FFFD."""
        ids, out = ids[ids < len(self.length)], []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)]
            out.append(self.flat[spans(self.start[part], self.length[part])].tobytes())
        text = b"".join(out)
        return text[1:] if self.joined else codecs.decode(text, "utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One encoder per Python worker and file."""
    return Bpe(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids",
           batch_bytes: int = 1 << 20) -> DataFrame:
    """Ids of each whole text: (id, ids), the ids as little-endian unsigned 32-bit integers.

    One row per input row, repeated rows included.  A null or empty text has no ids; a null
    id is returned as it is.  No column but the two named is read.  Texts longer than
    ``batch_bytes`` are cut at white space where the file allows it (``tokens.Encoder``),
    and words are merged in batches of about that many bytes of text."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(ids_col, T.BinaryType())])

    def run(batches):
        coder = bpe(path)
        for b in (part for whole in batches for part in slices(whole, 1, batch_bytes)):
            texts = utf8(b.column(1))
            out: list[list[bytes]] = [[] for _ in texts]
            for numbers, parts in bundles(texts, coder.text, batch_bytes):
                flat, size = coder.encode(parts)
                ends = np.cumsum(size)
                for i, start, end in zip(numbers, (ends - size).tolist(), ends.tolist()):
                    out[i].append(flat[start:end].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(x) for x in out], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids",
           text_col: str = "decoded", batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, ids, text) of ids as ``encode`` gives them; null ids give a null text.

    The text is what ``Tokenizer.decode(ids, skip_special_tokens=False)`` gives."""
    path = path or tokenizer_path()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(ids_col, T.BinaryType()),
                           T.StructField(text_col, T.StringType())])

    def run(batches):
        coder = decoder(path)
        for b in (part for whole in batches for part in slices(whole, 1, batch_bytes)):
            texts = [None if x is None else coder.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
