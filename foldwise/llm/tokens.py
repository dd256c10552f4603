"""Token ids and token counts of whole texts with a ``tokenizers`` file.

``Encoder`` returns what ``Tokenizer.encode(text, add_special_tokens=False)`` returns.
Tokenizers that drop white space have a property that both of its uses need: no token,
merge or special string crosses an ASCII white-space character, so a text can be cut there
and the ids of its parts joined.  ``Encoder`` probes a tokenizer for that property; one
without it gets whole texts.  Both encode byte-balanced batches of such pieces: parts of words
that a worker has met are remembered within a bound (``parts``), and the library encodes
those of a batch that are new, in one call.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.parts import PartIds
from foldwise.llm.ragged import Memo, joined

#: Default tokenizer file, in the folder of public tokenizers.
WORD_BPE = "word_bpe_49k.json"

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Words of printable ASCII and Latin-1 letters: normal forms and case mapping act on each character alone.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+")
#: The commonest of them: letters, then marks other than the apostrophe, which are one part each.
_LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


#: Parts that are given to the library as one text.
LINE = 1000


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cut a text at white space, into pieces of about ``size`` bytes.

    A piece ends before the first white-space character at or after ``size`` bytes; a
    stretch without white space stays whole."""
    start = 0
    while len(data) - start > size:
        m = _SPACE.search(data, start + size)
        if not m:
            break
        yield data[start:m.start()]
        start = m.start()
    yield data[start:] if start else data


class Encoder:
    def __init__(self, path: str, words: int = 50_000, parts: int = 50_000, plain_parts: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word, self.ends_word = self._drops_space(), None
        self.pattern = self._word_pattern(path) if self.by_word else None
        self.words, self.parts = Memo(self._new_words, words), Memo(self._new_parts, parts)
        self.blocks = PartIds(self._new_plain_parts if self.ends_word is not None else self._new_parts, self.words, self.special, plain_parts) if self.pattern is not None else None

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _drops_space(self) -> bool:
        words = ["Ab", "é,", "'s", "9", "<", "<|endoftext|>", "́x", "..", "x"]
        own = [self.encode(w) for w in words]
        return all(self.encode(f"{a}{s}{b}") == x + y
                   for a, x in zip(words, own) for b, y in zip(words, own)
                   for s in (" ", "\n", "\t \r", "\x0b", "\x0c  "))

    def _word_pattern(self, path: str):
        """The file's own word pattern if words are lower-cased and matched by one pattern; else None."""
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        if (norm == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
                and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not pre[1].get("add_prefix_space")
                and not conf.get("post_processor")):
            import regex

            self.special = tuple(t["content"].encode() for t in conf.get("added_tokens", []))
            suffix, vocab = conf["model"].get("end_of_word_suffix"), conf["model"]["vocab"]
            if suffix:
                self.ends_word = np.zeros(max([*vocab.values(), *(t["id"] for t in conf.get("added_tokens", []))]) + 1, bool)
                self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            return regex.compile(pre[0]["pattern"]["Regex"])
        return None

    def plain_parts(self, word: bytes) -> list[bytes] | None:
        """The parts of a word of ASCII and Latin-1 letters, in lower case, each a text of its own
        for the tokenizer; None for other words, or if the file has another pattern."""
        if self.pattern is None:
            return None
        if m := _LETTERS.fullmatch(word):
            head, tail = m.groups()
            head = head.lower() if head.isascii() else head.decode().lower().encode()
            return [head, tail] if tail else [head]
        if _PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return [p.encode() for p in self.pattern.findall(word.decode().lower())]
        return None

    def _new_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each on its own."""
        ids = [e.ids for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _new_plain_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts.  Texts of many parts, between spaces, cost the library a third of as many
        texts; where a part ends is read from its last id, which is one of a word's end."""
        texts = [b" ".join(parts[i:i + LINE]).decode() for i in range(0, len(parts), LINE)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[flat])
        if len(ends) != len(parts) or ends[-1] != len(flat) - 1:
            return self._new_parts(parts)
        return flat, np.diff(ends, prepend=-1)

    def _new_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return joined(self.parts, [self.plain_parts(w) or [w] for w in words])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text) of texts or pieces of them."""
        if self.blocks is not None:
            return self.blocks.ids(texts)
        if self.by_word:
            return joined(self.words, [t.split() for t in texts])
        return self._new_parts(texts)

    def lengths(self, batch: list[bytes]) -> list[int]:
        """The number of ids of each text or piece: ids are not kept where the file has plain parts,
        whose batches the library encodes once (``ids``); else whole pieces are one batch."""
        if self.blocks is not None:
            return self.blocks.ids(batch)[1].tolist()
        return [len(e) for e in self.tok.encode_batch_fast([d.decode() for d in batch], add_special_tokens=False)]

    def split(self, data: bytes, size: int) -> Iterator[bytes]:
        return pieces(data, size) if self.by_word else iter((data,))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of a string or binary column each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    group = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def bundles(texts: list[bytes], enc: Encoder, size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts with their row numbers, in bundles of about ``size`` bytes."""
    rows, parts, held = [], [], 0
    for i, data in enumerate(texts):
        for p in enc.split(data, size):
            rows.append(i)
            parts.append(p)
            held += len(p)
            if held >= size:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """Token count of each whole text: (id, n_bytes, n_tokens, over_limit).

    One row per input row, repeated rows included.  A null or empty text has 0 bytes
    and 0 tokens; a null id is returned as it is.  No column but the two named is read,
    so other columns may have any name.  Only lengths leave the Arrow function.  Texts
    longer than ``batch_bytes`` are cut at white space (see module), and pieces are
    encoded in batches of about that many bytes."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def lengths(batches):
        enc = encoder(path)
        for b in batches:
            texts = utf8(b.column(1))
            n = np.zeros(len(texts), np.int64)
            for at, parts in bundles(texts, enc, batch_bytes):
                np.add.at(n, at, enc.lengths(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(n)],
                names=[id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(lengths, schema).withColumn("over_limit", F.col("n_tokens") > limit)
