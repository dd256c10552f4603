"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A file is a sequence of segments.  A segment holds the ids of consecutive documents,
and is written and read on its own, so memory is bounded by one segment and one text:

    magic "FWT1"  n_keys  n_docs  n_ids  n_table  n_control  n_data   (unsigned 64-bit each)
    keys      n_keys bytes: an Arrow stream of the documents' keys
    lengths   n_docs unsigned 32-bit: ids of each document
    table     n_table unsigned 32-bit: the segment's ids, most frequent first (ties: smaller id)
    control   two bits for each id: bytes of its rank, less one
    data      the ranks, little-endian, in as few bytes as hold them

All integers are little-endian.  The reader expands each control byte by a table of 256
rows (four lengths each), so decoding has no loop over ids.  A document longer than a
segment continues in the next one; its parts carry their lengths, and the flag
``CONTINUES`` in the last length of a segment says that the next length adds to it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import materialize, new_dir, open_fs
from foldwise.llm.tokens import encoder, slices, tokenizer_path, utf8

MAGIC = b"FWT1"
HEAD = struct.Struct("<4s6Q")
CONTINUES = 1 << 31
#: Ids of a segment.
SEGMENT_IDS = 1 << 21
#: Ids below this bound are counted in an array.
DENSE = 1 << 22
#: Byte lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """(table, control, data) of a segment's ids."""
    if len(ids) and int(ids.max()) < DENSE:  # vocabularies: count by id
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        counts, index = counts[values], ids
        rank_of = np.empty(int(ids.max()) + 1, np.uint32)
    else:
        values, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
        rank_of = np.empty(len(values), np.uint32)
    order = np.lexsort((values, -counts))
    rank_of[values[order] if index is ids else order] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[index].astype("<u4")
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    code[:len(ids)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return values[order].astype("<u4"), control.tobytes(), data.tobytes()


def unpack(table: np.ndarray, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a segment."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    if int(size.sum(dtype=np.int64)) != len(data):
        raise ValueError("control bytes and data do not agree")
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return table[out.reshape(-1).view("<u4")]


class Writer:
    def __init__(self, sink, key_type: pa.DataType, segment_ids: int = SEGMENT_IDS):
        self.sink, self.key_type, self.most = sink, key_type, segment_ids
        self.keys: list = []
        self.lengths: list[int] = []
        self.held: list[bytes] = []
        self.n = 0

    def add(self, key, parts: Iterable[bytes]) -> int:
        """Append a document, given as parts of its ids (little-endian unsigned 32-bit)."""
        total = here = 0
        for part in parts:
            while part:
                take = part[:4 * (self.most - self.n)]
                part = part[len(take):]
                self.held.append(take)
                self.n += len(take) // 4
                here += len(take) // 4
                total += len(take) // 4
                if self.n >= self.most:
                    self.keys.append(key)
                    self.lengths.append(here | CONTINUES)
                    here = 0
                    self.flush()
        self.keys.append(key)
        self.lengths.append(here)
        if len(self.lengths) >= self.most:  # many documents of no ids
            self.flush()
        return total

    def flush(self) -> None:
        if self.lengths:
            table, control, data = pack(np.frombuffer(b"".join(self.held), "<u4"))
            keys, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([pa.array(self.keys, self.key_type)], ["key"])
            with pa.ipc.new_stream(keys, batch.schema) as stream:
                stream.write_batch(batch)
            keys = keys.getvalue()
            self.sink.write(HEAD.pack(MAGIC, len(keys), len(self.lengths), self.n, len(table), len(control), len(data)))
            for block in (keys, np.array(self.lengths, "<u4").tobytes(), table.tobytes(), control, data):
                self.sink.write(block)
        self.keys, self.lengths, self.held, self.n = [], [], [], 0


def read(source) -> Iterator[tuple[object, np.ndarray, bool]]:
    """The documents of a file, in parts: (key, ids, whether the document ends here)."""
    def exactly(size: int) -> bytes:
        block = source.read(size)
        if len(block) != size:
            raise ValueError("token file ends early")
        return block

    while head := source.read(HEAD.size):
        if len(head) != HEAD.size or head[:4] != MAGIC:
            raise ValueError("not a token file")
        _, n_keys, n_docs, n_ids, n_table, n_control, n_data = HEAD.unpack(head)
        keys = pa.ipc.open_stream(exactly(n_keys)).read_all()["key"].to_pylist()
        lengths = np.frombuffer(exactly(4 * n_docs), "<u4").astype(np.int64)
        table = np.frombuffer(exactly(4 * n_table), "<u4")
        ids = unpack(table, exactly(n_control), exactly(n_data), n_ids)
        ends = np.cumsum(lengths & (CONTINUES - 1))
        for i, end in enumerate(ends.tolist()):
            yield keys[i], ids[end - (int(lengths[i]) & (CONTINUES - 1)):end], not lengths[i] & CONTINUES


def write_token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 2, out_dir: str | None = None, piece_bytes: int = 1 << 20) -> DataFrame:
    """Encode whole texts and write token files in ascending id order.

    Returns the manifest (part, path, start, n_ids, n_docs), stored: file ``part`` holds
    the documents of one range of ids, and ``start`` counts the ids in all files before.
    Every row is written, repeated rows as often as they come; rows with a null id come
    first, and rows of one id are in the order of their text.  A null or empty text has
    no ids but ``end_id``.  A file's name is new for each attempt, so a lost executor or
    a second attempt of a task leaves files that no manifest names, never a torn one.
    The driver holds one manifest row per file."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    out_dir = out_dir or new_dir(spark, "tokens")
    end = b"" if end_id is None else struct.pack("<I", end_id)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the hash lets a range end inside the rows of one frequent id
    ordered = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h")
               .sortWithinPartitions("id", "h", "text").select("id", "text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()),
                           T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType())])

    def write(batches):
        from itertools import chain

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        enc, part = encoder(path), TaskContext.get().partitionId()
        store, folder = open_fs(out_dir)
        store.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        total = n_docs = 0
        with store.open_output_stream(f"{folder}/{name}") as sink:
            out = Writer(sink, first.schema.field(0).type)
            for b in (part for whole in chain([first], batches) for part in slices(whole, 1, piece_bytes)):
                keys, texts = b.column(0).to_pylist(), utf8(b.column(1))
                if sum(map(len, texts)) > 2 * piece_bytes:  # a long text among them: a piece at a time
                    for key, data in zip(keys, texts):
                        total += out.add(key, chain((enc.ids([p])[0].astype("<u4").tobytes() for p in enc.split(data, piece_bytes)), (end,)))
                else:
                    flat, size = enc.ids(texts)
                    ends = np.cumsum(size)
                    for key, start, stop in zip(keys, (ends - size).tolist(), ends.tolist()):
                        total += out.add(key, (flat[start:stop].astype("<u4").tobytes(), end))
                n_docs += b.num_rows
            out.flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{out_dir}/{name}"]), pa.array([total]), pa.array([n_docs])],
            names=schema.names)

    files = materialize(ordered.mapInArrow(write, schema))
    starts, at = [], 0
    for part, n in sorted((r.part, r.n_ids) for r in files.select("part", "n_ids").collect()):
        starts.append((part, at))
        at += n
    starts = spark.createDataFrame(starts, "part int, start long")
    return files.join(starts, "part").select("part", "path", "start", "n_ids", "n_docs")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", id_type: T.DataType | None = None) -> DataFrame:
    """Read the files of a manifest: (id, start, n_tokens, ids_crc32), one row per document.

    ``start`` counts the ids of all documents before this one; ``ids_crc32`` is the
    CRC-32 of the document's ids as little-endian unsigned 32-bit integers.  An empty
    manifest gives no rows."""
    schema = T.StructType([T.StructField(id_col, id_type or T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        key_type = to_arrow_type(schema[0].dataType)

        def rows(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (key_type, pa.int64(), pa.int64(), pa.int64()))], names=schema.names)

        for b in batches:
            for uri, at, n_docs in zip(*(b.column(c).to_pylist() for c in ("path", "start", "n_docs"))):
                store, name = open_fs(uri)
                out, found, held, crc = ([], [], [], []), 0, 0, 0
                with store.open_input_stream(name, buffer_size=1 << 20) as source:
                    for key, part, ends in read(source):
                        held += len(part)
                        crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                        if ends:
                            for column, value in zip(out, (key, at, held, crc)):
                                column.append(value)
                            at, held, crc, found = at + held, 0, 0, found + 1
                            if len(out[0]) >= 10_000:
                                yield rows(out)
                                out = ([], [], [], [])
                if found != n_docs:
                    raise ValueError(f"{uri} does not hold the documents that its manifest lists")
                yield rows(out)

    files = manifest.select("path", "start", "n_docs")
    # a number of its own keeps the few small rows of many large files in as many tasks
    return files.repartition(max(1, files.count())).mapInArrow(decode, schema)


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of ``docs`` and read them back (see the two functions)."""
    id_col = options.get("id_col", "doc_id")
    return read_token_files(write_token_files(docs, **options), id_col, docs.schema[id_col].dataType)
