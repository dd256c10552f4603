"""Near-duplicates by SimHash, linked through Golay-code fuzzy hashing.

The 64 bits are three segments: A and B of 23 bits and C of 18.  The binary Golay code
of 23 bits has 4096 codewords, and every 23-bit word is within 3 bits of exactly one.
A segment gets as keys the indices of all codewords within 4 bits: one if it is within
2 bits of a codeword, else six.  Two segments that differ in at most 2 bits share a key,
since a word midway between them has a codeword within 3 bits, so within 4 of both.

Let a, b, c be the differing bits by segment, with a + b + c <= 4.  Pigeonhole:
either a <= 2 and b <= 2: a key of A and a key of B agree;
or a >= 3, so b + c <= 1: a key of B and all of C agree, or all of B and a half of C;
or b >= 3: the same with A for B.
So fingerprints within 4 bits share one of these compound keys; those that share one
are compared, and linked if they differ in at most 4 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import materialize, row_key
from foldwise.llm.components import components
from foldwise.llm.tokens import utf8

#: The contract's bit distance, which the segments above are made for, and
#: the generator polynomial of the cyclic Golay code (x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1).
MAX_BITS = 4
GENERATOR = 0b110001110101
MASK23 = np.uint64((1 << 23) - 1)


def fingerprint(words: list[bytes], size: int, seed: int, block: int = 1 << 16) -> int:
    """SimHash of the word shingles (repeats included); no words: 0."""
    import xxhash

    h64, n = xxhash.xxh64_intdigest, max(len(words) - size + 1, min(len(words), 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = words[at:at + block + size - 1]
        text = b" ".join(part)
        lens = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lens) + np.arange(len(part))
        m = min(block, n - at)
        last = ends[size - 1:size - 1 + m] if len(part) >= size else ends[-1:]
        shingles = [text[i:j] for i, j in zip((ends - lens)[:m].tolist(), last.tolist())]
        h = np.fromiter(map(h64, shingles, repeat(seed)), np.uint64, m)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = np.zeros((-(-m // 255) * 255, 8), np.uint64)  # a byte counts one bit, over 255 rows
        lanes[:m] = bits.view(np.uint64)
        counts += lanes.reshape(-1, 255, 8).sum(1).view(np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@functools.lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, patterns): ``patterns[s]`` holds the
    errors of at most 4 bits with syndrome s, the nearest first, and -1 where there are fewer."""
    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    one = [remainder(1 << i) for i in range(23)]
    low, high = (np.zeros(1 << k, np.int64) for k in (12, 11))
    for table, base, k in ((low, 0, 12), (high, 12, 11)):
        for i in range(k):
            table[np.arange(1 << k) >> i & 1 == 1] ^= one[base + i]
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= one[i]
            found[s].append(sum(1 << i for i in places))
    patterns = np.full((1 << 11, 6), -1, np.int64)
    for s, errors in enumerate(found):
        patterns[s, :len(errors)] = errors
    return low, high, patterns


def segment_keys(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word; -1: none."""
    low, high, patterns = golay()
    v = v.astype(np.int64)
    errors = patterns[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(errors >= 0, (v[:, None] ^ errors) >> 11, -1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of the compound keys of fingerprints (unsigned 64-bit)."""
    a, b, c = fps & MASK23, (fps >> np.uint64(23)) & MASK23, (fps >> np.uint64(46)).astype(np.int64)
    ga, gb = segment_keys(a), segment_keys(b)
    a, b = a.astype(np.int64), b.astype(np.int64)
    rows, out = [], []

    def put(tag: int, valid: np.ndarray, key: np.ndarray) -> None:
        at = np.nonzero(valid)
        rows.append(at[0])
        out.append(key[at] | tag << 56)

    put(1, (ga >= 0)[:, :, None] & (gb >= 0)[:, None, :], ga[:, :, None] << 12 | gb[:, None, :])
    for tag, g, whole in ((2, gb, b), (5, ga, a)):
        put(tag, g >= 0, g << 18 | c[:, None])
        put(tag + 1, np.ones(len(fps), bool), whole << 9 | c >> 9)
        put(tag + 2, np.ones(len(fps), bool), whole << 9 | c & 0x1FF)
    return np.concatenate(rows), np.concatenate(out)


def _forest(f: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that join the linked members of a group, one for each member that is reached."""
    rest = f
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                hits = rest[near]
                yield np.full(len(hits), x), hits
                todo.extend(hits)
                rest = rest[~near]


def links(group: np.ndarray, fps: np.ndarray, bits: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of rows (``group`` sorted).  Small groups give all their linked
    pairs, compared at distance 1, 2, ... in the sorted rows; large ones a forest."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(group)])
    us, vs = [], []
    left = np.repeat(np.where(sizes <= small, sizes, 1), sizes) - (np.arange(len(group)) - np.repeat(starts, sizes)) - 1
    at = np.flatnonzero(left > 0)
    for step in range(1, small):
        at = at[left[at] >= step]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
        us.append(fps[hit])
        vs.append(fps[hit + step])
    for i in np.flatnonzero(sizes > small):
        for u, v in _forest(np.unique(fps[starts[i]:starts[i] + sizes[i]]), bits):
            us.append(u)
            vs.append(v)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


#: Parts that the members of one group are dealt over.
PARTS = 32


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(id, k, fp): the fingerprint of each row as a signed 64-bit integer, with the row's key."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", row_key(F.col("id"), F.col("text")).alias("k"), "text")
    schema = T.StructType([rows.schema["id"], rows.schema["k"], T.StructField("fp", T.LongType())])

    def hashed(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.lower().split(), size, seed) for t in utf8(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "k", "fp"])

    return rows.mapInArrow(hashed, schema)


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, hot: int = 16_384, sample: int = 16) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (column ``fp``, distinct) within ``bits``
    of each other: a path for every such pair, not every pair.

    Keys are grouped by a shuffle.  A key that many fingerprints share is found by
    counting one in ``sample`` of them (by hash); its fingerprints are dealt into blocks
    of about ``hot``, and each two blocks are compared in a group of their own, so no
    task holds more than two blocks and no link is lost.  A key that the count misses
    is one larger group: the count decides where work is done, not what is found."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find links of at most {MAX_BITS} bits")
    pair = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])
    edge = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def keyed(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(f), 4096):
                part = f[at:at + 4096]
                row, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "fp"])

    def linked(batches):
        held = (np.zeros(0, np.int64),) * 2
        rows = 0
        wait = []
        for b in batches:
            wait.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows < 1 << 18:
                continue
            g, f = (np.concatenate([h, *x]) for h, x in zip(held, zip(*wait)))
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            held, wait = (g[cut:], f[cut:]), []
            rows = 0
            yield edges(g[:cut], f[:cut])
        g, f = (np.concatenate([h, *x]) for h, x in zip(held, zip(*wait))) if wait else held
        yield edges(g, f)

    def edges(g, f):
        u, v = links(g, f.view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    only = fps.select("fp")
    rows = only.mapInArrow(keyed, pair)
    crowded = materialize(only.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0).mapInArrow(keyed, pair)
                          .groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, hot // sample))
                          .select("key", F.ceil(F.col("n") * sample / hot).cast("int").alias("blocks")))
    if crowded.limit(1).count():
        block = F.pmod(F.xxhash64(F.lit("block"), "fp"), "blocks")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        blocked = (rows.join(crowded, "key").withColumn("i", block).withColumn("j", other)
                   .select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp"))
        rows = rows.join(crowded, "key", "left_anti").unionByName(blocked)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(linked, edge).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42,
           bits: int = MAX_BITS) -> DataFrame:
    """(id, k, fp, root, component_id) of each row; ``root`` is the smallest fingerprint of the
    group, and so names it even where all ids are null."""
    light = materialize(fingerprints(docs, id_col, text_col, size, seed))
    fps = materialize(light.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(fps, bits), "u", "v")
    linked = materialize(roots.join(fps, fps["fp"] == roots["node"]).select("fp", "root", "least"))
    # a group may hold a third of all fingerprints: its id is dealt to as many parts as its members are
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    members = linked.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(ids, ["root", "part"])
    placed = (fps.join(members.select("fp", "root", "component_id"), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    return light.join(placed, "fp").select("id", "k", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """SimHash groups of whole texts: (id, row_key, fingerprint, component_id).

    One row per input row, repeated rows included.  ``fingerprint`` has 16 hex digits;
    ``component_id`` is the smallest id among the rows that links of at most ``bits``
    differing bits reach.  A null, empty or blank text has the fingerprint zero, linked
    like any other.  A null id is kept; a group of only null ids has a null component.
    Rows with equal fingerprints become one before links are sought, so exact copies
    cost nothing more.  Only the named columns are read."""
    return groups(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col), F.col("k").alias("row_key"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of each, one row with the smallest id
    (null last; of rows with that id, the smallest key; of equal rows, one)."""
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k")).alias("best")
    kept = groups(docs, id_col, text_col, **options).groupBy("root").agg(best).select(F.col("best.k").alias("k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key(F.col(id_col), F.col(text_col).cast("string")).alias("k"))
    # rows of one key have one id and text; of many only one leaves a task
    once = rows.groupBy("k").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.join(kept, "k", "left_semi").select("row.*")
