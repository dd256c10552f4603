"""Source divergence audit: how far the word use of sources of one language is apart.

1. The documents that hold a term are counted by (language, term); terms in enough documents
   are kept.
2. Kept terms, sorted by language and bytes, are built into minimal acyclic transducers
   (``transducer``), a task for each range, at most ``shard_terms`` terms in one.  A term's
   ordinal in its language is that in its transducer and the terms before it.
3. All texts stream through the transducers of their language and give counts by (language,
   source, ordinal).  Transducers are broadcast up to ``pass_bytes`` (their sizes are known by
   then); a larger vocabulary is streamed in as many passes, each with its own transducers.
4. Smoothed shares p are integers; ranks break ties by the ordinal, which orders terms by their
   UTF-8 bytes.  Sums over pairs of sources are taken by blocks of ordinals and tiles of sources, so
   that no task holds more than two tiles by one block, whatever a source or term holds.

The driver holds one line for each transducer, and the bytes of one pass.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import materialize
from foldwise.llm.transducer import LETTERS, Builder, Transducer, words_of

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Smoothing added to each count, and what shares are counted in.
ADDED, UNIT = 5, 1_000_000_000
#: Terms of a block and sources of a tile.
BLOCK, TILE = 1024, 128
#: Groups (language, source) are broadcast up to this number, counted first.
BROADCAST_GROUPS = 100_000


def texts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def document_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """(lang, term, n): rows whose text holds the term.  A task gives its counts out whenever it
    holds ``most`` terms."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def flush(counts):
        for lang, found in counts.items():
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), terms, pa.array(list(found.values()), pa.int64())],
                                             names=schema.names)

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        held = 0
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = counts[lang]
                before = len(found)
                low = data.lower()
                found.update(set(TERM.findall(low)) if len(low) <= 1 << 20 else {m.group() for m in TERM.finditer(low)})
                held += len(found) - before
                if held >= most:
                    yield from flush(counts)
                    counts, held = defaultdict(Counter), 0
        yield from flush(counts)

    return rows.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build(kept: DataFrame, shard_terms: int = 200_000) -> DataFrame:
    """(lang, first, n_terms, n_bytes, data): transducers over ranges of the (lang, term) rows, stored."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.StringType()), T.StructField("n_terms", T.LongType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        builder, lang, first, n = None, None, None, 0

        def shard():
            data = builder.finish().to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([first]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64()),
                                               pa.array([data], pa.binary())], names=schema.names)

        for b in batches:
            for of, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if builder is not None and (of != lang or n >= shard_terms):
                    yield shard()
                    builder = None
                if builder is None:
                    builder, lang, first, n = Builder(), of, term, 0
                builder.add(term.encode())
                n += 1
        if builder is not None:
            yield shard()

    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return materialize(ordered.mapInArrow(run, schema))


class Vocabulary:
    """The transducers of all languages, and in which pass each is used."""

    def __init__(self, shards: DataFrame, pass_bytes: int = 64 << 20):
        self.shards = shards
        lines = shards.select("lang", "first", "n_terms", "n_bytes").collect()
        self.offsets, self.sizes = {}, Counter()
        self.passes: list[list[tuple[str, str]]] = []
        held = 0
        for r in sorted(lines, key=lambda r: (r.lang.encode(), r.first.encode())):
            self.offsets[r.lang, r.first] = self.sizes[r.lang]
            self.sizes[r.lang] += r.n_terms
            if not self.passes or held + r.n_bytes > pass_bytes:
                self.passes.append([])
                held = 0
            self.passes[-1].append((r.lang, r.first))
            held += r.n_bytes

    def broadcasts(self) -> Iterator:
        """For each pass, a broadcast of language -> [(offset, bytes of a transducer)]."""
        spark = self.shards.sparkSession
        for keys in self.passes:
            low, high = keys[0], keys[-1]
            after = (F.col("lang") > low[0]) | ((F.col("lang") == low[0]) & (F.col("first") >= low[1]))
            until = (F.col("lang") < high[0]) | ((F.col("lang") == high[0]) & (F.col("first") <= high[1]))
            found = defaultdict(list)
            for r in self.shards.where(after & until).select("lang", "first", "data").collect():
                found[r.lang].append((self.offsets[r.lang, r.first], bytes(r.data)))
            yield spark.sparkContext.broadcast(dict(found))

    def table(self) -> DataFrame:
        """(lang, v): kept terms of each language that has any."""
        return self.shards.groupBy("lang").agg(F.sum("n_terms").alias("v"))


def load(held) -> dict[str, list[tuple[int, Transducer]]]:
    return {lang: [(at, Transducer.from_bytes(data)) for at, data in shards] for lang, shards in held.value.items()}


def blocks(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts of an Arrow column in blocks of about ``size`` bytes: (bytes, ends of the texts
    in the block, number of the first).  A block ends with a text or at a byte that is in no term."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at, last = int(ends[0]), int(ends[-1])
    ends = ends[1:]
    while at < last:
        stop = min(at + size, last)
        text_end = int(ends[np.searchsorted(ends, stop)])
        while stop < text_end:  # the next byte outside terms, or the end of the text
            outside = np.flatnonzero(LETTERS[raw[stop:min(stop + 65536, text_end)]] == 0)
            if len(outside):
                stop += int(outside[0])
                break
            stop = min(stop + 65536, text_end)
        first = int(np.searchsorted(ends, at, "right"))
        here = ends[first:int(np.searchsorted(ends, stop, "left")) + 1]
        yield raw[at:stop], np.minimum(here, stop) - at, first
        at = stop


def term_counts(rows: DataFrame, vocabulary: Vocabulary, block_bytes: int = 2 << 20, most: int = 1 << 20) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, all passes together."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("ordinal", T.LongType()),
                           T.StructField("n", T.LongType())])

    def counter(held):
        def run(batches):
            known = load(held)
            groups: dict[tuple[str, str], int] = {}
            names: list[tuple[str, str]] = []
            keys, n, waiting, more = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

            def settle():
                """One line for each (group, ordinal) of those held."""
                nonlocal keys, n, waiting, more
                both, at = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, np.ones(more, np.int64)]), minlength=len(both)).astype(np.int64)
                keys, waiting, more = both, [], 0

            def out():
                nonlocal keys, n
                of = keys >> 40
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i][j] for i in of.tolist()], pa.string()) for j in (0, 1)]
                    + [pa.array(keys & (1 << 40) - 1), pa.array(n)], names=schema.names)
                keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
                groups.clear()
                names.clear()

            for b in batches:
                for raw, ends, first in blocks(b.column(2), block_bytes):
                    group = np.empty(len(ends), np.int64)
                    for i, key in enumerate(zip(b.column(0).slice(first, len(ends)).to_pylist(), b.column(1).slice(first, len(ends)).to_pylist())):
                        if key not in groups:
                            groups[key] = len(names)
                            names.append(key)
                        group[i] = groups[key]
                    low, starts, lengths, of = words_of(raw, ends)
                    by_lang = defaultdict(list)
                    for g in np.unique(group).tolist():
                        by_lang[names[g][0]].append(g)
                    for lang, mine in by_lang.items():
                        if lang not in known:
                            continue
                        at = np.flatnonzero(np.isin(group, mine)[of]) if len(by_lang) > 1 else np.arange(len(starts))
                        for offset, shard in known[lang]:
                            ordinal = shard.walk(low, starts[at], lengths[at])
                            hit = ordinal >= 0
                            waiting.append(group[of[at[hit]]] << 40 | (ordinal[hit] + offset))
                            more += len(waiting[-1])
                    if more >= most:
                        settle()
                        if len(keys) >= most:
                            yield from out()
            settle()
            yield from out()
        return run

    parts = [rows.mapInArrow(counter(held), schema) for held in vocabulary.broadcasts()]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def spell(rows: DataFrame, vocabulary: Vocabulary, lang_col: str = "lang", ordinal_col: str = "ordinal", term_col: str = "term") -> DataFrame:
    """Add the term of each (language, ordinal)."""
    schema = T.StructType([*rows.schema.fields, T.StructField(term_col, T.StringType())])
    lang_at, ordinal_at = rows.columns.index(lang_col), rows.columns.index(ordinal_col)

    def speller(held):
        def run(batches):
            known = load(held)
            for b in batches:
                at, terms = [], []
                for i, (lang, ordinal) in enumerate(zip(b.column(lang_at).to_pylist(), b.column(ordinal_at).to_pylist())):
                    for offset, shard in known.get(lang, ()):
                        if offset <= ordinal < offset + shard.n_words:
                            at.append(i)
                            terms.append(shard.word(ordinal - offset).decode())
                mine = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(terms, pa.string())], names=schema.names)
        return run

    parts = [rows.mapInArrow(speller(held), schema) for held in vocabulary.broadcasts()]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found


def share(count, total, v):
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * v)), exact; null if there are no terms."""
    top = (count.cast("decimal(20,0)") + F.lit(ADDED)) * F.lit(UNIT).cast("decimal(10,0)")
    low = (total + v * ADDED).cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", top, low) + F.lit(1)).cast("long")


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: sums over all kept terms of the distance of two sources' shares.

    ``shares``: (lang, number, tiles, v, ordinal, p) of the terms that a source has; ``groups``: (lang,
    number, tiles, v, p0) with p0 the share of a term that it does not have.  ``number``
    counts the sources of a language, ``tiles`` is the last tile's number, ``v`` the number of kept
    terms.  One group of rows has the shares of two tiles of sources in one block of terms."""
    schema = "lang string, a int, b int, value long"
    tile = F.expr(f"number div {TILE}").alias("tile")
    # each source once in each block, so that blocks know the sources without any of their terms
    anchors = groups.select("lang", "number", tile, "tiles", "v", F.explode(F.expr(f"sequence(0, greatest(v - 1, 0) div {BLOCK})")).alias("block"),
                       F.lit(-1).cast("long").alias("ordinal"), F.col("p0").alias("p"))
    own = shares.select("lang", "number", tile, "tiles", "v", F.expr(f"ordinal div {BLOCK}").alias("block"), "ordinal", "p")
    rows = anchors.unionByName(own).withColumn("other", F.explode(F.expr("sequence(0, tiles)")))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "number", "tile", "v", "ordinal", "p")

    def distances(key, pdf):
        import pandas as pd

        lang, block, ta, tb = key
        n = int(max(0, min(BLOCK, pdf["v"].iloc[0] - block * BLOCK)))
        number, ordinal, p = (pdf[c].to_numpy() for c in ("number", "ordinal", "p"))
        rest = ordinal < 0
        sources = np.unique(number[rest])
        at = np.searchsorted(sources, number)
        table = np.zeros((len(sources), n), np.int64)
        if n:
            table[at[rest]] = p[rest].astype(np.int64)[:, None]
            table[at[~rest], ordinal[~rest] - block * BLOCK] = p[~rest].astype(np.int64)
        a, b, value = [], [], []
        left = np.flatnonzero(sources // TILE == ta)
        for i in left.tolist():
            others = np.flatnonzero((sources // TILE == tb) & (sources > sources[i]))
            a.append(np.full(len(others), sources[i]))
            b.append(sources[others])
            value.append(np.abs(table[others] - table[i]).sum(1))
        a, b, value = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b, value))
        return pd.DataFrame({"lang": lang, "a": a.astype(np.int32), "b": b.astype(np.int32), "value": value})

    parts = rows.groupBy("lang", "block", "ta", "tb").applyInPandas(distances, schema)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50,
          pass_bytes: int = 64 << 20, shard_terms: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: a row for each other source of the language, with the sum over all kept terms
    of |p - q|; 0 if the language keeps no term.  Part ``term``: the source's ``top`` terms
    that it has and whose share is above the language's, with the difference.  Ranks go by value
    descending, then by item in UTF-8 order, from 1 in each source and part.

    A null text, language or source is the empty string.  Repeated rows are as many documents.
    A source without terms has pairs; a language of one source has none.  An empty table
    gives no rows.  No column but the three named is read."""
    rows = texts(docs, lang_col, source_col, text_col)
    kept = document_counts(rows).where(F.col("n") >= min_docs)
    vocabulary = Vocabulary(build(kept, shard_terms), pass_bytes)
    counts = materialize(term_counts(rows, vocabulary))

    by_lang = Window.partitionBy("lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary.table(), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = groups.withColumn("lang_total", F.sum("total").over(by_lang)).withColumn("number", F.row_number().over(by_lang.orderBy("source")) - 1)
    groups = groups.withColumn("tiles", F.expr(f"max(number) OVER (PARTITION BY lang) div {TILE}"))
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))))

    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    # a term has at most one row for each source
    own = counts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "ordinal")))
    own = own.join(known, ["lang", "source"]).select("lang", "source", "number", "tiles", "v", "ordinal", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                                                      share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    ranked = Window.partitionBy("lang", "source")
    terms = own.where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    terms = spell(terms, vocabulary, term_col="item").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    sums = pair_sums(own, groups)
    both = sums.unionAll(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "source", "number")
    pairs = (both.join(name.withColumnRenamed("number", "a"), ["lang", "a"])
             .join(name.select("lang", F.col("source").alias("item"), F.col("number").alias("b")), ["lang", "b"]))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(ranked.orderBy(F.desc("value"), "item")).alias("rank"))
    return pairs.unionByName(terms)
