"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

A benchmark item becomes windows of ``window`` consecutive words; a window becomes its
set of shingles.  Containment must be complete, so the necessary prefix of a window is
one shingle; shingles are ordered by rarity in the documents, and the prefix is the
rarest.  Document shingles meet prefixes by equality; the place of the shingle in the
window gives the only place where the window can start (positional bound), which must
leave room for the whole window (length bound); then the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ascii_lower, materialize, row_key

#: Separators between words (after A-Z are lower-cased): ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HITS = "array<struct<s:bigint,n:bigint,ids:array<string>>>"


def words(text: Column) -> Column:
    """Lower-cased words of a text (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(w: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from 0-based place ``at``; null where they are not all there."""
    return F.when(at + size <= F.size(w), F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of the items: (w array of words, ids of the items that hold it)."""
    own = items.select(F.col(id_col).cast("string").alias("id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (own.select("id", "w", F.explode(starts).alias("at"))
            .select("id", F.slice("w", F.col("at") + 1, window).alias("w"))
            .groupBy("w").agg(F.collect_set("id").alias("ids")))


def _places(docs: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """One row per word of a document (one with null ``at`` if it has none), with the hashes
    of the shingles that start there.  ``w`` stays a reference within the stage."""
    out = docs.select(*keep, "w", F.posexplode_outer("w").alias("at", "_")).drop("_")
    return out.withColumn("hs", F.array(*[_shingle(F.col("w"), F.col("at"), s) for s in sizes])) if len(sizes) != 1 \
        else out.withColumn("h", _shingle(F.col("w"), F.col("at"), sizes[0]))


def _hashes(places: DataFrame, sizes: list[int]) -> DataFrame:
    if len(sizes) == 1:
        return places
    cols = [c for c in places.columns if c != "hs"]
    return places.select(*cols, F.explode("hs").alias("h"))


def prefixes(windows: DataFrame, own: DataFrame, sizes: list[int], shingle: int, broadcast: bool) -> DataFrame:
    """Windows with their rarest shingle: (w, ids, n, h, offset).  Rarity is the number of
    places in the documents; ties go to the smaller hash, then the earlier place."""
    n = F.size("w")
    size = F.least(n, F.lit(shingle))

    def shingles(s: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n - s),
                           lambda i: F.struct(i.alias("offset"), _shingle(F.col("w"), i, s).alias("h")))

    hashes = F.coalesce(*[F.when(size == s, shingles(s)) for s in sizes])
    each = windows.select("w", "ids", n.alias("n"), F.explode(hashes).alias("x")).select("w", "ids", "n", "x.offset", "x.h")
    known = each.select("h").distinct()
    counts = (_hashes(_places(own, sizes, []), sizes).select("h").where(F.col("h").isNotNull())
              .join(F.broadcast(known) if broadcast else known, "h").groupBy("h").agg(F.count(F.lit(1)).alias("freq")))
    best = F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "offset")).alias("best")
    return (each.join(counts, "h", "left").groupBy("w").agg(F.first("ids").alias("ids"), F.first("n").alias("n"), best)
            .select("w", "ids", "n", "best.h", "best.offset"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3,
                  broadcast_windows: int = 200_000) -> DataFrame:
    """Benchmark windows in documents: (id, row_key, n_words, n_hit, n_items, items, items_sha256, contaminated).

    One row per document row: repeated rows come as often as they were given.  A null or
    empty text has no words and no hits; a null id is kept.  An item without words has
    no windows; one with a null id marks words but is not counted or listed.  Items with
    one id count once.  No items or no documents give no hits or no rows.  Only the
    named columns are read.

    Up to ``broadcast_windows`` distinct windows (counted first; a window has at most
    ``window`` words) the prefixes are broadcast and texts are not shuffled.  Beyond it
    the places of shingles are shuffled by hash, and candidates are joined to the words
    of their document to be compared."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", row_key(F.col("id"), F.col("text")).alias("k"), words(F.col("text")).alias("w"))
    windows = materialize(item_windows(items, item_id, item_text, window))
    stats = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.least(F.size("w"), F.lit(shingle))).alias("sizes")).first()
    sizes = sorted(stats["sizes"]) or [shingle]
    small = stats["n"] <= broadcast_windows
    table = materialize(prefixes(windows, own, sizes, shingle, small)) if stats["n"] else spark.createDataFrame(
        [], "w array<string>, ids array<string>, n int, h bigint, offset int")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if small:
        by_hash = F.broadcast(table.groupBy("h").agg(F.collect_list(F.struct("w", "ids", "n", "offset")).alias("ws")))
        places = _hashes(_places(own, sizes, ["id", "k"]), sizes)
        found = F.filter("ws", lambda x: (F.col("at") >= x["offset"]) & (F.col("at") - x["offset"] + x["n"] <= F.size("w"))
                         & (F.slice("w", F.col("at") - x["offset"] + 1, x["n"]) == x["w"]))
        joined = places.join(by_hash, "h", "left")
        first = F.coalesce(F.col("at"), F.lit(0)) == 0
        if len(sizes) > 1:  # a place has a row for each size
            first = F.lit(False)
        # this condition is compiled with the join, so a row with its words is built for few places only;
        # one on the lambdas' result would be merged with it, and is not needed
        hits = joined.where(first | F.col("ws").isNotNull()).select(
            "id", "k", F.size("w").cast("long").alias("n_words"), first.alias("first"),
            F.coalesce(F.transform(found, lambda x: F.struct(
                (F.col("at") - x["offset"]).cast("long").alias("s"), x["n"].cast("long").alias("n"),
                x["ids"].alias("ids"))), F.array().cast(HITS)).alias("hits"))
        if len(sizes) > 1:
            hits = hits.unionByName(_no_hits(own))
    else:
        cand = (_hashes(_places(own.withColumn("n_words", F.size("w")), sizes, ["k", "n_words"]), sizes)
                .select("k", "n_words", "at", "h").join(table.withColumnRenamed("w", "ww"), "h").where(fits)
                .select("k", start.alias("s"), "n", "ww", "ids"))
        texts = own.dropDuplicates(["k"])
        hits = (texts.join(cand, "k").where(F.slice("w", F.col("s") + 1, F.col("n")) == F.col("ww"))
                .select("id", "k", F.size("w").cast("long").alias("n_words"), F.lit(False).alias("first"),
                        F.array(F.struct(F.col("s").cast("long").alias("s"), F.col("n").cast("long").alias("n"), "ids")).alias("hits"))
                .unionByName(_no_hits(own)))
    per_doc = hits.groupBy("k").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.sum(F.col("first").cast("int")).alias("copies"), F.flatten(F.collect_set("hits")).alias("hits"))  # repeated rows add nothing
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e")))))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct(
        (a["c"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0).cast("long"))).alias("c"),
        F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["c"])
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["ids"]))))
    return (per_doc.withColumn("n_hit", covered).withColumn("items", listed)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(F.col("id").alias(id_col), F.col("k").alias("row_key"), "n_words", "n_hit",
                    F.size("items").cast("long").alias("n_items"), "items",
                    F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs."""
    dirty = (contamination(docs, items, id_col, text_col, **options).where("contaminated")
             .select(F.col("row_key").alias("k")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key(F.col(id_col), F.col(text_col).cast("string")).alias("k"))
    return rows.join(dirty, "k", "left_anti").select("row.*")


def _no_hits(own: DataFrame) -> DataFrame:
    """The row that stands for each document."""
    return own.select("id", "k", F.size("w").cast("long").alias("n_words"), F.lit(True).alias("first"),
                      F.array().cast(HITS).alias("hits"))
