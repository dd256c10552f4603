"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then placed in a leaf by going
to the nearest centre at each level.  A query walks the tree with a priority queue of
nodes: the best waiting node is opened, its children are queued with the inner product
of their centre and the query plus their spread, and leaves come out in the order in which they are
worth a visit.  How many leaves a query visits is calibrated: on a sample of queries,
whose neighbours are found exactly, visits widen until the wanted recall is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import materialize
from foldwise.session import parallelism


@dataclass
class Tree:
    """Nodes in arrays; children of node i are ``first[i]`` to ``first[i] + count[i] - 1``."""
    centres: np.ndarray
    spread: np.ndarray  # mean distance of a node's sample vectors from its centre
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray  # number of the leaf, or -1

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(node[self.count[node] > 0])
            if not len(inner):
                return self.leaf[node]
            for i in inner:
                rows = np.flatnonzero(node == i)
                c = self.centres[self.first[i]:self.first[i] + self.count[i]]
                node[rows] = self.first[i] + _nearest(x[rows], c)

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk for a query by inner product."""
        score = self.centres @ q + self.spread * np.linalg.norm(q)
        waiting = [(-score[0], 0)]
        while waiting:
            _, i = heapq.heappop(waiting)
            if self.leaf[i] >= 0:
                yield int(self.leaf[i])
            for j in range(self.first[i], self.first[i] + self.count[i]):
                heapq.heappush(waiting, (-score[j], j))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * (x @ centres.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, branching: int = 8, leaf_size: int = 128, rounds: int = 8, seed: int = 42) -> Tree:
    """A tree over the sample, split into ``branching`` parts until a node has ``leaf_size``
    vectors or only equal ones."""
    rng = np.random.default_rng(seed)
    sample = sample if len(sample) else np.zeros((1, sample.shape[1]))
    centres, spread, first, count, held = [sample.mean(0)], [0.0], [0], [0], [sample]
    i = 0
    while i < len(held):
        x = held[i]
        spread[i] = float(np.linalg.norm(x - centres[i], axis=1).mean())
        if len(x) > leaf_size and (x != x[0]).any():
            c = _kmeans(x, branching, rounds, rng)
            near = _nearest(x, c)
            parts = [j for j in range(branching) if (near == j).any()]
            if len(parts) > 1:
                first[i], count[i] = len(held), len(parts)
                for j in parts:
                    centres.append(c[j])
                    held.append(x[near == j])
                    spread.append(0.0)
                    first.append(0)
                    count.append(0)
        held[i] = x[:0]
        i += 1
    leaf = np.where(np.array(count) == 0, 1, 0)
    leaf = np.where(leaf == 1, np.cumsum(leaf) - 1, -1)
    return Tree(np.array(centres), np.array(spread), np.array(first), np.array(count), leaf)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def top(x: np.ndarray, ids: np.ndarray, rough: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, scores) of the k vectors of largest inner product with q, ties to smaller
    ids.  Rough products (-inf: no candidate) choose, with room for their rounding;
    exact ones decide."""
    if len(x) > k:
        bound = np.partition(rough, len(x) - k)[len(x) - k]
        at = np.flatnonzero((rough >= bound - 1e-9 * (1 + abs(bound))) & (rough > -np.inf)) if bound > -np.inf else np.flatnonzero(rough > -np.inf)
    else:
        at = np.flatnonzero(rough > -np.inf)
    score = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def pack(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each leaf, blocks of each group): neighbouring leaves share a group of about
    ``most`` vectors; a larger leaf is a group of its own, cut into blocks."""
    group, held, g, blocks = np.zeros(len(sizes), np.int64), 0, -1, []
    for i, n in enumerate(sizes.tolist()):
        if g < 0 or held + n > most:
            g, held = g + 1, 0
            blocks.append(max(1, -(-n // most)))
        group[i] = g
        held += n
    return group, np.array(blocks)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((id, v) of the vectors that take part, their dimension).  Out stay rows with a null id,
    null and zero vectors, those with a null or non-finite component, and those whose
    length is not the commonest (of equally common ones, the largest).  A vector column of another
    numeric type is cast to doubles; one that is no array is refused by Spark."""
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"  # half the shuffle
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if floats else "array<double>").alias("v"))
    ok = (F.col("id").isNotNull() & F.col("v").isNotNull()
          & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = dims[0]["d"] if dims else 0
    return rows.where(F.size("v") == dim), dim


def _share(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About ``most`` rows, by a hash of their id and vector (an id may have many); all, if there are no more."""
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95,
           sample: int = 50_000, calibrate: int = 100, leaf_size: int = 256, block: int | None = None,
           queries_per_group: int = 4096, seed: int = 42) -> DataFrame:
    """The k nearest rows found for each query: (query_id, rank, id, score), by inner product in
    double precision, nearest first, ties to smaller ids.

    ``is_query`` is a condition on the id column.  A query's own row is no candidate, and
    no row with its id is.  Equal rows (id and vector) count once; rows that share an id with
    different vectors are candidates of their own, and the query of that id is its smallest vector.
    Rows that ``usable`` leaves out take no part; without vectors or queries there are no
    rows.  With fewer than k candidates a query gets all of them.

    The tree is fitted on about ``sample`` vectors, and the number of visits on about
    ``calibrate`` queries (documented bounds); every vector is placed and may be found.
    Neighbouring leaves go to one group of about ``block`` vectors (by default a share of the rows
    that keeps all cores busy, 1,024 to 8,192), and a larger leaf is cut into blocks, so one leaf, or one vector that is very common, is shared out over tasks.  A
    query goes to a group once, with the leaves that it visits there; a task keeps only k
    neighbours of each of ``queries_per_group`` queries at a time.  The tree (about
    sample / leaf_size * 1.2 nodes) is broadcast."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vec_col)
    id_type = rows.schema["id"].dataType
    found = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    if not dim:
        return spark.createDataFrame([], T.StructType([found[0], T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_type), found[2]]))
    rows = rows.dropDuplicates(["id", "v"])
    n = rows.count()
    block = block or max(1024, min(8192, -(-n // (4 * parallelism(spark)))))
    fitted = _share(rows, n, sample, "fit").orderBy("id", "v").toArrow()
    tree = spark.sparkContext.broadcast(fit(_matrix(fitted["v"].combine_chunks(), dim) if fitted.num_rows else np.zeros((0, dim)),
                                            leaf_size=leaf_size, seed=seed))
    n_leaves = tree.value.n_leaves
    placed_type = T.StructType([*rows.schema.fields, T.StructField("leaf", T.IntegerType())])

    def place(batches):
        for b in batches:
            leaf = tree.value.place(_matrix(b.column(1), dim)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    placed = materialize(rows.mapInArrow(place, placed_type))
    # by leaf, bounded by the tree
    sizes = np.zeros(n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.leaf] = r.n
    group, n_blocks = pack(sizes, block)
    spans = spark.createDataFrame([(i, int(g), int(n_blocks[g])) for i, g in enumerate(group)], "leaf int, g int, n_blocks int")
    blocks = (placed.join(F.broadcast(spans), "leaf")
              .select("g", F.pmod(F.xxhash64(F.lit("block"), "id", "v"), "n_blocks").cast("int").alias("b"), "id", "v", "leaf",
                      F.lit(None).cast("array<int>").alias("visits")))
    queries = materialize(placed.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    n_queries = queries.count()

    def near(asked: DataFrame, leaves: int) -> DataFrame:
        """Best k of each query in the first ``leaves`` leaves of its walk."""
        both = blocks.unionByName(walked(asked, leaves)).repartition("g", "b").sortWithinPartitions("g", "b", F.col("visits").isNotNull())
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return both.mapInArrow(scan, found).withColumn("rank", rank).where(F.col("rank") <= k)

    def walked(asked: DataFrame, leaves: int) -> DataFrame:
        """A row for each query and block to visit, with the leaves wanted there."""
        kind = T.StructType([*queries.schema.fields, T.StructField("g", T.IntegerType()), T.StructField("n_blocks", T.IntegerType()),
                             T.StructField("visits", T.ArrayType(T.IntegerType()))])

        def walk(batches):
            for batch in batches:
                rows, gs, wanted = [], [], []
                for i, q in enumerate(_matrix(batch.column(1), dim)):
                    order = np.fromiter((x for x, _ in zip(tree.value.best_bins(q), range(leaves))), np.int64)
                    order = order[np.argsort(group[order], kind="stable")]
                    at = group[order]
                    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    rows += [i] * len(starts)
                    gs += at[starts].tolist()
                    wanted += [x.tolist() for x in np.split(order, starts[1:])]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(gs, pa.int32()),
                     pa.array(n_blocks[np.array(gs, np.int64)], pa.int32()), pa.array(wanted, pa.list_(pa.int32()))], names=kind.names)

        return (asked.mapInArrow(walk, kind).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
                .select("g", F.col("b").cast("int").alias("b"), "id", "v", F.lit(None).cast("int").alias("leaf"), "visits"))

    def scan(batches):
        here, parts, seen = None, [], None
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            key, query = g << 32 | b, batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            names, v = batch.column(2).to_pylist(), _matrix(batch.column(3), dim)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (query[1:] != query[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                if key[s] != here:
                    here, parts, seen = key[s], [], None
                if not query[s]:
                    parts.append((v[s:e], names[s:e], batch.column(4).slice(s, e - s).to_numpy(zero_copy_only=False)))
                    continue
                if not parts:
                    continue
                if seen is None:
                    seen = (np.concatenate([x for x, _, _ in parts]), np.array([i for _, ids, _ in parts for i in ids]),
                            np.concatenate([x for _, _, x in parts]).astype(np.int64))
                x, ids, leaf = seen
                for at in range(s, e, 256):
                    to = min(e, at + 256)
                    rough = v[at:to] @ x.T
                    for j, wanted in enumerate(batch.column(5).slice(at, to - at).to_pylist()):
                        visit = np.zeros(n_leaves, bool)
                        visit[wanted] = True
                        q = names[at + j]
                        places, score = top(x, ids, np.where(visit[leaf] & (ids != q), rough[j], -np.inf), v[at + j], k)
                        near_ids = ids[places]
                        if q in best:
                            near_ids, score = np.concatenate([best[q][0], near_ids]), np.concatenate([best[q][1], score])
                            order = np.lexsort((near_ids, -score))[:k]
                            near_ids, score = near_ids[order], score[order]
                        best[q] = (near_ids, score)
                    if len(best) >= queries_per_group:
                        yield found_rows(best)
                        best = {}
        yield found_rows(best)

    def found_rows(best):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_type)
        q = [x for x, (i, _) in best.items() for _ in range(len(i))]
        ids = [y for i, _ in best.values() for y in i.tolist()]
        score = np.concatenate([s for _, s in best.values()]) if best else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(ids, kind), pa.array(score)], names=["query_id", "id", "score"])

    # exact neighbours of a sample of the queries, against all blocks
    some = _share(queries, n_queries, calibrate, "calibrate")
    truth = near(some, n_leaves).select("query_id", F.col("id").alias("i"))
    truth = (truth.join(placed.select(F.col("id").alias("i"), "leaf"), "i").groupBy("query_id").agg(F.collect_list("leaf").alias("leaves"))
             .join(some.select(F.col("id").alias("query_id"), "v"), "query_id").collect())
    hits, total = np.zeros(n_leaves + 1, np.int64), 0
    for r in truth:
        place_of = {leaf: i for i, leaf in enumerate(tree.value.best_bins(np.array(r["v"])))}
        np.add.at(hits, [place_of[x] for x in r["leaves"]], 1)
        total += len(r["leaves"])
    reached = np.cumsum(hits)
    width = int(np.searchsorted(reached, np.ceil(recall * total))) + 1 if total else n_leaves
    return (near(queries, min(width, n_leaves)).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
