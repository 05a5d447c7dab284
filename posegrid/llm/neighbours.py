"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample again and again by random directions at the median. Every row is
routed to one leaf of each tree. A query walks all trees through one priority queue, in the order of
how far it lies on the wrong side of the planes above a node, and takes as many leaves as the sample's own
neighbours need for ``RECALL``: few where vectors have clusters, a tenth and more where they lie evenly on all
sides. The rows of those leaves are ranked by their exact inner product.

Largest inner products become nearest directions with one more component, the root of what a row's
squared norm lacks to the largest (Bachrach et al., 2014).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, spread

TREES = 8
SAMPLE_ROWS = 16_384
LEAF_ROWS = 128
#: Share of the sample's nearest neighbours that the leaves looked into must hold, and queries of the sample that it is measured with.
RECALL, PROBES, NEAREST = 0.94, 256, 20
#: Leaves next to one another in a tree that one task compares, so that a query's finds are merged before they are shuffled.
SIBLINGS = 4
BLOCK_ROWS = 4096
HELD_ROWS = 400_000


@dataclass(frozen=True)
class Forest:
    """(trees, inner nodes, dimension) directions and (trees, inner nodes) thresholds of full binary trees."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """(points, trees) leaf numbers, counted through all trees."""
        out = np.zeros((len(points), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", points, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1) + t * 2**self.depth
        return out

    def search(self, point: np.ndarray, most: int) -> list[int]:
        """The ``most`` leaves that a shared priority queue over all trees meets first."""
        inner = 2**self.depth - 1
        away = self.planes @ point - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        found: list[int] = []
        while queue and len(found) < most:
            cost, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append(node - inner + t * (inner + 1))
                continue
            d = float(away[t, node])
            heapq.heappush(queue, (cost, t, 2 * node + 1 + (d > 0)))
            heapq.heappush(queue, (cost + d * d, t, 2 * node + 1 + (d <= 0)))
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Forest:
    depth = max(0, int(np.log2(max(1, len(sample) / leaf_rows))))
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    planes = rng.standard_normal((trees, inner, sample.shape[1]))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    cuts = np.zeros((trees, inner))
    for t in range(trees):
        own = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = own.pop(node)
            place = sample[rows] @ planes[t, node]
            cuts[t, node] = np.median(place) if len(place) else 0.0
            right = place > cuts[t, node]
            own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
    return Forest(planes, cuts, depth)


def looks_needed(forest: Forest, sample: np.ndarray, recall: float = RECALL, probes: int = PROBES, k: int = NEAREST) -> int:
    """Leaves that a query must look into to find ``recall`` of its ``k`` nearest; measured exactly within the sample.

    Rows outside the sample only bring neighbours that are nearer still, and those share leaves more often.
    """
    all_leaves = len(forest.planes) * 2**forest.depth
    if len(sample) <= k + 1:
        return all_leaves
    own, needed = forest.leaves(sample), []
    for i in range(0, len(sample), max(1, len(sample) // probes)):
        direction = np.append(sample[i, :-1] / max(np.linalg.norm(sample[i, :-1]), 1e-300), 0.0)
        place = np.empty(all_leaves, np.int64)
        order = forest.search(direction, all_leaves)
        place[order] = np.arange(len(order))
        score = sample @ direction
        score[i] = -np.inf
        near = np.argpartition(-score, k)[:k]
        needed.append(place[own[near]].min(axis=1) + 1)
    return int(np.quantile(np.concatenate(needed), recall, method="higher"))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part: an id, components that are all finite and not all zero, and the length that most rows have."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (size[0]["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries, k: int = 20, trees: int = TREES, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the column ``queries`` holds, the k other rows found with the largest inner product.

    Ties go to the smaller id. ``recall`` sets how many leaves a query looks into (see looks_needed). Of equal
    vectors only the k + 1 smallest ids can be in a result, so only those are indexed, and equal queries
    are searched once; rows that repeat an id and vector are one row. With fewer candidates than k all
    found are returned; null ids, null, zero or non-finite vectors and odd lengths take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    first = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = cut(rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy"))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    largest = indexed.agg(F.max(norm2).alias("m")).first()["m"]
    asked = rows.filter(queries)
    kinds = asked.groupBy("embedding").agg(F.min("vec_id").alias("qid"))
    schema = "query_id long, rank int, vec_id long, score double"
    if largest is None:
        return spark.createDataFrame([], schema)

    def point(x: np.ndarray) -> np.ndarray:
        lack = np.sqrt(np.maximum(0.0, largest - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, lack[:, None]], axis=1) / np.sqrt(largest)

    # the fit sees a bounded sample, whatever the number of rows
    sample = _matrix(indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow().column("embedding").combine_chunks())
    forest = grow(point(sample), trees)
    looks = max(2 * trees, looks_needed(forest, point(sample), recall, k=k))
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaves(point(_matrix(batch.column("embedding"))))
            at = pa.array(np.repeat(np.arange(len(batch)), trees))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column("vec_id").take(at), batch.column("embedding").take(at)], ["leaf", "id", "embedding"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
            for s in range(0, len(x), 256):
                found = [shared.value.search(p, looks) for p in x[s : s + 256]]
                at = pa.array(np.repeat(np.arange(s, s + len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), batch.column("qid").take(at), batch.column("embedding").take(at)], ["leaf", "id", "embedding"])

    kind = "leaf long, id long, embedding array<double>"
    stored = indexed.mapInArrow(route, kind)
    # leaves are few, a fixed number for each tree; a large one is cut into blocks, and its queries go to each
    blocks = indexed.mapInArrow(lambda it: (b.select(["leaf"]) for b in route(it)), "leaf long").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    blocks = F.broadcast(cut(blocks))
    stored = stored.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(0).alias("role"), "id", "embedding")
    looking = kinds.mapInArrow(look, kind).join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "embedding")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leaf and block, stored ones first. The best of each query are merged within the task."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        here, ids, parts = None, np.zeros(0, np.int64), []
        own: np.ndarray | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                n = [len(v[0]) for v in held.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.fromiter(held, np.int64), n)), pa.array(np.concatenate([v[0] for v in held.values()])), pa.array(np.concatenate([v[1] for v in held.values()]))], ["qid", "vec_id", "score"]
                )
                held.clear()

        for batch in batches:
            leaf, block, role, id_ = (batch.column(c).to_numpy() for c in ("leaf", "block", "role", "id"))
            x = _matrix(batch.column("embedding"))
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(leaf)], strict=True):
                if (leaf[s], block[s]) != here:
                    here, ids, parts, own = (leaf[s], block[s]), np.zeros(0, np.int64), [], None
                if role[s] == 0:
                    ids = np.concatenate([ids, id_[s:e]])
                    parts.append(x[s:e])
                    own = None
                    continue
                if not len(ids):
                    continue
                own = np.concatenate(parts) if own is None else own
                for a in range(s, e, 512):
                    q = x[a : min(e, a + 512)]
                    rough = q @ own.T
                    least = np.partition(rough, -min(k + 1, len(ids)), axis=1)[:, -min(k + 1, len(ids))]
                    near = rough >= least[:, None] - 1e-6 * np.abs(rough).max()
                    for i in range(len(q)):
                        at = np.flatnonzero(near[i])
                        # summed the same way for each pair, so that equal vectors tie exactly
                        exact, names = np.einsum("ij,j->i", own[at], q[i]), ids[at]
                        qid = int(id_[a + i])
                        if qid in held:
                            names, exact = np.concatenate([held[qid][0], names]), np.concatenate([held[qid][1], exact])
                        # of an id's scores the best stays
                        order = np.lexsort((names, -exact))
                        best = order[np.sort(np.unique(names[order], return_index=True)[1])][: k + 1]
                        held[qid] = (names[best], exact[best])
                    if len(held) * (k + 1) > HELD_ROWS:
                        yield from flush()
        yield from flush()

    rows_by_leaf = stored.unionByName(looking).repartition(partitions(spark), F.floor(F.col("leaf") / SIBLINGS), "block").sortWithinPartitions("leaf", "block", "role")
    found = rows_by_leaf.mapInArrow(rank, "qid long, vec_id long, score double").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    named = asked.select("vec_id", "embedding").join(kinds, "embedding").select(F.col("vec_id").alias("query_id"), "qid").distinct()
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # an id that repeats with another vector counts with its best score
    each = spread(named.join(found, "qid").filter("vec_id <> query_id"), "query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    each = each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
