"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample: each node's vectors are split by k-means into ``BRANCHES`` children
until a leaf holds at most ``LEAF`` of them. Every vector goes down to one leaf. A query walks the tree with
a priority queue: the node nearest to it is taken next, a leaf's vectors are compared, an inner node's
children enter the queue. How many leaves a query visits is calibrated: for some queries the true
neighbours are found by comparing them with every row, and visits widen until the wanted recall is reached
on these. A query goes on until its leaves hold enough candidates in any case.

Queries and vectors meet leaf by leaf in blocks of bounded size, cut on both sides, so that neither a full
leaf nor one vector that many rows share fills a task. Distances are Euclidean, in double precision, from
the differences of the original components.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those
of another length than the most frequent one (the shorter of equally frequent ones); a row without an id
takes no part; rows that repeat an id are candidates each, but one query (of the smaller vector); ties go
to the smaller id; with no more than ten candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.llm.common import run_folder, stored

NEIGHBOURS = 10
QUERY_EVERY = 100
SAMPLE = 20_000
BRANCHES, LEAF = 8, 64
#: Queries whose true neighbours set the number of visits, and the recall wanted on them.
CALIBRATION = 100
RECALL = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Tree:
    """Centres of all nodes; the children of each (none for a leaf); the number of each leaf."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: dict[int, int]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector goes down to: the nearest child at every node."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            below = self.children[node]
            if not below:
                out[rows] = self.leaf_of[node]
                continue
            nearest = _nearest(vectors[rows], self.centres[below])
            todo += [(child, rows[nearest == i]) for i, child in enumerate(below)]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield self.leaf_of[node]
                continue
            for distance, child in zip(((self.centres[below] - query) ** 2).sum(1), below):
                heapq.heappush(queue, (float(distance), child))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)


def fit_tree(sample: np.ndarray, seed: int = 3, rounds: int = 8) -> Tree:
    r = np.random.default_rng(seed)
    # A vector that many rows share counts once here.
    sample = np.unique(sample, axis=0)
    centres, children, leaf_of = [sample.mean(0)], [[]], {}
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        vectors = sample[rows]
        parts = _split(vectors, r, rounds) if len(rows) > LEAF else []
        if len(parts) < 2:
            leaf_of[node] = len(leaf_of)
            continue
        for centre, mine in parts:
            children[node].append(len(centres))
            todo.append((len(centres), rows[mine]))
            centres.append(centre)
            children.append([])
    return Tree(np.array(centres), children, leaf_of)


def _split(vectors: np.ndarray, r: np.random.Generator, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-means: (centre, rows) of each part that is not empty."""
    centres = vectors[r.choice(len(vectors), min(BRANCHES, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(vectors, centres)
        centres = np.array([vectors[nearest == i].mean(0) for i in range(len(centres)) if (nearest == i).any()])
    nearest = _nearest(vectors, centres)
    return [(centres[i], np.flatnonzero(nearest == i)) for i in range(len(centres)) if (nearest == i).any()]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, distance) of each query's k nearest rows of a block, itself left out."""
    order = np.argsort(ids, kind="stable")
    # Of rows that share a vector only the k + 1 smallest ids can be among the k nearest.
    _, group = np.unique(vectors[order], axis=0, return_inverse=True)
    by_group = np.argsort(group.ravel(), kind="stable")
    begins = np.searchsorted(group.ravel()[by_group], np.arange(group.max() + 1)) if len(group) else np.zeros(0, np.int64)
    within = np.arange(len(order)) - begins[group.ravel()[by_group]]
    rows = order[np.sort(by_group[within <= k])]
    some, their = vectors[rows], ids[rows]
    rough = (queries**2).sum(1)[:, None] - 2 * queries @ some.T + (some**2).sum(1)[None]
    rough[query_ids[:, None] == their[None]] = np.inf
    slack = 1e-9 * ((queries**2).sum(1)[:, None] + (some**2).sum(1).max(initial=0.0))
    kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1][:, None]
    # Everything that rounding could bring among the k nearest is measured exactly.
    q, c = np.nonzero((rough <= kth + slack) & np.isfinite(rough))
    exact = np.concatenate([np.sqrt(((queries[q[i : i + 65536]] - some[c[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    best = np.lexsort((their[c], exact, q))
    q, c, exact = q[best], c[best], exact[best]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], rows[c[place < k]], exact[place < k]


def true_neighbours(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, vec_id, score, leaf of the k nearest of a bounded list of queries, compared with every row."""
    query_ids = np.array([i for i, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids, leaf = part.column("vec_id").to_numpy(), part.column("leaf").to_numpy()
                q, c, score = nearest_in_block(query_ids, matrix, ids, _matrix(part.column("v")), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[q], ids[c], score, leaf[c])], ["query_id", "vec_id", "score", "leaf"])

    near = rows.select("vec_id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    return near.withColumn("rank", _rank()).filter(F.col("rank") <= k)


def _rank():
    return F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))


def search(
    rows: DataFrame,
    folder: str,
    k: int = NEIGHBOURS,
    query_every: int = QUERY_EVERY,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row whose id is divisible by ``query_every``."""
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col)
    found = "query_id long, rank int, vec_id long, score double"
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    if drawn.num_rows == 0:
        return spark.createDataFrame([], found)
    tree = fit_tree(_matrix(drawn.column("v")))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

    placed = stored(good.mapInArrow(descend, "vec_id long, v array<double>, leaf long"), folder, "placed")
    # One number a leaf; the tree bounds how many there are.
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    sizes = np.array([held.get(i, 0) for i in range(len(tree.leaf_of))], np.int64)

    asked = placed.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = [(r["vec_id"], r["v"]) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()]
    if not probes:
        return spark.createDataFrame([], found)
    visits = _calibrated(tree, probes, true_neighbours(placed, probes, k).select("query_id", "leaf").collect(), recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            at, leaves = [], []
            for i in range(len(ids)):
                seen = 0
                for n, leaf in enumerate(tree.visits(matrix[i])):
                    if n >= visits and seen > k:
                        break
                    seen += int(sizes[leaf])
                    at.append(i)
                    leaves.append(leaf)
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(leaves, pa.int64())], ["query_id", "q", "leaf"])

    walked = stored(asked.select("vec_id", "v").mapInArrow(walk, "query_id long, q array<double>, leaf long"), folder, "walked")
    # Both sides of a leaf are cut into blocks; each pair of blocks is compared once.
    cuts = walked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq")).join(
        placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nc")), "leaf"
    )
    cuts = F.broadcast(cuts)  # one row a leaf
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = walked.join(cuts, "leaf").select("query_id", "q", "leaf", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qb"), each(F.col("nc")).alias("cb"))
    right = placed.join(cuts, "leaf").select("vec_id", "v", "leaf", each(F.col("nq")).alias("qb"), F.pmod(F.xxhash64("vec_id"), F.col("nc")).cast("int").alias("cb"))

    def compare(asked_: pa.Table, there: pa.Table) -> pa.Table:
        parts = []
        if asked_.num_rows and there.num_rows:
            query_ids, ids = asked_.column("query_id").to_numpy(), there.column("vec_id").to_numpy()
            q, c, score = nearest_in_block(query_ids, _matrix(asked_.column("q")), ids, _matrix(there.column("v")), k)
            parts = [query_ids[q], ids[c], score]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(p, t) for p, t in zip(parts or [[], [], []], kinds)], names=["query_id", "vec_id", "score"])

    block = ["leaf", "qb", "cb"]
    near = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return near.withColumn("rank", _rank()).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(tree: Tree, probes: list[tuple[int, list[float]]], truth: list, recall: float) -> int:
    """The least number of visits that finds ``recall`` of the true neighbours of the probes."""
    if not truth:
        return 1
    place = {}
    for query, vector in probes:
        place |= {(query, leaf): n + 1 for n, leaf in enumerate(tree.visits(np.array(vector, np.float64)))}
    needed = sorted(place[r["query_id"], r["leaf"]] for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def neighbours(rows: DataFrame) -> DataFrame:
    return search(rows, run_folder(rows.sparkSession, "vector_search"))
