"""Approximate nearest neighbours through a few stable projections.

Vectors are projected by normal random numbers (2-stable: a projected difference is the true
distance times a normal variate) to ``PROJECTED`` dimensions and indexed there by kd-trees, one per
block of rows. A query takes the tree's leaves in order of projected distance and verifies their
vectors by the true distance, until a chi-square test holds: the squared ratio of the next
projected distance to the k-th best true distance is so large that a nearer vector would have shown up
with probability ``SURE``. Every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, table
from shoplight.session import prepare, stored

PROJECTED = 8  # even, for the closed form of the chi-square distribution
SURE = 0.98
BLOCK_ROWS, LEAF_ROWS = 8192, 64
# Queries that are searched side by side.
TOGETHER = 64


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """The distribution function for an even number of degrees."""
    half = np.minimum(np.asarray(x, dtype=float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def projection(dimensions: int, projected: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).normal(size=(dimensions, projected))


class ProjectedTree:
    """A kd-tree over the projections of one block, as boxes of its leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, projected: int = PROJECTED) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.matrix = projection(vectors.shape[1], projected)
        self.points = vectors @ self.matrix
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(ids))]
        while stack:
            members = stack.pop()
            if len(members) <= LEAF_ROWS:
                self.leaves.append(members)
                continue
            own = self.points[members]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order = np.argsort(own[:, axis], kind="stable")
            stack += [members[order[: len(order) // 2]], members[order[len(order) // 2 :]]]
        self.low = np.stack([self.points[m].min(axis=0) for m in self.leaves])
        self.high = np.stack([self.points[m].max(axis=0) for m in self.leaves])

    def search(self, rows: np.ndarray, vectors: np.ndarray, k: int, sure: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its k nearest found: places in the block and true distances."""
        points = vectors @ self.matrix
        gaps = np.maximum(np.maximum(self.low - points[:, None], points[:, None] - self.high), 0)
        reach = (gaps**2).sum(axis=2)  # squared projected distance of query and leaf
        order = np.argsort(reach, axis=1, kind="stable")
        best = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(rows)
        active = np.arange(len(rows))
        for turn in range(len(self.leaves)):
            leaf_of = order[active, turn]
            for leaf in np.unique(leaf_of):
                members = self.leaves[leaf]
                asked = active[leaf_of == leaf]
                distance = np.sqrt(((vectors[asked][:, None] - self.vectors[members]) ** 2).sum(axis=2))
                for q, found in zip(asked, distance):
                    others = self.rows[members] != rows[q]
                    places = np.concatenate([best[q][0], members[others]])
                    values = np.concatenate([best[q][1], found[others]])
                    top = np.lexsort((self.ids[places], values))[:k]
                    best[q] = places[top], values[top]
            if turn + 1 == len(self.leaves):
                break
            kth = np.array([best[q][1][-1] if len(best[q][1]) == k else np.inf for q in active])
            ahead = reach[active, order[active, turn + 1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(kth > 0, ahead / kth**2, np.where(ahead > 0, np.inf, 0.0))
            active = active[~(chi_square(ratio, self.matrix.shape[1]) >= sure)]
            if not len(active):
                break
        return best


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (row_no, id, vector, size) that take part."""
    values = F.col("vector")
    return (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
            .withColumn("row_no", F.monotonically_increasing_id())
            .filter(F.col("id").isNotNull() & values.isNotNull()
                    & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                    & F.exists(values, lambda x: x != 0))
            .withColumn("size", F.size("vector")))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sure: float = SURE, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every query, the rows whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id; vectors are compared with those of the same number of components. Rows that repeat an
    id are queries and candidates each for itself. With fewer than k candidates all are
    returned. An empty table gives an empty table; other columns are not read.

    Blocks hold about ``BLOCK_ROWS`` rows at any size of the table. A query visits every block; queries
    stream past the block's tree in batches, so a task holds one block and one batch.
    """
    rows = stored(usable(vectors, vec_id, embedding), "vectors")
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    indexed = rows.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int")).withColumn("asked", F.lit(0))
    queries = (rows.filter(F.col("id") % every == 0)
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(1)))
    columns = ["block", "size", "asked", "row_no", "id", "vector"]
    dealt = (indexed.select(columns).unionByName(queries.select(columns))
             .repartition(blocks, "block").sortWithinPartitions("block", "size", "asked", "row_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held = None, None, []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "size", "asked")], axis=1)
            ids, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row_no"))
            column = batch.column("vector")
            ends = np.flatnonzero(np.any(np.diff(marks, axis=0) != 0, axis=1)) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows]):
                block, size, asked = marks[a].tolist()
                if key != (block, size):
                    key, tree, held = (block, size), None, []
                values = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, size)
                if not asked:
                    held.append((ids[a:b], numbers[a:b], values))
                    continue
                if tree is None:
                    tree = ProjectedTree(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                for start in range(0, b - a, TOGETHER):
                    part = slice(start, min(start + TOGETHER, b - a))
                    own_ids, own_rows = ids[a:b][part], numbers[a:b][part]
                    found = tree.search(own_rows, values[part], k, sure)
                    lengths = [len(p) for p, _ in found]
                    places = np.concatenate([p for p, _ in found]).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "query_row": pa.array(np.repeat(own_rows, lengths), pa.int64()),
                        "query_id": pa.array(np.repeat(own_ids, lengths), pa.int64()),
                        "vec_id": pa.array(tree.ids[places], pa.int64()),
                        "vec_row": pa.array(tree.rows[places], pa.int64()),
                        "score": pa.array(np.concatenate([v for _, v in found]), pa.float64())})

    found = map_batches(dealt, run, "query_row long, query_id long, vec_id long, vec_row long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "vec_row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return nearest(table(prepare(spark), sf_dir, "embeddings"))
