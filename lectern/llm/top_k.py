"""Exact top-k search by inner product: ball trees per shard, branch and bound, shared k-th scores.

A node of a tree is a ball; ``q.c + |q| r`` bounds what a query can score in it, and a node is cut only if its bound is
below the query's k-th score. ``vector_shards`` builds a tree by shard and routes each query to the shards whose root's
bound reaches what is known of its k-th score; the k-th score of a first, promising shard is shared with all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector_shards as shards
from lectern.llm.scratch import Scratch


def upper_bounds(queries: np.ndarray, lengths: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products with what the balls hold, (queries, balls), with room for rounding."""
    dot = queries @ centres.T
    bound = dot + lengths[:, None] * radii
    size = lengths[:, None] * (np.sqrt((centres**2).sum(1)) + radii)
    return bound + 1e-9 * size + 1e-6


class BallTree:
    """A binary tree of balls over integer vectors, stored as arrays; leaves are spans of ``order``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = shards.LEAF_ROWS) -> None:
        self.vectors, self.ids, self.labels = vectors, ids, labels
        self.order = np.arange(len(vectors))
        self.span, self.children, centres, radii = [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            rows = vectors[self.order[start:end]]
            centre = rows.mean(0)
            away = np.sqrt(((rows - centre) ** 2).sum(1))
            node = len(self.span)
            self.span.append((start, end))
            self.children.append([-1, -1])
            centres.append(centre)
            radii.append(away.max() * (1 + 1e-9) + 1e-6)
            if parent >= 0:
                self.children[parent][side] = node
            if end - start > leaf and away.max() > 0:
                far = rows[away.argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                along = rows @ (other - far)
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(along, half)]
                todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.children = np.array(self.children)

    def root(self) -> tuple:
        return self.centres[0], self.radii[0]

    @staticmethod
    def reach(roots: list[tuple], asked: dict[str, np.ndarray]) -> np.ndarray:
        centres, radii = (np.array([r[k] for r in roots]) for k in range(2))
        bound = upper_bounds(asked["vector"], np.sqrt((asked["vector"] ** 2).sum(1)), centres, radii)
        return np.where(bound >= asked["low"][:, None], bound, -np.inf)

    def search(self, asked: dict[str, np.ndarray], k: int, leaves: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's best k of this shard, less what lies below its ``low``."""
        queries, low = asked["vector"], asked["low"][:, None]
        lengths = np.sqrt((queries**2).sum(1))
        nodes = np.zeros(1, np.int64)
        ends, bounds = [], []
        # Descend level by level; a node goes on while some query's bound for it reaches that query's floor.
        while len(nodes):
            bound = upper_bounds(queries, lengths, self.centres[nodes], self.radii[nodes])
            alive = (bound >= low).any(0)
            leaf = alive & (self.children[nodes, 0] < 0)
            ends.append(nodes[leaf])
            bounds.append(bound[:, leaf])
            nodes = self.children[nodes[alive & ~leaf]].reshape(-1)
        members = [self.order[slice(*self.span[n])] for n in np.concatenate(ends)]
        return shards.visit(np.concatenate(bounds, 1), members, self, asked, k, leaves)


def top_k(
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query: Column | None = None,
    scale: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products with other ids' vectors.

    ``query`` picks the query rows (ids divisible by 50, if none is given). Ties go to the smaller id; fewer candidates
    give fewer rows. Vectors that are null or empty, hold null or non-finite components or have no id take no part.
    Vectors of different lengths meet as if the shorter ended in zeros. Of rows that repeat an id each is a candidate for other
    ids, and the least vector is the query. An empty table gives no rows; other columns are ignored. Scores are exact; one
    that doesn't fit a long is an error.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    own = vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & shards.finite(vector_col))
    own = own.select(
        F.col(id_col).cast("long").alias("vec_id"), shards.quantised(F.col(vector_col), scale).alias("vector"), F.lit(0).cast("long").alias("label")
    )
    asked = own.filter(F.col("vec_id") % 50 == 0) if query is None else vectors.filter(query).select(
        F.col(id_col).cast("long").alias("vec_id")
    ).distinct().join(own, "vec_id")
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    least, most = (F.lit(x).cast("long") for x in (shards.LOW, shards.HIGH))
    asked = asked.select(
        F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "vector", F.lit(0).cast("long").alias("label"),
        F.lit(True).alias("same"), least.alias("low"), most.alias("high"),
    )
    n, width = own.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        none = asked.select("query", F.col("own").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
        return shards.ranked(none, k).withColumnRenamed("query", "query_id")
    trees = shards.planted(own, BallTree, n, width, scratch)
    return shards.search(trees, asked, BallTree, k, width, scratch).withColumnRenamed("query", "query_id")
