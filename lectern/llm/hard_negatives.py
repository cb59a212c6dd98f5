"""Hard-negative mining: vantage-point trees over norm-augmented vectors.

A vector x of a shard whose greatest norm is M gets one more component, sqrt(M^2 - |x|^2), and a query gets 0 there. Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x: the highest inner product is the nearest vector, and a window of scores is an annulus
around the query. A node of a tree keeps the range of its vectors' distances from its parent's vantage point, so the
triangle inequality bounds their distances from a query; a node whose range misses the annulus is cut, and so is one
without a label that fits. Leaves are visited nearest first from the annulus' inner edge until k rows of fitting labels
are nearer than what is left. ``vector_shards`` builds trees by shard and routes queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector_shards as shards
from lectern.llm.scratch import Scratch


def _scores(asked: dict[str, np.ndarray], top: np.ndarray | float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of scores at distances between ``near`` and ``far``, with room for rounding."""
    whole = (asked["vector"] ** 2).sum(1)[:, None] + top
    room = 1e-6 * np.sqrt(whole)
    near, far = np.maximum(near - room, 0), far + room
    return (whole - near**2) / 2 + 1e-9 * whole + 1, (whole - far**2) / 2 - 1e-9 * whole - 1


def _away(asked: dict[str, np.ndarray], points: np.ndarray, top: np.ndarray | float) -> np.ndarray:
    """Distances of queries from augmented points, all of which have the squared norm ``top``."""
    queries = asked["vector"]
    square = (queries**2).sum(1)[:, None] + top - 2 * (queries @ points[:, : queries.shape[1]].T)
    return np.sqrt(np.maximum(square, 0))


def _labelled(asked: dict[str, np.ndarray], masks: np.ndarray, only: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Whether nodes may hold a label that fits; a mask has a bit of each label."""
    bit = np.uint64(1) << (asked["label"] % 64).astype(np.uint64)
    other = mixed[None, :] | (only[None, :] != asked["label"][:, None])
    return np.where(asked["same"][:, None], (masks[None, :] & bit[:, None]) != 0, other)


class VantageTree:
    """A binary tree over integer vectors, stored as arrays; leaves are spans of ``order``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = shards.LEAF_ROWS) -> None:
        self.vectors, self.ids, self.labels = vectors, ids, labels
        squares = (vectors**2).sum(1)
        self.top = float(squares.max())
        points = np.concatenate([vectors, np.sqrt(np.maximum(self.top - squares, 0))[:, None]], 1)
        self.order = np.arange(len(vectors))
        bits = np.uint64(1) << (labels % 64).astype(np.uint64)
        self.span, self.children, vantage, ranges, masks, only, mixed = [], [], [], [], [], [], []
        todo: list[tuple] = [(0, len(vectors), -1, 0, None)]
        while todo:
            start, end, parent, side, range_ = todo.pop()
            own = self.order[start:end]
            rows = points[own]
            point = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
            away = np.sqrt(((rows - point) ** 2).sum(1))
            node = len(self.span)
            self.span.append((start, end))
            self.children.append([-1, -1])
            vantage.append(point)
            ranges.append(range_ or (away.min(), away.max()))  # the root's own; else from the parent's vantage point
            masks.append(np.bitwise_or.reduce(bits[own]))
            only.append(labels[own[0]])
            mixed.append(bool((labels[own] != labels[own[0]]).any()))
            if parent >= 0:
                self.children[parent][side] = node
            if end - start > leaf and away.max() > away.min():
                half = (end - start) // 2
                place = np.argpartition(away, half)
                self.order[start:end], away = own[place], away[place]
                for k, (a, b) in enumerate(((0, half), (half, end - start))):
                    todo.append((start + a, start + b, node, k, (away[a:b].min(), away[a:b].max())))
        self.children, self.ranges = np.array(self.children), np.array(ranges)
        self.vantage, self.masks, self.only, self.mixed = np.array(vantage), np.array(masks), np.array(only), np.array(mixed)

    def root(self) -> tuple:
        return self.vantage[0], *self.ranges[0], self.top, self.masks[0], self.only[0], self.mixed[0]

    @staticmethod
    def reach(roots: list[tuple], asked: dict[str, np.ndarray]) -> np.ndarray:
        vantage, low, high, top, masks, only, mixed = (np.array([r[k] for r in roots]) for k in range(7))
        away = _away(asked, vantage, top)
        near, far = np.maximum(np.maximum(away - high, low - away), 0), away + high
        upper, lower = _scores(asked, top, near, far)
        fit = (upper >= asked["low"][:, None]) & (lower <= asked["high"][:, None]) & _labelled(asked, masks, only, mixed)
        return np.where(fit, upper, -np.inf)

    def search(self, asked: dict[str, np.ndarray], k: int, leaves: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's best k rows within its window and of labels that fit."""
        nodes = np.zeros(1, np.int64)
        away = _away(asked, self.vantage[nodes], self.top)
        low, high = self.ranges[0]
        near, far = np.maximum(np.maximum(away - high, low - away), 0), away + high
        ends, bounds = [], []
        while len(nodes):
            upper, lower = _scores(asked, self.top, near, far)
            fit = (upper >= asked["low"][:, None]) & (lower <= asked["high"][:, None])
            fit &= _labelled(asked, self.masks[nodes], self.only[nodes], self.mixed[nodes])
            upper, alive = np.where(fit, upper, -np.inf), fit.any(0)
            leaf = alive & (self.children[nodes, 0] < 0)
            ends.append(nodes[leaf])
            bounds.append(upper[:, leaf])
            inner = alive & ~leaf
            away = _away(asked, self.vantage[nodes[inner]], self.top)
            below = self.children[nodes[inner]].T.reshape(-1)  # all first children, then all second ones
            away, near, far = (np.tile(x, (1, 2)) for x in (away, near[:, inner], far[:, inner]))
            low, high = self.ranges[below].T
            near, far = np.maximum(near, np.maximum(away - high, low - away)), np.minimum(far, away + high)
            nodes = below
        members = [self.order[slice(*self.span[n])] for n in np.concatenate(ends)]
        return shards.visit(np.concatenate(bounds, 1), members, self, asked, k, leaves)


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a score, to the next whole number."""
    part = score.cast("decimal(19,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of vectors with the components floor(scale * x); higher ones come first, ties by smaller
    id. ``anchors`` picks the anchor rows; an anchor's positives are its first ``positives`` other rows of its label. For each of
    them the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the positive's
    are returned (all, if fewer). Rows with a null id, label, vector or component, or a component that isn't finite, take no
    part; vectors of different lengths meet as if the shorter ended in zeros. Of rows that repeat an id the least
    (vector, label) is the anchor, and none of them is its positive or negative; for other anchors each is a row. An empty table, no
    anchor or a single label gives no rows; other columns are ignored. A score that doesn't fit a long is an error.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "hard-negatives")
    named = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"), named.cast("long").alias("label"), anchors.alias("is_anchor")
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & shards.finite("raw"))
    rows = rows.select("vec_id", shards.quantised(F.col("raw"), scale).alias("vector"), "label", "is_anchor")
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 1
    trees = shards.planted(rows, VantageTree, n, width, scratch) if n else spark.createDataFrame([], "shard int, tree binary, root binary")
    picked = rows.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("x"))
    least, most = (F.lit(x).cast("long") for x in (shards.LOW, shards.HIGH))
    asked = picked.select(
        F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "x.vector", "x.label", F.lit(True).alias("same"), least.alias("low"), most.alias("high")
    )
    near = shards.search(trees, asked, VantageTree, positives, width, scratch).withColumnRenamed("query", "own")
    near = scratch.save(
        near.select("own", F.col("vec_id").alias("positive"), "score").withColumn("query", F.monotonically_increasing_id())
    )
    windows = near.join(asked.select("own", "vector", "label"), "own").select(
        "query", "own", "vector", "label", F.lit(False).alias("same"),
        _share(F.col("score"), low, True).alias("low"), _share(F.col("score"), high, False).alias("high"),
    )
    found = shards.search(trees, windows, VantageTree, negatives, width, scratch).withColumnRenamed("score", "negative_score")
    return near.join(found, "query").select(
        F.col("own").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )
