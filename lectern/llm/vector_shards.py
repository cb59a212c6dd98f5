"""Vectors in shards, each with a search tree, and queries that visit the shards which may hold answers.

* *Shards.* Vectors go to the nearest of a few pivots and, by a hash, to a shard of about ``rows`` of that pivot's vectors.
  Each shard's tree is built once and written with a small summary of its root.
* *Routing.* Summaries meet the queries in blocks of ``ROOTS``, so neither the driver nor a broadcast holds them all. A
  query goes only to shards whose root may reach its window of scores. Vectors are not copied to meet queries.
* *Floors.* A first pass visits each query's most promising shard, and there its best leaves; the k-th score found is a
  lower bound that the second pass gives to all shards at once.
* *Search.* A query visits a shard's leaves in the order of their bounds and stops where a bound falls below its k-th
  score, so ties are all seen. Scores are exact integers; bounds are doubles with room for rounding.

A tree class has ``__init__(vectors, ids, labels)``, ``root()``, ``reach(roots, asked)`` (static: upper bounds of scores by
query and root, -inf where nothing can answer) and ``search(asked, k, leaves)``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import Scratch

SHARD_ROWS, LEAF_ROWS, PIVOTS = 16_384, 256, 64
#: Root summaries that a task holds at once, shuffle partitions that shards are built in, at most.
ROOTS, BUILD_TASKS = 4096, 20_000
#: Queries that descend a tree together, and queries of a shard or block beyond which several tasks share it.
GROUP_ROWS, TASK_QUERIES = 256, 1 << 16
#: The least and the greatest score; the least also stands for none.
LOW, HIGH = -(2**63) + 1, 2**63 - 1

#: ``own``: the id that a query must not return; ``same``: whether answers have the query's label or another one.
ASKED = "query long, own long, vector array<double>, label long, same boolean, low long, high long"
_NAMES = [x.split()[0] for x in ASKED.split(", ")]


def finite(vector: str) -> Column:
    """True for a vector without null or non-finite components; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as a double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(lengths.cumsum() - lengths, lengths)] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The exact integer inner products of whole-numbered rows; an OverflowError if a wanted one doesn't fit a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
    exact = np.where(wanted, whole(a) @ whole(b).T, 0)
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) > HIGH - 1:
        raise OverflowError("an inner product doesn't fit 64 bits")
    return exact.astype(np.int64)


def visit(
    bound: np.ndarray, members: list[np.ndarray], tree, asked: dict[str, np.ndarray], k: int, leaves: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best k, leaf by leaf in the order of bounds (queries, leaves)."""
    queries, low, high = asked["vector"], asked["low"], asked["high"]
    best, best_id = (np.full((len(queries), k), x, np.int64) for x in (LOW, 0))
    order = np.argsort(-bound, axis=1, kind="stable")
    open_ = np.arange(len(queries))
    for turn in range(len(members) if leaves is None else min(leaves, len(members))):
        at = order[open_, turn]
        reach = bound[open_, at] >= np.maximum(low[open_], best[open_, -1])
        reach &= bound[open_, at] > -np.inf
        open_, at = open_[reach], at[reach]  # bounds fall from turn to turn, so what stops here has ended
        if not len(open_):
            break
        for leaf in np.unique(at):
            rows, own = open_[at == leaf], members[leaf]
            fit = tree.ids[own] != asked["own"][rows, None]
            fit &= (tree.labels[own] == asked["label"][rows, None]) == asked["same"][rows, None]
            score = inner_products(queries[rows], tree.vectors[own], fit)
            fit &= (score >= low[rows, None]) & (score <= high[rows, None]) & (score >= best[rows, -1:])
            hit = fit.any(1)
            if not hit.any():
                continue
            rows = rows[hit]
            both = np.concatenate([best[rows], np.where(fit[hit], score[hit], LOW)], 1)
            both_id = np.concatenate([best_id[rows], np.broadcast_to(tree.ids[own], (len(rows), len(own)))], 1)
            kth = np.partition(both, -k, axis=1)[:, -k]  # what is below the k-th of a row can't stay; ties can
            width = int((both >= kth[:, None]).sum(1).max())
            if width < both.shape[1]:
                near = np.argpartition(-both, width - 1, axis=1)[:, :width]
                both, both_id = np.take_along_axis(both, near, 1), np.take_along_axis(both_id, near, 1)
            first = np.lexsort((both_id, -both), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(both_id, first, 1)
    rows, places = np.nonzero(best > LOW)
    return rows, best_id[rows, places], best[rows, places]


def _near(pivots: np.ndarray):
    """The nearest pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(1) / 2
        for batch in batches:
            vectors = matrix(batch.column("vector"), pivots.shape[1])
            cell = (vectors @ pivots.T - squares).argmax(1) if len(vectors) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(cell, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    return run


def _plant(kind: type, width: int):
    """A tree per shard; rows come shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def close() -> pa.RecordBatch:
            own = pa.Table.from_batches(rows).combine_chunks()
            vectors = matrix(own["vector"].combine_chunks(), width)
            tree = kind(vectors, own["vec_id"].to_numpy(), own["label"].to_numpy())
            raw, root = (pickle.dumps(x, protocol=5) for x in (tree, tree.root()))
            columns = [pa.array([shard], pa.int32()), pa.array([raw], pa.binary()), pa.array([root], pa.binary())]
            return pa.record_batch(columns, ["shard", "tree", "root"])

        for batch in batches:
            keys = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if rows and keys[a] != shard:
                        yield close()
                        rows = []
                    shard = int(keys[a])
                    rows.append(batch.slice(a, b - a))
        if rows:
            yield close()

    return run


def planted(own: DataFrame, kind: type, n: int, width: int, scratch: Scratch) -> DataFrame:
    """(shard, tree, root) of vectors (vec_id, vector, label), ``n`` of them of up to ``width`` components."""
    rows = SHARD_ROWS
    pivots = own.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(min(PIVOTS, -(-n // rows))).select("vector").toArrow()
    pivots = np.unique(matrix(pivots["vector"].combine_chunks(), width), axis=0)
    cells = own.select("vec_id", "vector", "label").mapInArrow(_near(pivots), "cell int, vec_id long, vector array<double>, label long")
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # a row a pivot
    splits = [-(-sizes.get(c, 0) // rows) for c in range(len(pivots))]
    first, split = (F.array(*map(F.lit, x))[F.col("cell")] for x in (np.cumsum([0, *splits[:-1]]).tolist(), splits))
    shards = cells.withColumn("shard", (first + F.pmod(F.xxhash64("vec_id", "vector"), split)).cast("int"))
    tasks = min(sum(splits), BUILD_TASKS)
    shards = shards.select("shard", "vec_id", "vector", "label").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return scratch.save(shards.sortWithinPartitions("shard").mapInArrow(_plant(kind, width), "shard int, tree binary, root binary"))


def _met(once: DataFrame, rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """Both together, each key's row of ``once`` before the key's ``rows``; ``tasks`` tasks share a key."""
    once = once.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("side", F.lit(0))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(tasks)).cast("int")).withColumn("side", F.lit(1))
    both = once.unionByName(rows, allowMissingColumns=True)
    return both.repartition(key, "salt").sortWithinPartitions(key, "salt", "side")


def _parted(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[memoryview, pa.RecordBatch]]:
    """Groups of queries with the payload of the row before them."""
    held = None
    for batch in batches:
        side, column = batch.column("side").to_numpy(), batch.column(payload)
        cuts = np.unique([0, *np.flatnonzero(side == 0), *(np.flatnonzero(side == 0) + 1), len(side)]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if side[a] == 0:
                held = column.slice(a, 1)
                continue
            for at in range(a, b, GROUP_ROWS):
                yield held, batch.slice(at, min(GROUP_ROWS, b - at))


def _asked(rows: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    plain = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in _NAMES if c != "vector"}
    return plain | {"vector": matrix(rows.column("vector"), width), "same": plain["same"].astype(bool)}


def _route(kind: type, width: int, best: bool):
    """Each query with the shards of a block that it must visit, or with the best of them alone, and that one's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shards = roots = None
        for held, rows in _parted(batches, "roots"):
            if held is not last:
                last, block = held, held[0].as_py()
                shards, roots = np.array([r["shard"] for r in block]), [pickle.loads(r["root"]) for r in block]
            bound = kind.reach(roots, _asked(rows, width))
            if best:
                shard = bound.argmax(1)
                row = np.flatnonzero(bound[np.arange(len(shard)), shard] > -np.inf)
                shard = shard[row]
            else:
                row, shard = np.nonzero(bound > -np.inf)
            columns = [pa.array(shards[shard], pa.int32()), pa.array(bound[row, shard])]
            columns += [rows.column(c).take(pa.array(row)) for c in _NAMES]
            yield pa.record_batch(columns, ["shard", "bound", *_NAMES])

    return run


def _search(k: int, leaves: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = tree = None
        for held, rows in _parted(batches, "tree"):
            if held is not last:
                last, tree = held, pickle.loads(held[0].as_buffer())
            at, found, score = tree.search(_asked(rows, width), k, leaves)
            yield pa.record_batch({"query": rows.column("query").take(pa.array(at)), "vec_id": pa.array(found), "score": pa.array(score)})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query, rank, vec_id, score: the k best of each query; a shard hands over k rows a query at most."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def search(trees: DataFrame, asked: DataFrame, kind: type, k: int, width: int, scratch: Scratch) -> DataFrame:
    """The k best vectors of each row of ``asked`` (``ASKED``; query is unique) within its window, ties to the smaller id."""
    numbered = trees.select("shard", "root", F.floor(F.col("shard") / ROOTS).cast("int").alias("block"))
    roots = numbered.groupBy("block").agg(F.collect_list(F.struct("shard", "root")).alias("roots"))
    last, tasks = numbered.agg(F.max("block")).first()[0], -(-asked.count() // TASK_QUERIES)
    if last is None or not tasks:
        none = asked.select("query", F.col("own").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
        return ranked(none, k)

    def searched(rows: DataFrame, best: bool, leaves: int | None) -> DataFrame:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(last)))
        met = _met(roots, rows.select(*_NAMES, blocks.alias("block")), "block", tasks)
        routed = met.mapInArrow(_route(kind, width, best), f"shard int, bound double, {ASKED}")
        if best and last:
            nearest = F.max_by(F.struct("shard", *_NAMES[1:]), F.struct("bound", -F.col("shard")))
            routed = routed.groupBy("query").agg(nearest.alias("x")).select("query", "x.*")
        both = _met(trees.select("shard", "tree"), routed.select("shard", *_NAMES), "shard", tasks)
        return both.mapInArrow(_search(k, leaves, width), "query long, vec_id long, score long")

    seen = ranked(searched(asked, True, 2), k).groupBy("query").agg(F.count("*").alias("seen"), F.min("score").alias("least"))
    floors = scratch.save(seen.filter(F.col("seen") == k).select("query", "least"))
    shared = asked.join(floors, "query", "left").withColumn("low", F.greatest("low", "least"))
    return ranked(searched(shared.select(*_NAMES), False, None), k)
