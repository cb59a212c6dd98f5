"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

* *Targets.* Each source gets its weight's share of the words wanted; a target stops at ``max_repeats`` times the
  source's size and the excess is reshared by weight (water filling over the per-source table).
* *Blocks.* A document's place in its source is the order of a hash of its id; a block is a prefix of that hash, so
  a source has at most 4096 blocks at any size. A mix takes whole passes over a source and one part of a pass, which
  ends at the document that comes nearest to the target. The end is found by prefix sums over a source's blocks, then
  over the sub-blocks of the one block where it lies, then over that sub-block's documents: no window ever holds a
  source's documents.
* *Output shards.* A source's block draws (block, pass) are exact quotas. A binary tree splits them: each node hands
  its left half a multivariate-hypergeometric share. A shard then takes the next ``quota`` draws of the source's
  permuted blocks, so shards draw disjoint blocks. Rows move to their shard's partitions and are sorted there by a hash
  (the local shuffle).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS = 16
#: Sources that a task splits at once, on average; more of them are dealt to groups by a hash.
TREE_SOURCES = 10_000
#: Up to so many draws are broadcast to the documents; more are joined by a shuffle.
BROADCAST_DRAWS = 400_000
#: A shard of more words is cut into as many partitions as it needs, MAX_PIECES at most.
PIECE_WORDS = 4_000_000
MAX_PIECES = 10_000

_DIGITS = 3


def word_count(text: Column) -> Column:
    """The number of runs of characters other than the six ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from rows of (source, size). Windows here span the per-source table alone."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # The level at which this source and all that stop later would stand, if all that stop earlier had stopped.
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("stops", F.col("cap") < F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("weight") * final["level"])
    )
    return per.select("source", "source_size", target.alias("target"))


def _cuts(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds to each source its passes and ``cut``: the last place (hash, id, size) that the part of a pass takes."""
    goals = goals.filter(F.col("source_size") > 0).withColumnRenamed("source", "s")
    goals = goals.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("int")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    edge = goals.select("s", "rest", F.lit(0).cast("long").alias("base"), F.lit("").alias("prefix"))
    for digits in (_DIGITS, 2 * _DIGITS):
        inside = docs.join(edge, F.col("source").eqNullSafe(F.col("s")))
        blocks = (
            inside.filter(F.col("place").startswith(F.col("prefix")))
            .groupBy("source", F.substring("place", 1, digits).alias("block"))
            .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        )
        order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0))
        edge = (
            blocks.withColumn("start", start)
            .filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
            .select(F.col("source").alias("s"), "rest", F.col("start").alias("base"), F.col("block").alias("prefix"))
        )
    last = docs.join(edge, F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("source").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.filter(F.col("place").startswith(F.col("prefix")))
    start = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = (2 * start + F.col("size")) <= 2 * F.col("rest")
    cut = (
        last.withColumn("taken", taken)
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("taken"), F.struct("place", "id", "size"))).alias("cut"), F.first("prefix").alias("prefix")
        )
        .select(
            F.col("source").alias("cut_source"),
            F.coalesce(F.col("cut.place"), F.col("prefix")).alias("cut_place"),
            F.col("cut.id").alias("cut_id"),
            F.col("cut.size").alias("cut_size"),
        )
    )
    return goals.join(cut, F.col("s").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "rest")


def _counted(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        _place(F.col(id_col)).alias("place"),
    )


def _in_part() -> Column:
    """Whether a document's place lies in the taken part of the last pass."""
    own, cut = F.struct("place", "id", "size"), F.struct("cut_place", "cut_id", "cut_size")
    return F.coalesce(own <= cut, F.lit(False))


def plan_mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    The mix is made and written, and ``taken`` is counted from its rows. Sources are weighed in code point order, null
    last, by ``weights`` in turn; a null source is a source. Null texts have size 0 and sources without words a target
    of 0. Repeated rows are counted as often as they occur, null ids sort first, an empty table gives no rows, and other
    columns of ``documents`` don't change the plan.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    docs, goals, rows = _mixed(scratch, documents, id_col, text_col, source_col, weights, max_repeats, SHARDS, 0)
    mixed, keys = scratch.save(rows), ["id", "source", "size"]
    seen = docs.select(*keys, F.lit(1).alias("m"), F.lit(0).alias("n")).union(
        mixed.select(*keys, F.lit(0).alias("m"), F.lit(1).alias("n"))
    )
    # Rows of one key are taken alike.
    per = seen.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    goals = goals.withColumnRenamed("source", "s")
    return per.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.expr("size * (n div m)").alias("taken")
    )


def split_quotas(draws: np.ndarray, shards: int, rng: np.random.Generator, totals: np.ndarray | None = None) -> np.ndarray:
    """A (shards, sources) table of draws: each node's draws, in random order, are cut where its left half's draws end.

    totals: the shards' numbers of draws; without them halves get draws by their numbers of shards.
    """
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    n = int(draws.sum()) * left // shards if totals is None else int(totals[:left].sum())
    share = rng.multivariate_hypergeometric(draws, n, method="marginals") if n else np.zeros_like(draws)
    ends = (None, None) if totals is None else (totals[:left], totals[left:])
    return np.concatenate([split_quotas(share, left, rng, ends[0]), split_quotas(draws - share, shards - left, rng, ends[1])])


def _ends(shards: int, seed: int, split: Callable):
    """Where each shard's draws of a source end, for a group of sources whose draws in each shard are known."""

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(counts["source"], counts["count"], strict=True), key=lambda x: (x[0] is None, x[0] or ""))
        rng = np.random.default_rng([seed, int(counts["tree"].iloc[0])])
        totals = np.array(counts["totals"].iloc[0], np.int64)
        quotas = split(np.array([n for _, n in rows], np.int64), shards, rng, totals)
        return pd.DataFrame({"s": [s for s, _ in rows], "ends": list(quotas.cumsum(0).T)})

    return run


def _quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, ends) of all sources by one tree: at each node the draws of groups of sources are split first, then those of a
    group's sources, given the group's share. That is the joint draw over all sources; a task holds one group, and the
    driver a number a group (of ``TREE_SOURCES`` sources)."""
    n = counts.count()
    grouped = counts.withColumn("tree", F.pmod(F.xxhash64("source"), F.lit(max(1, -(-n // TREE_SOURCES)))))
    sizes = sorted(tuple(r) for r in grouped.groupBy("tree").agg(F.sum("count")).collect())
    whole = split_quotas(np.array([m for _, m in sizes], np.int64), shards, np.random.default_rng([seed]))
    totals = [(int(tree), column.tolist()) for (tree, _), column in zip(sizes, whole.T, strict=True)]
    table = counts.sparkSession.createDataFrame(totals, "tree long, totals array<long>")
    met = grouped.withColumn("tree", F.col("tree").cast("long")).join(table, "tree")
    return met.groupBy("tree").applyInPandas(_ends(shards, seed, split_quotas), "s string, ends array<long>")


def _draws(
    scratch: Scratch, docs: DataFrame, goals: DataFrame, shards: int, seed: int
) -> tuple[DataFrame, int]:
    """(s, b, passes, cut_*, deals) per block with draws, where deals are its (pass, mix_shard); and the number of draws."""
    cuts = scratch.save(_cuts(docs, goals).drop("source_size", "target"))
    blocks = docs.select("source", F.substring("place", 1, _DIGITS).alias("block")).distinct()
    blocks = blocks.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    in_part = F.coalesce(F.col("block") <= F.substring("cut_place", 1, _DIGITS), F.lit(False))
    draws = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).filter(
        (F.col("pass") < F.col("passes")) | in_part
    )
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "pass"), "block", "pass")
    draws = scratch.save(draws.withColumn("rank", F.row_number().over(order) - 1))
    counts = scratch.save(draws.groupBy("source").count())
    n_draws = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    ends = _quotas(counts, shards, seed)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("mix_shard")
    dealt = draws.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", "pass", "passes", "cut_place", "cut_id", "cut_size", shard)
    # A draw that no shard's quota holds is in no shard.
    dealt = dealt.filter(F.col("mix_shard") < shards).groupBy(
        F.col("source").alias("s"), F.col("block").alias("b"), "passes", "cut_place", "cut_id", "cut_size"
    )
    return dealt.agg(F.collect_list(F.struct("pass", "mix_shard")).alias("deals")), n_draws


def _mixed(
    scratch: Scratch,
    documents: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[float],
    max_repeats: int,
    shards: int,
    seed: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The counted documents, the sources' targets, and the mix: (row, id, source, size, mix_shard, mix_order).

    A partition of the mix holds one shard's rows, or an interval of them where a shard has more than ``PIECE_WORDS``
    words, and is sorted by ``mix_order``; partitions are in order too.
    """
    docs = scratch.save(_counted(documents, id_col, text_col, source_col))
    goals = scratch.save(targets(docs, weights, max_repeats))
    draws, n_draws = _draws(scratch, docs, goals, shards, seed)
    draws = scratch.save(draws)
    keyed = documents.select(
        F.struct(*documents.columns).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        _place(F.col(id_col)).alias("place"),
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, _DIGITS) == F.col("b"))
    taken = keyed.join(F.broadcast(draws) if n_draws <= BROADCAST_DRAWS else draws, same)
    taken = taken.withColumn("in_part", _in_part()).withColumn("deal", F.explode("deals"))
    taken = taken.filter((F.col("deal.pass") < F.col("passes")) | F.col("in_part"))
    rows = taken.select(
        "row",
        "id",
        "source",
        "size",
        F.col("deal.mix_shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed), "deal.mix_shard", "deal.pass", "place", "id").alias("mix_order"),
    )
    words = goals.agg(F.sum("target")).first()[0] or 0
    pieces = min(MAX_PIECES, max(1, math.ceil(words / shards / PIECE_WORDS)))
    # mix_order's interval among ``pieces`` equal ones
    piece = F.shiftright((F.shiftright("mix_order", 32) + F.lit(1 << 31)) * F.lit(pieces), 32)
    part = (F.col("mix_shard") * pieces + piece).cast("int")
    return docs, goals, rows.repartitionById(shards * pieces, part).sortWithinPartitions("mix_shard", "mix_order")


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the input's columns, once for each time that a document is taken, and ``mix_shard``, ``mix_order``.

    Partitions are output shards (a large shard is several in a row), sorted by ``mix_order``, which is random. The rows
    are those that ``plan_mix`` counts; the same input and seed give the same mix. Documents without words are taken with
    their block. Edge cases are as there.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    rows = _mixed(scratch, documents, id_col, text_col, source_col, weights, max_repeats, shards, seed)[2]
    return rows.select(*[F.col("row")[c].alias(c) for c in documents.columns], "mix_shard", "mix_order")
