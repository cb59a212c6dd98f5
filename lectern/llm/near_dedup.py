"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch filter, exact check.

* A document's set is its distinct word shingles, as 128 bits over BLAKE2b digests of their words; the sketch is the
  ``SKETCH`` least first halves. Documents with equal sets collapse to one node, so copies never meet again. Whatever
  decides (equal sets, common shingles) compares all 128 bits. Sets too small to be linked with any other set (at 75 %: of one or
  two shingles) are done with that; all others need three common hashes at least.
* The sketches' values form inverted lists. A link at the threshold shares so much of both sketches that they
  overlap in at least ``_need`` values (a shortfall has a chance near 1e-9 a link at the threshold, less above; 0 for
  sets that fit in their sketch). With each sketch ordered from the rarest value to the most frequent, two linked
  documents therefore share one of their first ``size - need + 1`` values: only those are listed. Values of passages
  that many documents share come last and stay out of the lists unless they make up most of a document.
* A list's centre is its most typical member (the greatest mean log frequency of sketch values). Lists of one centre
  form a block, so a group of near copies, which shares dozens of lists, is one block. Each member is first tested
  against the centre, where the union sketch's estimate drops what is far below the threshold and complete sets
  decide; then the links' components are contracted.
* What is outside a block's largest component is tested, set against set, with every member of another component:
  both sides are dealt to tiles of bounded size, and a tile yields only links that connect components it has not
  connected yet. So no candidate pair between different components stays untested, and neither pairs nor links are
  ever spelled out for all of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import slices, texts
from lectern.llm.components import components
from lectern.llm.scratch import Scratch
from lectern.llm.shingles import WordDigests, ranks, shingle_sets

WORDS = 5
SKETCH = 64
#: Of SKETCH union-sketch values, as many are common to two linked documents, but for a chance near 1e-9.
NEED = 26
#: Sides of a tile: documents and bytes of their sets, on average.
TILE = {"outside": (256, 16 << 20), "members": (1024, 32 << 20)}
#: Bytes of a shingle.
WIDE = 16
#: Rows of one centre that a task takes without being dealt further, at least.
MIN_SHARE = 256
#: Nodes up to which their ids and digests (32 bytes each) are broadcast to find their texts; beyond, a shuffle join.
BROADCAST_NODES = 500_000


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch(words: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordDigests()
        for batch in slices(batches):
            n, digests, sketches = [], [], []
            for both, digest in shingle_sets(texts(batch), known, words):
                n.append(both.shape[1])
                digests.append(digest)
                sketches.append(np.unique(both[0])[:sketch])
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n": pa.array(n, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "sketch": _arrays(sketches),
                }
            )

    return run


def _sets(words: int):
    """The sets of the nodes' own texts, all first halves before all second ones; rows that repeat a node's id with another
    text give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordDigests()
        for batch in slices(batches):
            rows = zip(
                batch.column("node").to_pylist(),
                batch.column("digest").to_pylist(),
                shingle_sets(texts(batch), known, words),
                strict=True,
            )
            own = [(node, both.reshape(-1)) for node, digest, (both, found) in rows if found == digest]
            yield pa.record_batch({"node": pa.array([x[0] for x in own], pa.int64()), "hashes": _arrays([x[1] for x in own])})

    return run


def _set(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy().reshape(2, -1)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of the intersection of two sets a row."""
    for batch in batches:
        counts = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            both = np.concatenate([_set(x), _set(y)], 1)
            counts.append(both.shape[1] - int(ranks(both).max(initial=-1)) - 1)
        yield pa.record_batch(
            {**{c: batch.column(c) for c in ("a", "b", "n_a", "n_b")}, "common": pa.array(counts, pa.int64())}
        )


class _Roots(dict):
    """Union-find over the components that a tile sees."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x


def _tile_links(outside: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between different components, one for each two that a tile connects. Rows: node, component, hashes."""
    if not outside or not members:
        return []
    sizes = np.array([m[2].shape[1] for m in members])
    every = ranks(np.concatenate([x[2] for x in (*members, *outside)], 1))
    ends = int(sizes.sum()) + np.cumsum([x[2].shape[1] for x in outside])
    values, *asked = np.split(every, [int(sizes.sum()), *ends[:-1]])
    owners = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    roots, found = _Roots(), []
    for (node, component, _), hashes in zip(outside, asked, strict=True):
        first, last = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        hit = last > first
        if not hit.any():
            continue
        met = np.concatenate([owners[x:y] for x, y in zip(first[hit], last[hit], strict=True)])
        common = np.bincount(met, minlength=len(members))
        for i in np.flatnonzero(common * 100 >= (sizes + len(hashes) - common) * percent):
            here, there = roots.root(component), roots.root(members[i][1])
            if here != there:
                roots[here] = there
                found.append((node, members[i][0]))
    return found


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, found = None, ([], []), []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("centre", "i", "j", "side")), strict=True)
            rows = zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), strict=True)
            for (*tile, side), (node, component), hashes in zip(keys, rows, batch.column("hashes"), strict=True):
                if tile != key:
                    found += _tile_links(*sides, percent)
                    key, sides = tile, ([], [])
                sides[side].append((node, component, _set(hashes)))
            yield _links(found)
            found = []
        yield _links(_tile_links(*sides, percent))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("ab")})


def _need(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size * NEED / SKETCH)).cast("int")


class _Finder:
    """The nodes that may have links, and the tests between them."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, scratch: Scratch, percent: int, words: int) -> None:
        self.scratch, self.percent = scratch, percent
        # A node is a number, written with its digest, so links and components are of two longs whatever the set.
        unique = sigs.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        )
        self.unique = unique = scratch.save(unique.withColumn("node", F.monotonically_increasing_id()))
        unique = unique.filter(F.col("n") * 100 >= (F.col("n") + 1) * percent)
        values = unique.select("node", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
        often = values.groupBy("value").agg(F.count("*").alias("f")).filter(F.col("f") > 1)
        prefix = (
            values.join(often, "value")
            .groupBy("node", "size")
            .agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("shared"), F.sum(F.log("f")).alias("logs"))
            .withColumn("take", F.size("shared") - _need(F.col("size")) + 1)
            .filter(F.col("take") > 0)
            .select(
                "node",
                (F.col("logs") / F.col("size")).alias("typical"),
                F.expr("transform(slice(shared, 1, take), x -> x.value)").alias("prefix"),
            )
        )
        prefix = scratch.save(prefix)
        members = prefix.select("node", "typical", F.explode("prefix").alias("value"))
        lists = (
            members.groupBy("value")
            .agg(F.count("*").alias("members"), F.max(F.struct("typical", "node")).alias("top"))
            .filter(F.col("members") > 1)
            .select("value", F.col("top.node").alias("centre"))
        )
        self.blocks = scratch.save(members.join(lists, "value").select("centre", "node").distinct())
        self.nodes = scratch.save(unique.join(self.blocks.select("node").distinct(), "node"))
        scratch.drop(prefix)
        wanted = self.nodes.select("id", "node", "digest")
        wanted = F.broadcast(wanted) if self.nodes.count() <= BROADCAST_NODES else wanted
        found = docs.join(wanted, "id").filter(F.col("text").isNotNull())
        sets = found.select("node", "digest", "text").mapInArrow(_sets(words), "node long, hashes array<long>")
        self.sets = scratch.save(sets.dropDuplicates(["node"]))
        self._salts()

    def _salts(self) -> None:
        """Centres with more than a partition's share of the rows, and the number of salts that deals them evenly.

        There are at most as many of them as partitions, so their table is broadcast.
        """
        parts = int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = max(MIN_SHARE, self.blocks.count() // parts)
        hot = self.blocks.groupBy("centre").agg(F.count("*").alias("c")).filter(F.col("c") > share)
        self.hot = self.scratch.save(hot.select("centre", F.ceil(F.col("c") / share).cast("int").alias("salts")))

    def by_centre(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """rows (with a node) joined to a table of one row a centre; rows of a hot centre are dealt by their node."""
        hot, salts = F.broadcast(self.hot), F.coalesce("salts", F.lit(1))
        rows = rows.join(hot, "centre", "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("salts")
        table = table.join(hot, "centre", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return rows.join(table, ["centre", "salt"]).drop("salt")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that reach the threshold."""
        side = self.nodes.select("node", "n", "sketch")
        for x in "ab":
            pairs = pairs.join(
                side.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x
            )
        pairs = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
        both = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
        pairs = pairs.filter(both >= _need(F.size(union))).select("a", "b", "n_a", "n_b")
        for x in "ab":
            pairs = pairs.join(self.sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")), x)
        met = pairs.select("a", "b", "n_a", "n_b", "hashes_a", "hashes_b").mapInArrow(
            _overlaps, "a long, b long, n_a long, n_b long, common long"
        )
        reach = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * self.percent
        return met.filter(reach).select("a", "b")

    def labelled(self, links: DataFrame) -> DataFrame:
        """(node, component), from links found so far."""
        return self.scratch.save(components(links, self.scratch))

    def outside(self, labels: DataFrame) -> DataFrame:
        """(centre, node, component, main, n) of the blocks that hold several components; main is the largest of them."""
        own = self.nodes.select("node", "n").join(labels, "node", "left")
        own = own.withColumn("component", F.coalesce("component", "node"))
        blocks = self.blocks.join(own, "node")
        sizes = blocks.groupBy("centre", "component").agg(F.count("*").alias("c"))
        main = (
            sizes.groupBy("centre")
            .agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("kinds"))
            .filter(F.col("kinds") > 1)
            .select("centre", F.col("top.component").alias("main"))
        )
        return self.scratch.save(self.by_centre(blocks, main))

    def tiled(self, blocks: DataFrame) -> DataFrame:
        """Links between components of a block."""
        out = F.col("component") != F.col("main")
        counts = blocks.groupBy("centre").agg(
            F.count(F.when(out, 1)).alias("rows_outside"),
            F.count("*").alias("rows_members"),
            F.sum(F.when(out, F.col("n"))).alias("n_outside"),
            F.sum("n").alias("n_members"),
        )
        for side, (rows, size) in TILE.items():
            tiles = F.greatest(F.lit(1), F.ceil(F.col(f"rows_{side}") / rows), F.ceil(F.col(f"n_{side}") * WIDE / size))
            counts = counts.withColumn(f"tiles_{side}", tiles.cast("int"))
        rows = self.by_centre(blocks, counts.select("centre", "tiles_outside", "tiles_members")).join(self.sets, "node")
        every = {s: F.sequence(F.lit(0), F.col(f"tiles_{s}") - 1) for s in TILE}
        own = {s: F.array(F.pmod(F.xxhash64("node"), F.col(f"tiles_{s}")).cast("int")) for s in TILE}
        left = F.when(out, F.struct(F.lit(0).alias("side"), own["outside"].alias("i"), every["members"].alias("j")))
        right = F.struct(F.lit(1).alias("side"), every["outside"].alias("i"), own["members"].alias("j"))
        dealt = rows.select(
            "centre", "node", "component", "hashes", F.explode(F.array_compact(F.array(left, right))).alias("at")
        ).select("centre", "node", "component", "hashes", "at.side", F.explode("at.i").alias("i"), "at.j")
        dealt = dealt.select("centre", "i", F.explode("j").alias("j"), "side", "node", "component", "hashes")
        dealt = dealt.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "side")
        return dealt.mapInArrow(_tiles(self.percent), "a long, b long")

    def links(self) -> DataFrame:
        """Links enough to connect what any link connects."""
        star = self.blocks.filter(F.col("centre") != F.col("node"))
        star = star.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        found = self.scratch.save(self.linked(star))
        more = self.scratch.save(self.tiled(self.outside(self.labelled(found))))
        return found.union(more)


def near_dedup(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    words: int = WORDS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents whose sets reach ``percent`` (intersection over union) are linked; a component is what links reach, and
    its least doc_id stays. Texts that are null, empty or blank have no shingles and are linked with nothing; rows
    without an id take no part either (null component, kept). Rows that repeat an id are judged by their own
    texts. An empty table gives no rows; other columns of ``documents`` are ignored.
    """
    scratch = Scratch(documents.sparkSession, "near-dedup")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.save(docs.mapInArrow(_sketch(words, SKETCH), "id long, n long, digest binary, sketch array<long>"))
    finder = _Finder(docs, sigs.filter(F.col("id").isNotNull()), scratch, percent, words)
    labels = finder.labelled(finder.links())
    named = finder.unique.select("digest", "node", "id").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_digest = scratch.save(named.join(names, "component").select("digest", "component_id"))
    return (
        sigs.select("id", "n", "digest")
        .join(by_digest, "digest", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The input's rows that stay, with all their columns: the least id of each component.

    Rows of one id stay together, and go only if none of them is kept. Whole rows are shuffled only where too many ids go
    for a broadcast.
    """
    verdicts = near_dedup(documents, id_col, text_col, percent).filter(F.col("doc_id").isNotNull())
    gone = verdicts.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept")).filter("not kept")
    gone = Scratch(documents.sparkSession, "near-dedup").save(gone.select("gone_id"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    own = documents.columns
    rows = documents.select(F.struct(*own).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    rows = rows.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti")
    return rows.select(*[F.col("row")[c].alias(c) for c in own])
