"""Exact dedup: Grace hash deduplication over Spark's shuffle files.

1. *Sizes.* Each text is normalised and digested; distinct digests with their byte counts are grouped by
   hexadecimal prefix. A bucket is a prefix; one whose texts exceed ``bucket_bytes`` is partitioned again by
   the next digit, until it fits or holds a single text.
2. *Pre-aggregation.* Each map task collapses its own copies in a table of bounded size, so a text that a third
   of all rows share leaves each task once, with the list of its documents.
3. *Partition and probe.* Records are shuffled to their bucket (the shuffle files are the spill files), sorted by
   bucket, and streamed through one open-addressing table per bucket, which compares complete contents.
4. The table's verdicts, without texts, are written to the shared folder and joined to the documents' ids; ids of a
   text with more than a partition's share of all rows are dealt to several tasks. ``keep_first``, which needs the
   rows themselves, sends each map task's least row of a text through the same buckets and passes the first on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import slices, texts
from lectern.llm.scratch import Scratch

BUCKET_BYTES = 64 << 20
FLUSH_BYTES = 24 << 20
_WHITE = b" \t\n\x0b\x0c\r"


def normalise(text: bytes | None) -> bytes:
    """Each run of the six ASCII blanks becomes one space; null counts as empty."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    out = b" ".join(words)
    if text[0] in _WHITE:
        out = b" " + out
    return out + b" " if text[-1] in _WHITE else out


class ContentTable:
    """Open addressing with linear probing; a cell matches only if the complete content does."""

    def __init__(self) -> None:
        self.cells = [-1] * 1024
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def slot(self, digest: bytes, content: bytes) -> int:
        cells, contents = self.cells, self.contents
        mask = len(cells) - 1
        i = int.from_bytes(digest[-8:], "little") & mask
        while (s := cells[i]) >= 0:
            if contents[s] == content:
                return s
            i = (i + 1) & mask
        cells[i] = len(contents)
        contents.append(content)
        self.digests.append(digest)
        self.bytes += len(content)
        if 2 * len(contents) >= len(cells):
            self._grow()
        return len(contents) - 1

    def _grow(self) -> None:
        mask = 4 * len(self.cells) - 1
        cells = [-1] * (mask + 1)
        for s, digest in enumerate(self.digests):
            i = int.from_bytes(digest[-8:], "little") & mask
            while cells[i] >= 0:
                i = (i + 1) & mask
            cells[i] = s
        self.cells = cells


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return map(normalise, texts(batch))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        own = list(_texts(batch))
        yield pa.record_batch(
            {
                "digest": pa.array([hashlib.sha256(t).hexdigest() for t in own], pa.string()),
                "n_bytes": pa.array([len(t) for t in own], pa.int64()),
            }
        )


def _packed(table: ContentTable, members: list[list]) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(members):
        end, size = at, 0
        while end < len(members) and (end == at or size < (8 << 20)):
            size += len(table.contents[end]) + 8 * len(members[end])
            end += 1
        yield pa.record_batch(
            {
                "digest": pa.array([d.hex() for d in table.digests[at:end]], pa.string()),
                "content": pa.array(table.contents[at:end], pa.binary()),
                "ids": pa.array(members[at:end], pa.list_(pa.int64())),
            }
        )
        at = end


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, members, ids = ContentTable(), [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
            s = table.slot(hashlib.sha256(text).digest(), text)
            if s == len(members):
                members.append([])
            members[s].append(doc_id)
            ids += 1
            if table.bytes + 8 * ids > FLUSH_BYTES:
                yield from _packed(table, members)
                table, members, ids = ContentTable(), [], 0
    yield from _packed(table, members)


_VERDICTS = "bucket string, slot long, digest string, row long, ids array<long>, keep_id long, keep_row long, keep_pos long, size long"


def _least(ids: list) -> tuple:
    """Sorts like the least id of a list, nulls last, with its place."""
    return min((x is None, x or 0, p) for p, x in enumerate(ids))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: a row for each record with its slot, then a row for each slot with its verdict."""
    bucket, table, best, row, out = None, ContentTable(), [], 0, []

    def close() -> None:
        for s, (least, n, digest) in enumerate(best):
            (null, keep_id, pos), at = least
            out.append((bucket, s, digest, None, None, None if null else keep_id, at, pos, n))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 9
        out.clear()
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4]
        names = [x.split()[0] for x in _VERDICTS.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for batch in slices(batches, "content"):
        columns = (batch.column(c).to_pylist() for c in ("bucket", "digest", "content", "ids"))
        for b, digest, content, ids in zip(*columns, strict=True):
            if b != bucket:
                close()
                bucket, table, best = b, ContentTable(), []
            s = table.slot(bytes.fromhex(digest), content)
            here = (_least(ids), row)
            if s == len(best):
                best.append((here, len(ids), digest))
            else:
                best[s] = (min(best[s][0], here, key=lambda x: (x[0][:2], x[1])), best[s][1] + len(ids), digest)
            out.append((b, s, digest, row, ids, None, None, None, None))
            row += 1
        yield flush()
    close()
    yield flush()


def exact_dedup(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the smallest id stays; null ids come last, and of rows that repeat
    both id and text one stays. A group of null ids alone has a null ``keep_id`` and keeps one row. An empty table
    gives no rows; other columns of ``documents`` are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = _sizes(scratch, docs)
    records = docs.mapInArrow(_collapse, "digest string, content binary, ids array<long>")
    records = _with_buckets(records, sizes, bucket_bytes)
    verdicts = scratch.save(
        records.repartition(F.col("bucket"))
        .sortWithinPartitions("bucket")
        .select("bucket", "digest", "content", "ids")
        .mapInArrow(_probe, _VERDICTS)
    )
    scratch.drop(sizes)
    groups = verdicts.filter(F.col("ids").isNull()).select("bucket", "slot", "keep_id", "keep_row", "keep_pos", "size")
    rows = verdicts.filter(F.col("ids").isNotNull()).select("bucket", "slot", "digest", "row", "ids")
    return (
        _met(rows, groups)
        .select("*", F.posexplode("ids").alias("pos", "id"))
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            F.col("size").alias("group_size"),
            ((F.col("row") == F.col("keep_row")) & (F.col("pos") == F.col("keep_pos"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's verdict. Groups of more than a partition's share of all ids, at most as many as there are
    partitions, are known to every task: their rows are dealt by number, and their verdict is there for each deal."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1024, (groups.agg(F.sum("size")).first()[0] or 0) // parts)
    key = ["bucket", "slot"]
    hot = groups.filter(F.col("size") > share).select(*key, F.ceil(F.col("size") / share).cast("int").alias("salts"))
    hot, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("salt", F.pmod("row", salts).cast("int")).drop("salts")
    groups = groups.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return rows.join(groups, [*key, "salt"])


def _sizes(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(digest, n_bytes) of distinct texts."""
    digests = docs.select("text").mapInArrow(_digests, "digest string, n_bytes long")
    return scratch.save(digests.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes")))


def _prefix(digest: Column, depth: int) -> Column:
    return F.substring(digest, 1, depth)


def _with_buckets(records: DataFrame, sizes: DataFrame, bucket_bytes: int) -> DataFrame:
    """Adds ``bucket``: the shortest prefix, from a length that suits even sizes, whose texts fit or hold one digest."""
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = 2
    while total / 16**depth > bucket_bytes / 2:
        depth += 1
    records = records.withColumn("bucket", _prefix(F.col("digest"), depth))
    open_ = sizes
    while depth < 64:
        large = (
            open_.groupBy(_prefix(F.col("digest"), depth).alias("large"))
            .agg(F.sum("n_bytes").alias("total"), F.count("*").alias("n"))
            .filter((F.col("total") > bucket_bytes) & (F.col("n") > 1))
            .select("large")
        )
        if large.isEmpty():
            break
        records = (
            records.join(large, F.col("bucket") == F.col("large"), "left")
            .withColumn(
                "bucket", F.when(F.col("large").isNotNull(), _prefix(F.col("digest"), depth + 1)).otherwise(F.col("bucket"))
            )
            .drop("large")
        )
        open_ = open_.join(large, _prefix(F.col("digest"), depth) == F.col("large"), "left_semi")
        depth += 1
    return records


def _least_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a window's equal texts the row with the least id, nulls last; windows are of bounded bytes."""
    table, best, window, rows = ContentTable(), [], [], 0

    def flush() -> pa.RecordBatch:
        at = pa.array(sorted(b[2] for b in best), pa.int64())
        whole = pa.Table.from_batches(window).take(at).combine_chunks()
        digest = {b[2]: d.hex() for b, d in zip(best, table.digests, strict=True)}
        columns = [*(whole[c].combine_chunks() for c in ("row", "id")), pa.array([digest[i] for i in at.to_pylist()], pa.string())]
        return pa.record_batch(columns, ["row", "id", "digest"])

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
            s = table.slot(hashlib.sha256(text).digest(), text)
            here = (doc_id is None, doc_id or 0, rows)
            if s == len(best):
                best.append(here)
            elif here < best[s]:
                best[s] = here
            rows += 1
        window.append(batch)
        if table.bytes > FLUSH_BYTES or rows > 100_000:
            yield flush()
            table, best, window, rows = ContentTable(), [], [], 0
    if best:
        yield flush()


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, digest and id: the first of each content passes."""
    bucket, table = None, ContentTable()
    for batch in slices(batches):
        first = []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "digest"))
        for b, digest, text in zip(*columns, _texts(batch), strict=True):
            if b != bucket:
                bucket, table = b, ContentTable()
            before = len(table.contents)
            first.append(table.slot(bytes.fromhex(digest), text) == before)
        yield batch.select(["row"]).filter(pa.array(first, pa.bool_()))


def _beside(place: int, run):
    """``run`` on batches whose rows' text, a field of ``row``, is also a column, without a copy."""

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.struct_field(b.column("row"), [place])
            yield pa.record_batch([*b.columns, text], [*b.schema.names, "text"])

    return lambda batches: run(widened(batches))


def keep_first(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The input's rows that stay, with all their columns: one row of each group of equal texts, as in ``exact_dedup``.

    Rows that repeat an id with other texts are judged by their own text. Whole rows cross the network once, after each
    map task has dropped its own copies.
    """
    scratch, own = Scratch(documents.sparkSession, "exact-dedup"), documents.columns
    text = F.col(text_col).cast("string")
    docs = documents.withColumn(text_col, text).select(F.struct(*own).alias("row"), F.col(id_col).cast("long").alias("id"))
    place, row = own.index(text_col), docs.schema["row"]
    sizes = _sizes(scratch, documents.select(text.alias("text")))
    schema = T.StructType([row, T.StructField("id", T.LongType()), T.StructField("digest", T.StringType())])
    records = _with_buckets(docs.mapInArrow(_beside(place, _least_rows), schema), sizes, bucket_bytes)
    ordered = records.repartition(F.col("bucket")).sortWithinPartitions("bucket", "digest", F.col("id").asc_nulls_last())
    kept = ordered.select("row", "bucket", "digest").mapInArrow(_beside(place, _first_rows), T.StructType([row]))
    kept = kept.select(*[F.col("row")[c].alias(c) for c in own])
    return kept.withColumn(text_col, F.col(text_col).cast(documents.schema[text_col].dataType))
