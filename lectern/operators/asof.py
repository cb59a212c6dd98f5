"""As-of retrieval over append-only node snapshots.

``seq`` orders snapshots as they were written; ties of version go to the first. The cursor filter stands below the
aggregation, which keeps one row a key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.segment import at_chapter


def effective_chapter(*chapters: str | Column) -> Column:
    """The greatest chapter that isn't null; null if all are."""
    columns = [F.col(c) if isinstance(c, str) else c for c in chapters]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def identity(node_type: Column, name: Column, source: Column, relation: Column, target: Column, chapter: Column, description: Column) -> Column:
    """Type and what tells its nodes apart; missing parts count as empty."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = (
        F.when(node_type == "Relationship", F.array(*map(empty, (source, relation, target))))
        .when(node_type == "PlotEvent", F.array(empty(chapter), empty(description)))
        .otherwise(F.array(empty(name)))
    )
    return F.struct(empty(node_type).alias("type"), parts.alias("parts"))


def is_actual(node_type: Column, realis: Column) -> Column:
    """False for events that are not actual; a missing realis is actual."""
    return ~((node_type == "PlotEvent") & (F.coalesce(realis, F.lit("actual")) != "actual"))


def snapshot(nodes: DataFrame, keys: Sequence[str], version: str, seq: str, cursor: int | Column) -> DataFrame:
    """The latest snapshot of each identity up to the cursor, with ``first_seq``, its place in the output's order.

    One aggregation, so one row a key and map task is shuffled. Versions are numbers.
    """
    cursor = cursor if isinstance(cursor, Column) else F.lit(cursor)
    seen, rest = nodes.filter(F.col(version) <= cursor), [c for c in nodes.columns if c not in keys]
    top = seen.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(version), F.col(seq))).alias("_top"), F.min(seq).alias("first_seq")
    )
    return top.select(*[F.col(c) if c in keys else F.col("_top")[c].alias(c) for c in nodes.columns], "first_seq")


def snapshots(nodes: DataFrame, cursors: DataFrame, keys: Sequence[str], version: str, seq: str, cursor: str) -> DataFrame:
    """The snapshot at each of many cursors, in one pass.

    Nodes and cursors meet once per (key, version): each snapshot is valid from its version to the next one of its key,
    so a cursor joins by interval instead of meeting every earlier version. Up to ``BROADCAST_CURSORS`` distinct cursors
    are broadcast; more meet the intervals on the strips of cursors that an interval touches, by equality.
    """
    each = Window.partitionBy(*keys).orderBy(version)
    first = Window.partitionBy(*keys, version).orderBy(seq)
    valid = nodes.filter(F.col(version).isNotNull()).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    valid = valid.drop("_n").withColumn("_until", F.lead(version).over(each))
    points = cursors.select(cursor).distinct()
    low, high, n = points.agg(F.min(cursor), F.max(cursor), F.count("*")).first()
    on = (F.col(version) <= F.col(cursor)) & (F.col("_until").isNull() | (F.col(cursor) < F.col("_until")))
    if n <= BROADCAST_CURSORS:
        return valid.join(F.broadcast(points), on).drop("_until")
    strip = lambda c: F.floor((c - low) / F.lit(max(1, -(-(high - low + 1) // STRIPS))))
    start, end = F.greatest(F.col(version), F.lit(low)), F.coalesce(F.least(F.col("_until") - 1, F.lit(high)), F.lit(high))
    valid = valid.filter(start <= end).withColumn("_strip", F.explode(F.sequence(strip(start), strip(end))))
    points = points.withColumn("_strip", strip(F.col(cursor)))
    return valid.join(points, (valid["_strip"] == points["_strip"]) & on).drop("_until", "_strip")


#: Cursors (one number each) up to which they are broadcast, and the strips of more.
BROADCAST_CURSORS, STRIPS = 100_000, 256


def versions(nodes: DataFrame, keys: Sequence[str], version: str, seq: str) -> DataFrame:
    """Each snapshot's first row with ``_until``, the next version of its identity (null for the last): what a cursor sees
    is the row with version <= cursor < _until. One shuffle and one sort, however many cursors there are."""
    order = Window.partitionBy(*keys).orderBy(version, seq)
    own = nodes.filter(F.col(version).isNotNull()).withColumn("_before", F.lag(version).over(order))
    own = own.filter(F.col("_before").isNull() | (F.col("_before") != F.col(version))).drop("_before")
    return own.withColumn("_until", F.lead(version).over(order))


def valid_at(version: str, cursor: str) -> Column:
    """Whether a row of ``versions`` is what a cursor sees."""
    return (F.col(version) <= F.col(cursor)) & (F.col("_until").isNull() | (F.col(cursor) < F.col("_until")))


def linked_versions(edges: DataFrame, seen: DataFrame, keys: Sequence[str], version: str, seq: str, ends: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``versions`` of relationships, none of which begins before both its endpoints can be seen.

    seen: ``by``, name and the version of nodes. A name stays visible once its first node is, so the endpoints' first versions
    move an edge's beginning, and no cursor has to look names up.
    """
    first = seen.filter((F.col("name") != "") & F.col(version).isNotNull()).groupBy(*by, "name").agg(F.min(version).alias("_first"))
    out = versions(edges, keys, version, seq)
    for end in ends:
        out = out.join(first.withColumnsRenamed({"name": end, "_first": f"_{end}"}), [*by, end])
    begin = F.greatest(F.col(version), *[F.col(f"_{end}") for end in ends])
    out = out.withColumn(version, begin).drop(*[f"_{end}" for end in ends])
    return out.filter(F.col("_until").isNull() | (F.col(version) < F.col("_until")))


def effective_ordinal(
    nodes: DataFrame, chapter_index: DataFrame, own: str, chapter: str, book: str = "book_id"
) -> DataFrame:
    """Adds ``effective_ordinal``: the node's own, else the last ordinal of its chapter."""
    index = chapter_index.select(F.col(book).alias("_book"), F.col("chapter").alias("_chapter"), F.col("last_ordinal").alias("_last"))
    joined = nodes.join(index, (F.col(book) == F.col("_book")) & (F.col(chapter) == F.col("_chapter")), "left")
    return joined.withColumn("effective_ordinal", F.coalesce(own, "_last")).drop("_book", "_chapter", "_last")


def cursor_ordinals(cursors: DataFrame, chapter_index: DataFrame, cursor: str = "cursor", book: str = "book_id") -> DataFrame:
    """(book, cursor, ordinal): the last ordinal of the cursor's chapter, else of the chapters before; null if there are none."""
    met = at_chapter(cursors, chapter_index, book, cursor)
    return met.select(book, cursor, F.coalesce("own.last_ordinal", "before").alias("ordinal"))


def book_snapshot(
    nodes: DataFrame, chapter_index: DataFrame, cursors: DataFrame, keys: Sequence[str], own: str, chapter: str, seq: str, book: str = "book_id"
) -> DataFrame:
    """Each book's snapshot at its reader's chapter, by chunk ordinals: what a node's ordinal, or else the end of its chapter,
    leaves visible. cursors: book, cursor (one row a book). Books whose cursor has no ordinal show nothing."""
    at = cursor_ordinals(cursors, chapter_index, "cursor", book).select(book, F.col("ordinal").alias("_cursor"))
    known = effective_ordinal(nodes, chapter_index, own, chapter, book).join(at, book)
    seen = snapshot(known, [book, *keys], "effective_ordinal", seq, F.col("_cursor"))
    return seen.drop("_cursor")


def relationship_chapter(own: Column, source_first: Column, target_first: Column) -> Column:
    both = F.when(source_first.isNotNull() & target_first.isNotNull(), F.greatest(source_first, target_first))
    return F.coalesce(own, both)


def visible_edges(
    edges: DataFrame,
    names: DataFrame,
    version: str,
    seq: str,
    cursor: int | Column,
    source: str = "source",
    relation: str = "relation",
    target: str = "target",
    name: str = "name",
    by: Sequence[str] = (),
) -> DataFrame:
    """Relationships up to the cursor whose endpoints are both among the visible names, the latest of each identity.

    ``by``: columns of both tables, such as the book, within which names count.
    """
    known = names.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(name).alias("_name")).filter(F.col("_name") != "").distinct()
    seen = edges.filter(F.col(version) <= (cursor if isinstance(cursor, Column) else F.lit(cursor)))
    for end in (source, target):
        on = F.col(end) == F.col("_name")
        for c in by:
            on &= F.col(c) == F.col(f"_{c}")
        seen = seen.join(known, on, "left_semi")
    return snapshot(seen, [*by, source, relation, target], version, seq, cursor)


def expand_neighbours(
    edges: DataFrame, seeds: DataFrame, degree_cap: int = 50, cap: int = 20, source: str = "source", target: str = "target"
) -> DataFrame:
    """(name, hop): seeds first, then neighbours one hop away, in the order of seeds and edges; ``cap`` names in all.

    Edges have no direction and self loops don't count; a seed with more than ``degree_cap`` edges isn't expanded.
    seeds: (name, rank); edges have a ``seq``. Seeds beyond ``cap`` are cut too: the result never has more names.
    """
    ends = edges.filter(F.col(source) != F.col(target)).select("seq", F.col(source).alias("_a"), F.col(target).alias("_b"))
    both = ends.union(ends.select("seq", F.col("_b"), F.col("_a")))
    near = both.join(seeds.select(F.col("name").alias("_a"), "rank"), "_a")
    fan = near.groupBy("_a").agg(F.count("*").alias("fan")).filter(F.col("fan") <= degree_cap)
    found = near.join(fan, "_a").groupBy(F.col("_b").alias("name")).agg(F.min(F.struct("rank", "seq")).alias("at"))
    found = found.join(seeds.select("name"), "name", "left_anti").select("name", F.lit(1).alias("hop"), "at.rank", "at.seq")
    own = seeds.select("name", F.lit(0).alias("hop"), "rank", F.lit(0).cast("long").alias("seq"))
    return own.unionByName(found).orderBy("hop", "rank", "seq", "name").limit(cap).select("name", "hop")
