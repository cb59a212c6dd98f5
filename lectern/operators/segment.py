"""Segmentation: chunks, batches, and the index from chapters to chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from lectern.functions.text import paragraphs, strip, token_estimate


def segments(c: Column) -> Column:
    """Paragraphs if there are any breaks, else lines, else sentences; a blank text is one segment."""
    lines = F.when(F.contains(c, F.lit("\n\n")), F.split(c, "\n\n")).when(F.contains(c, F.lit("\n")), F.split(c, "\n"))
    parts = F.filter(F.coalesce(lines, F.split(c, r"(?<=\. )")), lambda x: strip(x) != "")
    return F.when(strip(c) == "", F.array(c)).otherwise(parts)


def separator(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\n\n")), "\n\n").when(F.contains(c, F.lit("\n")), "\n").otherwise(" ")


def _packed(sizes: pd.Series, gap: pd.Series, target: int) -> pd.Series:
    """Group numbers of a greedy fold: a new group starts if the next size would overrun and the group isn't empty."""

    def fold(row: list[int], sep: int) -> list[int]:
        out, group, filled = [], 0, 0
        for n in row:
            if filled and filled + n + sep > target:
                group, filled = group + 1, 0
            filled += n + (sep if filled else 0)
            out.append(group)
        return out

    return pd.Series([None if s is None else fold(s, g) for s, g in zip(sizes, gap, strict=True)])


def packed(sizes: Column, target: int, gap: Column | int = 0) -> Column:
    """Greedy packing: the group number of each element of an array of sizes. Only the sizes go to Python."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series, g: pd.Series) -> pd.Series:
        return _packed(s, g, target)

    return run(sizes.cast("array<int>"), (gap if isinstance(gap, Column) else F.lit(gap)).cast("int"))


def _spans(target: int):
    @pandas_udf(ArrayType(ArrayType(IntegerType())))
    def run(sizes: pd.Series, gap: pd.Series) -> pd.Series:
        """(first segment, segments, start, end) of each chunk of a text."""
        out = []
        for row, sep, groups in zip(sizes, gap, _packed(sizes, gap, target), strict=True):
            spans, at = [], 0
            for k, n in enumerate(row if row is not None else ()):
                if k and groups[k] == groups[k - 1]:
                    spans[-1][1] += 1
                    spans[-1][3] += int(n + sep)
                else:
                    at = int(spans[-1][3] + sep) if spans else 0
                    spans.append([k, 1, at, int(at + n)])
            out.append(None if row is None else spans)
        return pd.Series(out)

    return run


def chunk(texts: DataFrame, id_col: str, text_col: str, chunk_tokens: int = 1500) -> DataFrame:
    """(id, chunk, text, start_char, end_char): greedy chunks of about ``4 * chunk_tokens`` characters; segments stay whole.

    A text is cut, grouped and joined in its own row, so nothing is shuffled; only the segments' lengths go to Python.
    Null texts give no chunks; rows of one id are cut one by one.
    """
    text = F.col(text_col)
    cut = texts.select(F.col(id_col), segments(text).alias("_parts"), separator(text).alias("_sep"))
    sizes = F.transform("_parts", F.length).cast("array<int>")
    cut = cut.withColumn("_spans", _spans(4 * chunk_tokens)(sizes, F.length("_sep").cast("int")))
    cut = cut.select(id_col, "_parts", "_sep", F.posexplode("_spans").alias("chunk", "_x"))
    return cut.select(
        id_col,
        "chunk",
        F.expr("array_join(slice(_parts, _x[0] + 1, _x[1]), _sep)").alias("text"),
        F.col("_x")[2].alias("start_char"),
        F.col("_x")[3].alias("end_char"),
    )


def batches(chapters: DataFrame, book: str, order: str, text: str, size: int = 3, max_tokens: int | None = None) -> DataFrame:
    """Batches by token budget where one is given, else by a fixed number of chapters."""
    if max_tokens is not None:
        return budget_batches(chapters, book, order, text, max_tokens)
    return fixed_batches(chapters, book, order, text, size)


def rebuilt_chunks(batch_texts: DataFrame, chunk_tokens: int = 1500, book: str = "book_id") -> DataFrame:
    """Chunks of stored batch texts with their ordinals and ids: book, batch, chapter_numbers, text, ordinal, chunk_id, ...

    batch_texts: book, batch (a name that ends in its first chapter's number; 1 without one), text. Batches come in the
    order of their names.
    """
    key = F.struct(book, "batch").alias("_key")
    chunks = chunk(batch_texts.select(key, "text"), "_key", "text", chunk_tokens)
    chapter = F.coalesce(F.regexp_extract("_key.batch", r"_(\d+)", 1).try_cast("int"), F.lit(1))
    own = chunks.select(
        F.col(f"_key.{book}").alias(book), F.col("_key.batch").alias("batch"), F.array(chapter).alias("chapter_numbers"), "chunk", "text",
        "start_char", "end_char",
    )
    return stamp_ordinals(own, book, "batch", "chunk").drop("chunk")


def stamp_ordinals(chunks: DataFrame, book: str, *order: str) -> DataFrame:
    """Adds ``ordinal`` over a book's chunks and ``chunk_id``."""
    n = F.row_number().over(Window.partitionBy(book).orderBy(*order)) - 1
    return chunks.withColumn("ordinal", n).withColumn("chunk_id", F.format_string("%s::chunk_%04d", F.col(book), "ordinal"))


def fixed_batches(chapters: DataFrame, book: str, order: str, text: str, size: int) -> DataFrame:
    """(book, batch, first, n_items, text): consecutive groups of ``size`` chapters, joined by empty lines."""
    if size < 1:
        raise ValueError("a batch holds one chapter at least")
    n = F.row_number().over(Window.partitionBy(book).orderBy(order)) - 1
    return _joined(chapters.withColumn("batch", F.floor(n / size)), book, order, text)


def budget_batches(chapters: DataFrame, book: str, order: str, text: str, max_tokens: int) -> DataFrame:
    """The same, greedily up to a token budget; a chapter beyond it stands alone."""
    if max_tokens < 100:
        raise ValueError("the budget is 100 tokens at least")
    packed_books = chapters.groupBy(book).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), token_estimate(F.col(text)).alias("t")))).alias("_items")
    )
    groups = packed(F.transform("_items", lambda x: x["t"]), max_tokens)
    numbered = packed_books.withColumn("_groups", groups).select(
        book, F.explode(F.arrays_zip(F.col("_items").alias("item"), F.col("_groups").alias("group"))).alias("_x")
    )
    numbered = numbered.select(book, F.col("_x.item.o").alias(order), F.col("_x.group").alias("batch"))
    return _joined(chapters.join(numbered, [book, order]), book, order, text)


def _joined(batched: DataFrame, book: str, order: str, text: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        batched.groupBy(book, "batch")
        .agg(items.alias("_items"))
        .select(
            book,
            F.col("batch").cast("long").alias("batch"),
            F.element_at("_items", 1)["o"].alias("first"),
            F.size("_items").cast("long").alias("n_items"),
            F.array_join(F.transform("_items", lambda x: x["t"]), "\n\n").alias("text"),
        )
    )


def chapter_index(chunks: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter, first_ordinal, last_ordinal, paragraph_breakpoints); a chunk belongs to its first chapter.

    chunks: book, ordinal, chapter; chapters: book, chapter, text. Paragraph i of P lies in chunk
    ``min(i * K div P, K - 1)`` of the chapter's K.
    """
    key = [book, "chapter"]
    spans = chunks.groupBy(*key).agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count("*").alias("_k"))
    parts = chapters.select(*key, F.size(paragraphs(F.col("text"))).alias("_p"))
    index = spans.join(parts, key, "left").withColumn("_p", F.coalesce("_p", F.lit(0)))
    numbers = F.when(F.col("_p") > 0, F.sequence(F.lit(0), F.col("_p") - 1)).otherwise(F.array().cast("array<int>"))
    points = F.transform(numbers, lambda i: F.least(F.floor(i * F.col("_k") / F.col("_p")), F.col("_k") - 1).cast("int"))
    return index.select(*key, "first_ordinal", "last_ordinal", points.alias("paragraph_breakpoints"))


def ordinal_at(cursors: DataFrame, index: DataFrame, book: str = "book_id") -> DataFrame:
    """Adds ``ordinal`` to (book, chapter, paragraph): the chapter's last without a paragraph, else that of its breakpoint."""
    points, n = F.col("paragraph_breakpoints"), F.size("paragraph_breakpoints")
    at = F.get(points, F.greatest(F.lit(0), F.least(F.col("paragraph"), n - 1)))
    here = F.when(F.col("paragraph").isNull() | (n <= 0), F.col("last_ordinal")).otherwise(F.col("first_ordinal") + at)
    kept = [*cursors.columns]
    return cursors.join(index, [book, "chapter"], "left").select(*kept, here.alias("ordinal"))


def chapter_of(ordinals: DataFrame, index: DataFrame, book: str = "book_id") -> DataFrame:
    """Adds ``chapter`` to (book, ordinal): the first whose span holds it; null outside.

    Spans are spelled out as their ordinals, one per chunk, so both sides meet by equality.
    """
    own = index.select(book, "chapter", F.explode(F.sequence("first_ordinal", "last_ordinal")).alias("ordinal"))
    return ordinals.join(own.groupBy(book, "ordinal").agg(F.min("chapter").alias("chapter")), [book, "ordinal"], "left")


def at_chapter(cursors: DataFrame, index: DataFrame, book: str, chapter: str) -> DataFrame:
    """(book, chapter, own, before) per distinct cursor: the index row of its chapter, and the greatest last ordinal up to it.

    Cursors and index rows of a book are swept together in the order of chapters.
    """
    points = cursors.select(book, F.col(chapter).alias("_at")).distinct().withColumn("_kind", F.lit(1))
    rows = index.select(book, F.col("chapter").alias("_at"), F.lit(0).alias("_kind"), "first_ordinal", "last_ordinal")
    sweep = Window.partitionBy(book).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("chapter"), "first_ordinal", "last_ordinal"))
    swept = points.unionByName(rows, allowMissingColumns=True).select(
        book, "_at", "_kind", F.last(entry, ignorenulls=True).over(sweep).alias("own"), F.max("last_ordinal").over(sweep).alias("before")
    )
    own = F.when(F.col("own.chapter") == F.col("_at"), F.col("own"))
    return swept.filter("_kind = 1").select(book, F.col("_at").alias(chapter), own.alias("own"), "before")


def ordinal_before(cursors: DataFrame, index: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter, before): the last ordinal strictly before the chapter; -1 if there is none."""
    met = at_chapter(cursors, index, book, "chapter")
    before = F.when(F.col("own").isNotNull(), F.col("own.first_ordinal") - 1).otherwise(F.col("before"))
    return met.select(book, "chapter", F.coalesce(before, F.lit(-1)).alias("before"))
