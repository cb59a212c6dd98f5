"""Reading progress as a stream: state that Spark keeps instead of a polled file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def furthest_progress(moves: DataFrame, key: str = "user_id", position: str = "position") -> DataFrame:
    """The furthest position of each reader so far; works on batch and streaming frames alike (update mode)."""
    return moves.groupBy(key).agg(F.max(position).alias("furthest"), F.count("*").alias("moves"))


def activity(moves: DataFrame, at: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Moves per window; events later than ``late`` behind the newest are dropped by the watermark on streams."""
    marked = moves.withWatermark(at, late) if moves.isStreaming else moves
    counted = marked.groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("moves"))
    return counted.select(F.col("w.start").alias("start"), "moves")


def checked_moves(moves: DataFrame, books: DataFrame, chapter: str = "chapter", paragraph: str = "paragraph") -> DataFrame:
    """Moves that can be: of a known book, within its chapters, no paragraph below 0. books: book_id, chapters (a count)."""
    known = books.select("book_id", F.col("chapters").alias("_last"))
    own = moves.join(known, "book_id").filter(F.col(chapter).between(1, F.col("_last")))
    return own.filter(F.col(paragraph).isNull() | (F.col(paragraph) >= 0)).drop("_last")
