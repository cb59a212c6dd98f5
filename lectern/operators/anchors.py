"""Paragraphs and sentences of a chapter, anchored to tokens where annotations allow, else split by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_epigraph, is_ornament, paragraphs, sentences, strip
from lectern.operators.annotate import in_chapters


def locate_chapters(chapters: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Adds start_char and end_char of a chapter's text in its book's full text; null if it isn't there.

    A book's chapters come to its text, which is in one row.
    """
    own = chapters.groupBy("book_id").agg(F.collect_list(F.struct("chapter", "text")).alias("_chapters"))
    found = own.join(full_texts.select("book_id", F.col("text").alias("_full")), "book_id", "left")
    at = F.transform("_chapters", lambda x: F.struct(x["chapter"].alias("chapter"), x["text"].alias("text"), F.position(x["text"], F.col("_full")).alias("at")))
    rows = found.select("book_id", F.explode(at).alias("x"))
    start = F.nullif(F.col("x.at") - 1, F.lit(-1))
    rows = rows.select("book_id", "x.chapter", "x.text", start.alias("start_char"))
    return rows.withColumn("end_char", F.col("start_char") + F.length("text"))


def split_sentences(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, p, s, text) by paragraph breaks and sentence ends; p and s count from 1."""
    blocks = chapters.select("book_id", "chapter", F.posexplode(paragraphs(F.col("text"))).alias("p", "block"))
    rows = blocks.select("book_id", "chapter", (F.col("p") + 1).alias("p"), F.posexplode(sentences(F.col("block"))).alias("s", "text"))
    return rows.withColumn("s", F.col("s") + 1)


def token_sentences(located: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same from tokens: paragraphs in order of appearance, text from the least to the greatest character.

    located: book_id, chapter, text, start_char, end_char; tokens: book_id, paragraph_id, sentence_id, start_char, end_char.
    Tokens meet chapters on pages of characters, and a chapter's sentences are cut from its own text, in one row a chapter.
    A chapter with a negative id or an empty sentence gives no rows; ``anchored`` then falls back to rules.
    """
    places = tokens.select("book_id", "paragraph_id", "sentence_id", "start_char", "end_char")
    own = in_chapters(places, located, "start_char", "book_id").withColumnRenamed("_chapter", "chapter")
    groups = own.groupBy("book_id", "chapter", "paragraph_id", "sentence_id").agg(
        F.min("start_char").alias("lo"), F.max("end_char").alias("hi")
    )
    item = F.struct("paragraph_id", "sentence_id", "lo", "hi")
    whole = groups.groupBy("book_id", "chapter").agg(F.collect_list(item).alias("_items"))
    whole = whole.join(located.select("book_id", "chapter", "text", "start_char", "end_char"), ["book_id", "chapter"])
    cut = lambda x: strip(F.substring(F.col("text"), x["lo"] - F.col("start_char") + 1, x["hi"] - x["lo"]))
    slices = F.transform("_items", lambda x: F.struct(x["paragraph_id"].alias("paragraph_id"), x["sentence_id"].alias("sentence_id"), x["lo"].alias("lo"), cut(x).alias("text")))
    bad = F.exists("_slices", lambda x: (x["paragraph_id"] < 0) | (x["sentence_id"] < 0) | (x["text"] == ""))
    rows = whole.withColumn("_slices", slices).filter(~bad).select("book_id", "chapter", F.explode("_slices").alias("x")).select("book_id", "chapter", "x.*")
    chapter = Window.partitionBy("book_id", "chapter")
    rows = rows.withColumn("_first", F.min("lo").over(Window.partitionBy("book_id", "chapter", "paragraph_id")))
    p = F.dense_rank().over(chapter.orderBy("_first"))
    s = F.row_number().over(Window.partitionBy("book_id", "chapter", "paragraph_id").orderBy("sentence_id"))
    return rows.select("book_id", "chapter", p.alias("p"), s.alias("s"), "text")


def anchored(chapters: DataFrame, tokens: DataFrame, full_texts: DataFrame) -> DataFrame:
    """(book_id, chapter, p, s, sid, text, kind, fallback): token anchors, or rules for chapters without good ones."""
    by_token = token_sentences(locate_chapters(chapters, full_texts), tokens)
    good = by_token.select("book_id", "chapter").distinct()
    by_rule = split_sentences(chapters.join(good, ["book_id", "chapter"], "left_anti"))
    both = by_token.withColumn("fallback", F.lit(False)).unionByName(by_rule.withColumn("fallback", F.lit(True)))
    return classify(both)


def classify(rows: DataFrame) -> DataFrame:
    """Adds sid and kind: scene_break (one sentence ``***``), epigraph, body."""
    block = Window.partitionBy("book_id", "chapter", "p").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.array_join(F.collect_list("text").over(block), " ")
    rows = rows.withColumn("_whole", whole)
    kind = F.when(is_ornament(F.col("_whole")), "scene_break").when(is_epigraph(F.col("_whole"), F.col("p") - 1), "epigraph").otherwise("body")
    rows = rows.withColumn("kind", kind).filter((F.col("kind") != "scene_break") | (F.col("s") == 1)).drop("_whole")
    text = F.when(F.col("kind") == "scene_break", "***").otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("sid", F.concat(F.lit("p"), "p", F.lit(".s"), "s"))


def chapter_details(rows: DataFrame) -> DataFrame:
    """(book_id, chapter, paragraphs): nested paragraphs of anchored rows, in order."""
    lines = F.array_sort(F.collect_list(F.struct("s", "sid", "text")))
    blocks = rows.groupBy("book_id", "chapter", "p", "kind").agg(lines.alias("sentences"))
    nested = F.array_sort(F.collect_list(F.struct("p", "kind", "sentences")))
    return blocks.groupBy("book_id", "chapter").agg(nested.alias("paragraphs"))
