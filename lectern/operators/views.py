"""Serving views and reader state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import chapter_title, last_error_line, sentence_key, shortened, title_of_id, word_count


def latest(rows: DataFrame, *keys: str, at: str = "updated_at") -> DataFrame:
    """The last row of each key: stores of progress, cutoffs, manifests and cards as append-only logs.

    Of rows of one time the greatest in its other columns counts, so reruns agree.
    """
    rest = [c for c in rows.columns if c not in keys]
    ties = [F.to_json(F.col(c)) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest if c != at]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col("_top")[c].alias(c) for c in rows.columns])


def cutoffs(log: DataFrame) -> DataFrame:
    """(book_id, chapter, cutoff): the last set of each chapter; a cleared one is gone. log: book_id, chapter, cutoff, op, updated_at."""
    return latest(log, "book_id", "chapter").filter("op <> 'clear'").select("book_id", "chapter", "cutoff")


def pipeline_status(stages: DataFrame, states: DataFrame) -> DataFrame:
    """(book_id, status, ready_for_query, stages): each book's stages in order, errors without their traces.

    stages: book_id, position, stage, status, error; states: book_id, status, ready_for_query.
    """
    item = F.struct("position", "stage", "status", last_error_line(F.col("error")).alias("error"))
    per = stages.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("stages"))
    return states.select("book_id", "status", "ready_for_query").join(per, "book_id", "left")


def annotations_of(annotations: DataFrame, book_id: str, chapter: int) -> DataFrame:
    return annotations.filter((F.col("book_id") == book_id) & (F.col("chapter") == chapter))


def ready_books(states: DataFrame, chapters: DataFrame, progress: DataFrame) -> DataFrame:
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"))
    own = states.filter("ready_for_query").select("book_id").distinct()
    out = own.join(counts, "book_id", "left").join(progress.select("book_id", "current_chapter"), "book_id", "left")
    return out.select(
        "book_id", title_of_id(F.col("book_id")).alias("title"), F.coalesce("chapters", F.lit(0)).alias("chapters"),
        F.coalesce("current_chapter", F.lit(1)).alias("current_chapter"),
    )


def chapter_list(chapters: DataFrame, ready: DataFrame) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy("chapter")
    return chapters.join(ready.select("book_id"), "book_id", "left_semi").select(
        "book_id", "chapter", chapter_title(F.col("text"), F.col("chapter")).alias("title"), word_count(F.col("text")).alias("words"),
        F.lag("chapter").over(order).isNotNull().alias("has_prev"), F.lead("chapter").over(order).isNotNull().alias("has_next"),
    )


def graph_nodes(nodes: DataFrame, max_chapter: int | None = None) -> DataFrame:
    """(id, label, type, chapter): the first record of each identity. nodes: type, name, description, chapter, seq."""
    event = F.col("type") == "PlotEvent"
    name = F.coalesce(F.nullif("name", F.lit("")), F.substring("description", 1, 40))
    own = nodes.filter("type <> 'Relationship'").withColumn("_key", F.concat_ws(":", "type", F.when(event, F.substring("description", 1, 40)).otherwise(name)))
    if max_chapter:
        own = own.filter(F.col("chapter").isNull() | (F.col("chapter") == 0) | (F.col("chapter") <= max_chapter))
    first = Window.partitionBy("_key").orderBy("seq")
    own = own.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    label = F.when(event, shortened(F.col("description"), 30)).otherwise(name)
    return own.select(F.col("_key").alias("id"), label.alias("label"), "type", "chapter")


def graph_edges(relations: DataFrame, events: DataFrame) -> DataFrame:
    """(from_id, to_id, label): relationships between characters, and participants of events."""
    own = relations.select(
        F.concat(F.lit("Character:"), F.col("source")).alias("from_id"),
        F.concat(F.lit("Character:"), F.col("target")).alias("to_id"),
        F.col("relation").alias("label"),
    )
    part = events.select(F.explode("participants").alias("who"), "description").select(
        F.concat(F.lit("Character:"), F.col("who")).alias("from_id"),
        F.concat(F.lit("PlotEvent:"), F.substring("description", 1, 40)).alias("to_id"),
        F.lit("participates_in").alias("label"),
    )
    return own.unionByName(part)


def graph_scope(full: Column, explicit: Column, progress: Column) -> Column:
    return F.when(full, None).otherwise(F.coalesce(explicit, progress))


def expanded_cards(cards: DataFrame, *keys: str, most: int = 2, at: str = "updated_at", tie: str = "id") -> DataFrame:
    """Adds ``expanded``: the newest ``most`` cards of each key; with no more cards than that, all of them."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), tie)
    return cards.withColumn("expanded", F.row_number().over(order) <= most)


def advanced_cursor(moves: DataFrame, *keys: str, sid: str = "sid") -> DataFrame:
    """(keys, cursor): the furthest sentence reached; a cursor never goes back."""
    return moves.groupBy(*keys).agg(F.max_by(sid, sentence_key(F.col(sid))).alias("cursor"))


def hidden(sid: Column, fog_start: Column) -> Column:
    return sentence_key(sid) > sentence_key(fog_start)


def can_open(chapter: Column, current: Column) -> Column:
    return chapter <= current + 1


def progress_fraction(current: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), current / F.greatest(total, F.lit(1)))) * 100


def sentence_marks(sentences: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds ``mark`` to sentences: ask before note before highlight, null without a card."""
    rank = F.when(F.col("kind") == "ask", 0).when(F.col("kind") == "note", 1).otherwise(2)
    best = cards.groupBy(F.col("anchor").alias("sid")).agg(F.min_by("kind", rank).alias("mark"))
    return sentences.join(best, "sid", "left")


def fold_cards(events: DataFrame) -> DataFrame:
    """Cards as an event log leaves them: the last create or update of each id, deleted ones gone. events: id, op, at, ..."""
    return latest(events, "id", at="at").filter("op <> 'delete'").drop("op")


def new_questions(asked: DataFrame, cards: DataFrame) -> DataFrame:
    """Questions whose anchor has no ask card yet; the others reuse their card."""
    return asked.join(cards.filter("kind = 'ask'").select("anchor"), "anchor", "left_anti")


def follow_ups(cards: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``thread``, a card's follow-ups in order (null without any). replies: id, at, text."""
    per = replies.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("thread"))
    return cards.join(per, "id", "left")


def found_card(cards: DataFrame, anchor: str, kind: str) -> DataFrame:
    """The first card of an anchor and kind, if there is one."""
    return cards.filter((F.col("anchor") == anchor) & (F.col("kind") == kind)).orderBy("id").limit(1)


def page_cards(cards: DataFrame, anchors: DataFrame, *keys: str) -> DataFrame:
    """Cards of a page's margin without highlights, the two newest of each key expanded."""
    own = cards.filter("kind <> 'highlight'").join(anchors.select("anchor"), "anchor", "left_semi")
    return expanded_cards(own, *keys)


def with_overrides(cards: DataFrame, opened: DataFrame, *keys: str, most: int = 2, at: str = "updated_at") -> DataFrame:
    """Adds ``expanded``: the newest ``most`` cards of each key, changed by what the reader opened.

    Each card that was opened and isn't expanded takes the place of the oldest expanded one, in the order of opening. With
    no more than ``most`` cards all are expanded. opened: id, seq. A fold over each key's cards, a reader's page.
    """
    cards = cards.join(opened.groupBy("id").agg(F.min("seq").alias("_seq")), "id", "left")
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(F.col(at).desc(), "id"))  # 1 is the newest
    opens = F.array_sort(F.collect_list(F.when(F.col("_seq").isNotNull(), F.struct("_seq", "_place"))).over(whole))
    cards = cards.withColumn("_place", place).withColumn("_n", F.count("*").over(whole)).withColumn("_opens", opens)
    first = F.sequence(F.lit(1), F.least(F.lit(most), F.col("_n").cast("int")))
    step = lambda open_, x: F.when(F.array_contains(open_, x["_place"]), open_).otherwise(
        F.array_append(F.array_remove(open_, F.array_max(open_)), x["_place"])
    )
    cards = cards.withColumn("expanded", (F.col("_n") <= most) | F.array_contains(F.aggregate("_opens", first, step), F.col("_place")))
    return cards.drop("_seq", "_place", "_n", "_opens")
