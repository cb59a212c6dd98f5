"""Coreference rules over mentions, and the rewritten text. Clusters are numbered per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that never replace a mention.
PRONOUNS = ("he", "her", "him", "his", "it", "she", "they")


def shortest_unique_alias(aliases: DataFrame, key: str = "coref_id", book: str = "book_id") -> DataFrame:
    """(book, key, alias): the shortest alias that no other cluster of the book owns, else the cluster's longest.

    aliases: book, key, alias, pos. Ties of length go to the earlier position (the later one for the longest).
    """
    lower = F.lower("alias")
    owners = aliases.groupBy(book, lower.alias("_l")).agg((F.min(key) == F.max(key)).alias("_own"))
    own = aliases.groupBy(book, key, "alias").agg(F.min("pos").alias("pos")).withColumn("_l", F.lower("alias"))
    own = own.join(owners, [book, "_l"])
    sort = F.struct(F.length("alias").alias("n"), "pos", "alias")
    picked = own.groupBy(book, key).agg(F.min(F.when(F.col("_own"), sort)).alias("unique"), F.max(sort).alias("longest"))
    return picked.select(book, key, F.coalesce("unique.alias", "longest.alias").alias("alias"))


def annotate(
    mentions: DataFrame, labels: DataFrame, profiled: DataFrame, distance: int = 3, window: int = 2, book: str = "book_id"
) -> DataFrame:
    """Adds ``label`` and ``rule`` (both, distance, ambiguity or null) to each mention.

    mentions: book, coref_id, sentence_id, end_token, prop, text; labels: book, coref_id, label; profiled: book, coref_id.
    The distance rule looks at the cluster's last mention of any kind; the ambiguity rule asks whether several profiled
    clusters are in the ``window`` sentences before and this one. Each cluster of a sentence is handed to the sentences
    that see it, so work is dealt by sentence, not by book.
    """
    last = Window.partitionBy(book, "coref_id").orderBy("end_token", "sentence_id")
    ago = F.col("sentence_id") - F.lag("sentence_id").over(last)
    far = F.coalesce(ago >= distance, F.lit(True))
    known = profiled.select(book, "coref_id").distinct()
    here = mentions.filter("coref_id >= 0").select(book, "coref_id", "sentence_id").distinct().join(known, [book, "coref_id"], "left_semi")
    ahead = F.explode(F.sequence(F.col("sentence_id"), F.col("sentence_id") + window))
    crowded = here.select(book, "coref_id", ahead.alias("sentence_id")).groupBy(book, "sentence_id").agg(
        (F.min("coref_id") < F.max("coref_id")).alias("_crowded")
    )
    own = mentions.join(labels.select(book, "coref_id", "label"), [book, "coref_id"], "left").withColumn("_far", far)
    own = own.join(known.withColumn("_known", F.lit(True)), [book, "coref_id"], "left")
    own = own.join(crowded, [book, "sentence_id"], "left")
    unclear = F.coalesce(F.col("_crowded") & F.col("_known") & (F.col("coref_id") >= 0), F.lit(False))
    silent = (
        (F.col("prop") == "PROP")
        | (F.col("coref_id") < 0)
        | ((F.col("text") == F.upper("text")) & F.contains(F.trim("text"), F.lit(" ")))
        | (F.coalesce("label", F.lit("")) == "")
        | F.col("label").startswith("CHARACTER_")
        | F.lower("label").isin(*PRONOUNS)
        | (F.lower("label") == F.lower("text"))
    )
    rule = F.when(F.coalesce(silent, F.lit(True)), None).when(F.col("_far") & unclear, "both").when(F.col("_far"), "distance")
    out = own.withColumn("rule", rule.when(unclear, "ambiguity"))
    return out.select(*mentions.columns, "label", "rule")


def last_mention_per_token(mentions: DataFrame, key: str, book: str = "book_id") -> DataFrame:
    """Of mentions that share a token the last one counts."""
    order = Window.partitionBy(book, key).orderBy(F.col("seq").desc())
    return mentions.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def _gap(items: Column, x: Column, i: Column, text: Column | None, start: Column | None) -> Column:
    """What stands before a token: nothing at the first and without a gap, the source where it is given, else a space."""
    before = F.get(items, i - 1)["end_char"]
    size = x["start_char"] - before
    space = F.lit(" ")
    if text is not None:
        space = F.when(size > 0, F.coalesce(F.substring(text, before - start + 1, size), F.lit(" "))).otherwise(space)
    return F.when((i == 0) | (size == 0), F.lit("")).otherwise(space)


def resolved_text(tokens: DataFrame, rules: DataFrame, book: str = "book_id", texts: DataFrame | None = None) -> DataFrame:
    """(book, chapter, text): tokens with their gaps and `` [label]`` after annotated ones; chapter -1 goes.

    tokens: book, chapter, token_id, text, start_char, end_char; rules: book, end_token, label (rule applied). A gap of no
    characters joins; any other is one space, or what the source has there if ``texts`` gives it (book, chapter,
    start_char, text: each chapter's own text). A chapter's tokens come together, as its text does.
    """
    marks = rules.select(book, F.col("end_token").alias("token_id"), F.concat(F.lit(" ["), F.col("label"), F.lit("]")).alias("mark"))
    own = tokens.filter("chapter >= 0").join(marks, [book, "token_id"], "left")
    piece = F.struct("token_id", "start_char", "end_char", "text", F.coalesce("mark", F.lit("")).alias("mark"))
    chapters = own.groupBy(book, "chapter").agg(F.array_sort(F.collect_list(piece)).alias("_items"))
    source = start = None
    if texts is not None:
        side = texts.select(book, "chapter", F.col("text").alias("_source"), F.col("start_char").alias("_start"))
        chapters, source, start = chapters.join(side, [book, "chapter"], "left"), F.col("_source"), F.col("_start")
    items = F.col("_items")
    pieces = F.transform(items, lambda x, i: F.concat(_gap(items, x, i, source, start), x["text"], x["mark"]))
    return chapters.select(book, "chapter", F.array_join(pieces, "").alias("text"))


def cluster_stats(mentions: DataFrame, profiles: DataFrame | None = None, book: str = "book_id") -> DataFrame:
    """(book, coref_id, canonical_name, mention_count, resolution_count, mentions) from annotated mentions.

    Profiles without mentions count 0; clusters without a profile get a placeholder name. ``mentions`` lists
    (end_token, text, rule) in order.
    """
    listed = F.array_sort(F.collect_list(F.struct("end_token", "text", "rule")))
    stats = mentions.filter("coref_id >= 0").groupBy(book, "coref_id").agg(
        F.count("*").alias("mention_count"), F.count("rule").alias("resolution_count"), listed.alias("mentions")
    )
    if profiles is None:
        return stats
    both = profiles.select(book, "coref_id", "canonical_name").join(stats, [book, "coref_id"], "full")
    return both.select(
        book, "coref_id",
        F.coalesce("canonical_name", F.concat(F.lit("CHARACTER_"), F.col("coref_id").cast("string"))).alias("canonical_name"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.coalesce("resolution_count", F.lit(0)).alias("resolution_count"),
        F.coalesce("mentions", F.array().cast(stats.schema["mentions"].dataType)).alias("mentions"),
    )


def rule_counts(mentions: DataFrame, *by: str) -> DataFrame:
    return mentions.filter("rule is not null").groupBy(*by, "rule").agg(F.count("*").alias("n"))


def top_clusters(stats: DataFrame, most: int = 20) -> DataFrame:
    """The report's clusters with most resolutions; ties by book and id."""
    return stats.orderBy(F.col("resolution_count").desc(), "book_id", "coref_id").limit(most)


def artifacts(mentions: DataFrame, profiles: DataFrame, chapters: DataFrame) -> dict[str, DataFrame]:
    """The tables that coreference leaves: clusters, the log of resolutions, and the chapters' resolved texts."""
    log = mentions.filter("rule is not null").select("book_id", "end_token", "coref_id", "text", "label", "rule")
    return {"clusters": cluster_stats(mentions, profiles), "log": log, "chapters": chapters}
