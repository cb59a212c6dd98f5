"""Joins of token, mention, quote and profile annotations. Ids of tokens and clusters are numbered per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import shortened, strip

# Nominals that name nobody.
PLAIN_NOMINALS = (
    "he", "her", "him", "himself", "herself", "his", "i", "it", "its", "ma'am", "me", "my", "myself", "one", "our",
    "she", "sir", "their", "them", "themselves", "they", "us", "we", "you", "your", "yourself",
)
SENTENCE_ENDS = (".", "!", "?")
# Sheets of books without annotations, and classes that every sheet has.
DEFAULT_SHEETS = {
    "entities": "(no entities)", "quotes": "(no quotes)",
    "classes": "Character, Location, Faction, Organization, Object, PlotEvent, Theme",
    "relations": "(use your judgment — snake_case names like employs, loves, fights)",
}
CORE_CLASSES = ("PlotEvent", "Theme", "Relationship")


def fill_offsets(
    spans: DataFrame, tokens: DataFrame, start: str = "start_token", end: str = "end_token", book: str = "book_id"
) -> DataFrame:
    """Adds start_char and end_char from the book's tokens; a token that isn't there leaves 0."""
    for column, edge in ((start, "start_char"), (end, "end_char")):
        side = tokens.select(F.col(book).alias("_book"), F.col("token_id").alias("_id"), F.col(edge).alias("_edge"))
        spans = spans.drop(edge).join(side, (F.col(book) == F.col("_book")) & (F.col(column) == F.col("_id")), "left")
        spans = spans.withColumn(edge, F.coalesce("_edge", F.lit(0))).drop("_book", "_id", "_edge")
    return spans


def canonical_names(names: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, coref_id, canonical_name, aliases) of profiles: the alias with most counts, the first on ties; else a placeholder.

    names: book, coref_id, alias, n, pos; an id without aliases has a row with a null alias.
    """
    named = F.col("alias").isNotNull()
    top = names.groupBy(book, "coref_id").agg(
        F.min(F.when(named, F.struct(-F.col("n"), "pos", "alias")))["alias"].alias("alias"),
        F.map_from_entries(F.collect_set(F.when(named, F.struct("alias", F.col("n").cast("long").alias("n"))))).alias("aliases"),
    )
    name = F.coalesce("alias", F.concat(F.lit("CHARACTER_"), F.col("coref_id").cast("string")))
    return top.select(book, "coref_id", name.alias("canonical_name"), "aliases")


def enrich_names(profiles: DataFrame, mentions: DataFrame, book: str = "book_id") -> DataFrame:
    """Names for placeholder profiles: their most common proper mention, else their most common telling nominal.

    mentions: book, coref_id, prop, text, seq. Ties go to the text seen first. The counts of the texts of that kind
    become the profile's ``aliases``; named profiles keep theirs (null, if the column isn't there).
    """
    if "aliases" not in profiles.columns:
        profiles = profiles.withColumn("aliases", F.lit(None).cast("map<string,bigint>"))
    telling = ~F.lower("text").isin(*PLAIN_NOMINALS) & (F.length("text") > 2)
    tier = F.when(F.col("prop") == "PROP", 0).when((F.col("prop") == "NOM") & telling, 1)
    counts = mentions.filter(F.length("text") > 0).withColumn("tier", tier).filter("tier is not null")
    counts = counts.groupBy(book, "coref_id", "tier", "text").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    tiers = counts.groupBy(book, "coref_id", "tier").agg(
        F.min(F.struct(-F.col("n"), "first", "text"))["text"].alias("text"),
        F.map_from_entries(F.collect_list(F.struct("text", "n"))).alias("counts"),
    )
    best = tiers.groupBy(book, "coref_id").agg(F.min_by(F.struct("tier", "text", "counts"), "tier").alias("_b"))
    lower_start = F.substring("_b.text", 1, 1).rlike(r"^\p{Ll}")
    shown = F.when((F.col("_b.tier") == 1) & lower_start, F.initcap("_b.text")).otherwise(F.col("_b.text"))
    joined = profiles.join(best, [book, "coref_id"], "left")
    fill = F.col("canonical_name").startswith("CHARACTER_") & F.col("_b").isNotNull()
    return joined.select(
        *[c for c in profiles.columns if c not in ("canonical_name", "aliases")],
        F.when(fill, shown).otherwise(F.col("canonical_name")).alias("canonical_name"),
        F.when(fill, F.col("_b.counts")).otherwise(F.col("aliases")).alias("aliases"),
    )


def cluster_names(profiles: DataFrame, book: str = "book_id", seq: str = "seq") -> DataFrame:
    """(book, coref_id, canonical_name): of profiles that share an id the last one counts."""
    return profiles.groupBy(book, "coref_id").agg(F.max_by("canonical_name", seq).alias("canonical_name"))


def _named(rows: DataFrame, profiles: DataFrame, key: str, out: str, default: Column, book: str) -> DataFrame:
    side = profiles.select(F.col(book).alias("_book"), F.col("coref_id").alias("_id"), F.col("canonical_name").alias("_name"))
    joined = rows.join(side, (F.col(book) == F.col("_book")) & (F.col(key) == F.col("_id")), "left")
    return joined.withColumn(out, F.coalesce("_name", default)).drop("_book", "_id", "_name")


def speaker_names(quotes: DataFrame, profiles: DataFrame, key: str = "speaker_coref_id", book: str = "book_id") -> DataFrame:
    """Adds ``speaker_name``, Unknown without a profile."""
    return _named(quotes, profiles, key, "speaker_name", F.lit("Unknown"), book)


def entity_names(mentions: DataFrame, profiles: DataFrame, key: str = "coref_id", book: str = "book_id") -> DataFrame:
    """Adds ``canonical_name``, the mention's own text without a profile."""
    return _named(mentions, profiles, key, "canonical_name", F.col("text"), book)


def sentence_ids(tokens: DataFrame, book: str = "book_id") -> DataFrame:
    """Sentence ids by counting ends before a token, for books whose tokens all have sentence 0."""
    before = Window.partitionBy(book).orderBy("token_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.coalesce(F.sum(F.col("text").isin(*SENTENCE_ENDS).cast("int")).over(before), F.lit(0))
    unset = F.max("sentence_id").over(Window.partitionBy(book)) == 0
    return tokens.withColumn("sentence_id", F.when(unset, counted).otherwise(F.col("sentence_id")))


def parsed(tokens: DataFrame, mentions: DataFrame, quotes: DataFrame, names: DataFrame, book: str = "book_id") -> dict[str, DataFrame]:
    """All annotations of books, put together: profiles with names, tokens with sentences, mentions and quotes with names
    and characters.

    names: book, coref_id, alias, n, pos; mentions have a ``seq``. Profiles get their names first, from the profile file
    and then from mentions; names and offsets go to mentions and quotes after that.
    """
    profiles = enrich_names(canonical_names(names, book), mentions, book)
    return {
        "profiles": profiles,
        "tokens": sentence_ids(tokens, book),
        "mentions": fill_offsets(entity_names(mentions, profiles, book=book), tokens, book=book),
        "quotes": fill_offsets(speaker_names(quotes, profiles, book=book), tokens, book=book),
    }


def chapter_token_ranges(chapters: DataFrame, tokens: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter, first_token, end_token) of the tokens that start in a chapter's characters; (0, 0) for none."""
    met = in_chapters(tokens.select(book, "token_id", "start_char"), chapters, "start_char", book)
    spans = met.groupBy(book, F.col("_chapter").alias("chapter")).agg(
        F.min("token_id").alias("first"), (F.max("token_id") + 1).alias("end")
    )
    return chapters.select(book, "chapter").join(spans, [book, "chapter"], "left").select(
        book, "chapter", F.coalesce("first", F.lit(0)).alias("first_token"), F.coalesce("end", F.lit(0)).alias("end_token")
    )


#: Characters of a page. Points and chapters meet on the pages that they touch, so the range join is an equi-join.
PAGE = 4096


def _pages(c: Column) -> Column:
    return F.floor(c / PAGE)


def in_chapters(points: DataFrame, chapters: DataFrame, at: str, book: str) -> DataFrame:
    """A row for each point and chapter [start_char, end_char) that holds it, as ``_chapter``; points with an ``end_char``
    must end there too."""
    spans = chapters.select(
        F.col(book).alias("_book"), F.col("chapter").alias("_chapter"), F.col("start_char").alias("_start"), F.col("end_char").alias("_end")
    ).filter("_start < _end")
    spans = spans.withColumn("_page", F.explode(F.sequence(_pages(F.col("_start")), _pages(F.col("_end") - 1))))
    on = (F.col(book) == F.col("_book")) & (_pages(F.col(at)) == F.col("_page"))
    on &= (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end"))
    if "end_char" in points.columns:
        on &= points["end_char"] <= F.col("_end")
    return points.join(spans, on).drop("_book", "_page", "_start", "_end")


def assign_chapters(points: DataFrame, chapters: DataFrame, at: str = "start_char", book: str = "book_id") -> DataFrame:
    """Adds ``chapter``: the first of the book whose [start_char, end_char) holds the point; -1 outside.

    The chapter is found for each place of a book once, and joined back to the points.
    """
    places = points.select(book, at).distinct()
    found = in_chapters(places, chapters, at, book).groupBy(book, at).agg(F.min("_chapter").alias("_found"))
    out = points.join(found.withColumnsRenamed({book: "_book", at: "_at"}), (F.col(book) == F.col("_book")) & (F.col(at) == F.col("_at")), "left")
    return out.withColumn("chapter", F.coalesce("_found", F.lit(-1))).drop("_book", "_at", "_found")


def _lines(rows: DataFrame, line: Column, most: int, book: str, seq: str) -> DataFrame:
    """(book, lines): each book's first ``most`` rows in order."""
    order = Window.partitionBy(book).orderBy(seq)
    top = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).withColumn("_line", line)
    items = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_r", "_line"))))
    return top.groupBy(book).agg(F.transform(items, lambda s: s["_line"]).alias("lines"))


def cheat_sheet(mentions: DataFrame, limit: int = 50, book: str = "book_id", seq: str = "seq") -> DataFrame:
    """(book, sheet): the first proper and nominal mentions of each book as prompt lines."""
    own = mentions.filter(F.col("prop").isin("PROP", "NOM") & (strip(F.col("text")) != ""))
    tail = F.concat("text", F.lit(" ("), F.coalesce("cat", F.lit("?")), F.lit(")"))
    line = F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("#"), F.col("coref_id").cast("string"), F.lit(" ")), F.lit("")), tail)
    return _lines(own, line, limit, book, seq).select(book, F.array_join("lines", "\n").alias("sheet"))


def quote_sheet(quotes: DataFrame, limit: int = 30, book: str = "book_id", seq: str = "seq") -> DataFrame:
    """(book, sheet): the first quotes with their speakers; long ones are cut for display."""
    said = F.concat(F.lit("- "), F.coalesce("speaker_name", F.lit("Unknown")), F.lit(': "'), shortened(F.col("text"), 120), F.lit('"'))
    line = F.when(F.length("text") > 0, said)
    return _lines(quotes, line, limit, book, seq).select(book, F.array_join("lines", "\n").alias("sheet"))


def class_sheet(classes: DataFrame, book: str = "book_id", seq: str = "seq") -> DataFrame:
    """(book, sheet): a book's entity classes in order, and the core classes that it lacks. classes: book, class, seq."""
    items = F.array_sort(F.collect_list(F.struct(seq, "class")))
    own = F.array_distinct(F.transform(items, lambda s: s["class"]))
    core = F.array(*map(F.lit, CORE_CLASSES))
    return classes.groupBy(book).agg(F.array_join(F.concat(own, F.array_except(core, own)), ", ").alias("sheet"))


def relation_sheet(relations: DataFrame, limit: int = 40, book: str = "book_id", seq: str = "seq") -> DataFrame:
    """(book, sheet): the first relation names. relations: book, name, seq."""
    return _lines(relations, F.col("name"), limit, book, seq).select(book, F.array_join("lines", ", ").alias("sheet"))


def sheets(books: DataFrame, book: str = "book_id", **given: DataFrame) -> DataFrame:
    """(book, entities, quotes, classes, relations) for each book, with the default text where a sheet has no row."""
    out = books.select(book).distinct()
    for name, default in DEFAULT_SHEETS.items():
        if name in given:
            out = out.join(given[name].withColumnRenamed("sheet", name), book, "left").fillna({name: default})
        else:
            out = out.withColumn(name, F.lit(default))
    return out


def mention_total(aliases: Column) -> Column:
    return F.aggregate(F.map_values(aliases), F.lit(0).cast("long"), lambda a, b: a + b)
