"""Graph building: provenance, validation, merging, identity and references of extracted records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.identity import event_id, named_node_id, relationship_id
from lectern.functions.text import quote_matches


def merge_gleaned(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first pass, then records of the second whose key it lacks; repeats within the second stay."""
    null_safe = [first[k].eqNullSafe(second[k]) for k in keys]
    return first.unionByName(second.join(first.select(*keys).distinct(), null_safe, "left_anti"))


def has_provenance(chunk_text: Column, provenance: Column) -> Column:
    """No provenance at all, or a quote that the chunk holds."""
    return (F.coalesce(F.size(provenance), F.lit(0)) <= 0) | F.exists(provenance, lambda p: quote_matches(chunk_text, p["quote"]))


def validate_relationships(
    relations: DataFrame,
    names: DataFrame,
    source: str = "source",
    relation: str = "relation",
    target: str = "target",
    description: str = "description",
    seq: str = "seq",
    name: str = "name",
    by: Sequence[str] = (),
) -> DataFrame:
    """Relationships with both endpoints known, one per triple: the longest description, the first on ties.

    ``by``: columns of both tables (book and chunk) within which names count and triples are one. ``seq`` becomes the
    triple's first place. Names are joined from a distinct table; the triples take one aggregation.
    """
    known = names.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(name).alias("_name")).distinct()
    for end in (source, target):
        on = F.col(end) == F.col("_name")
        for c in by:
            on &= F.col(c) == F.col(f"_{c}")
        relations = relations.join(known, on, "left_semi")
    key = [*by, source, relation, target]
    rest = [c for c in relations.columns if c not in (*key, seq)]
    size = F.length(F.coalesce(description, F.lit("")))
    best = relations.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-size, F.col(seq))).alias("_top"), F.min(seq).alias("_first"))
    return best.select(
        *[F.col(c) if c in key else F.col("_first").alias(c) if c == seq else F.col("_top")[c].alias(c) for c in relations.columns]
    )


def merged_chunks(*parts: DataFrame) -> DataFrame:
    """Records of all chunks one after another, repeats included; ``part`` numbers the inputs. Missing columns are null."""
    out = parts[0].withColumn("part", F.lit(0))
    for k, x in enumerate(parts[1:], 1):
        out = out.unionByName(x.withColumn("part", F.lit(k)), allowMissingColumns=True)
    return out


def consolidate(
    records: DataFrame, keys: Sequence[str], description: str, chapter: str, seq: str, resolved: DataFrame | None = None
) -> DataFrame:
    """One record per group: the first one's fields, one description, the earliest chapter.

    ``resolved``: keys and ``resolved_description`` that a provider wrote for groups of several. Without one (or where it is
    null) the first description that isn't null stands.
    """
    rest = [c for c in records.columns if c not in (*keys, description, chapter)]
    merged = records.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), seq).alias("_first"),
        F.min_by(description, F.when(F.col(description).isNotNull(), F.col(seq))).alias(description),
        F.min(chapter).alias(chapter),
        F.count("*").alias("group_size"),
    )
    if resolved is not None:
        merged = merged.join(resolved.select(*keys, "resolved_description"), list(keys), "left")
        written = F.when((F.col("group_size") > 1) & F.col(description).isNotNull(), F.col("resolved_description"))
        merged = merged.withColumn(description, F.coalesce(written, description))
    return merged.select(*keys, *[F.col("_first")[c].alias(c) for c in rest], description, chapter, "group_size")


def to_nodes(
    characters: DataFrame,
    locations: DataFrame,
    factions: DataFrame,
    events: DataFrame,
    relations: DataFrame,
    themes: DataFrame,
    ordinal: Column | None = None,
    by: Sequence[str] = ("book_id",),
) -> DataFrame:
    """Extracted records as nodes: by, type, id, name, description, chapter, source_id, relation, target_id, location_id,
    members (ids), source_chunk_ordinal, seq.

    All have ``by`` and seq. characters, locations, factions, themes: name, description, first_chapter, and factions and
    themes names of characters as ``names``; events: description, chapter, names, location; relations: source, relation,
    target, description, first_chapter. Names are resolved against the characters of the same ``by`` (locations against
    locations): unknown ones go, the last record of equal names counts, and a relationship needs both ends.
    """
    by, ordinal = list(by), F.lit(None).cast("int") if ordinal is None else ordinal
    own = characters.withColumn("id", named_node_id("Character", F.col("name")))
    places = locations.withColumn("id", named_node_id("Location", F.col("name")))
    known, null = own.groupBy(*by, "name").agg(F.max_by("id", "seq").alias("_ref")), lambda kind: F.lit(None).cast(kind)

    def shaped(df: DataFrame, kind: str, node: Column, **given: Column) -> DataFrame:
        base = {
            "name": null("string"), "description": F.col("description"), "chapter": null("int"), "source_id": null("string"),
            "relation": null("string"), "target_id": null("string"), "location_id": null("string"), "members": null("array<string>"),
        }
        cols = [c.alias(n) for n, c in (base | given).items()]
        return df.select(*by, F.lit(kind).alias("type"), node.alias("id"), *cols, ordinal.cast("int").alias("source_chunk_ordinal"), "seq")

    def resolved(df: DataFrame) -> DataFrame:
        """``members``: ids of the row's names in order."""
        key = [*by, "seq"]
        named = df.select(*key, F.posexplode("names").alias("_pos", "name")).join(known, [*by, "name"])
        ids = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_ref"))).alias("_ids"))
        out = df.join(ids, key, "left")
        refs = F.transform("_ids", lambda x: x["_ref"])
        return out.withColumn("members", F.coalesce(refs, F.array().cast("array<string>")))

    def end(df: DataFrame, name: str, table: DataFrame, out: str, how: str) -> DataFrame:
        side = table.select(*by, F.col("name").alias(name), F.col("_ref").alias(out))
        return df.join(side, [*by, name], how)

    first, members = F.col("first_chapter").cast("int"), F.col("members")
    spots = places.groupBy(*by, "name").agg(F.max_by("id", "seq").alias("_ref"))
    events = end(resolved(events), "location", spots, "location_id", "left")
    linked = end(end(relations, "source", known, "source_id", "inner"), "target", known, "target_id", "inner")
    slug = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("unnamed_"), F.col("seq").cast("string")))
    parts = [
        shaped(own, "Character", F.col("id"), name=F.col("name"), chapter=first),
        shaped(places, "Location", F.col("id"), name=F.col("name"), chapter=first),
        shaped(resolved(factions), "Faction", named_node_id("Faction", F.col("name")), name=F.col("name"), chapter=first, members=members),
        shaped(events, "PlotEvent", event_id(F.col("chapter"), slug), chapter=F.col("chapter").cast("int"), members=members, location_id=F.col("location_id")),
        shaped(
            linked, "Relationship", relationship_id(F.col("source"), F.col("relation"), F.col("target")), chapter=first,
            source_id=F.col("source_id"), relation=F.col("relation"), target_id=F.col("target_id"),
        ),
        shaped(resolved(themes), "Theme", named_node_id("Theme", F.col("name")), name=F.col("name"), chapter=first, members=members),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def resolve_names(records: DataFrame, id_col: str, names_col: str, characters: DataFrame) -> DataFrame:
    """(id, members): the records' names as character ids in order; unknown names go, the last of equal names counts.

    characters: name, id, seq.
    """
    last = Window.partitionBy("name").orderBy(F.col("seq").desc())
    known = characters.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(
        F.col("name").alias("_name"), F.col("id").alias("_ref")
    )
    named = records.select(id_col, F.posexplode_outer(names_col).alias("_pos", "_want"))
    met = named.join(known, F.col("_want") == F.col("_name"), "left")
    refs = F.array_sort(F.collect_list(F.when(F.col("_ref").isNotNull(), F.struct("_pos", "_ref"))))
    return met.groupBy(id_col).agg(F.transform(refs, lambda x: x["_ref"]).alias("members"))


def node_ids(nodes: DataFrame, node_type: str, name: str = "name") -> DataFrame:
    return nodes.withColumn("id", named_node_id(node_type, F.col(name)))


def relationship_ids(relations: DataFrame, source: str = "source", relation: str = "relation", target: str = "target") -> DataFrame:
    return relations.withColumn("id", relationship_id(F.col(source), F.col(relation), F.col(target)))


def default_last_known(c: str = "last_known_chapter", first: str = "first_chapter") -> Column:
    return F.coalesce(c, first)


def batch_ordinals(nodes: DataFrame, chunks: DataFrame, batch: str = "batch") -> DataFrame:
    """Stamps nodes with the greatest ordinal of their batch's chunks."""
    top = chunks.groupBy(batch).agg(F.max("ordinal").alias("source_chunk_ordinal"))
    return nodes.drop("source_chunk_ordinal").join(top, batch, "left")


def constraint_errors(quote: Column, start: Column, end: Column, valence: Column, confidence: Column, realis: Column) -> Column:
    """Names of violated field constraints; an empty array for a valid record."""
    checks = {
        "quote": F.length(quote) > 200, "char_start": start < 0, "char_end": end < 0, "valence": ~valence.between(-1, 1),
        "confidence": ~confidence.between(0, 1), "realis": ~realis.isin("actual", "generic", "other"),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()]))


#: Types by the fields that a record has, the first that fits; fields of one entry are all needed.
TYPE_FIELDS = (
    ("Relationship", ("relation_type", "source", "target")),
    ("PlotEvent", ("chapter", "participants")),
    ("Faction", ("members",)),
    ("Theme", ("related_characters",)),
    ("Character", ("aliases",)),
    ("Character", ("chapters_present",)),
    ("Location", ("name", "first_chapter")),
)


def infer_type(label: Column, has: dict[str, Column]) -> Column:
    """The label, else what the fields that are there say. ``has``: field name to a boolean."""
    arms = [F.nullif(label, F.lit(""))]
    for kind, fields in TYPE_FIELDS:
        there = F.lit(True)
        for f in fields:
            there &= F.coalesce(has.get(f, F.lit(False)), F.lit(False))
        arms.append(F.when(there, F.lit(kind)))
    return F.coalesce(*arms, F.lit("Unknown"))


def ready_duplicates(uploads: DataFrame, manifest: DataFrame, ready: DataFrame) -> DataFrame:
    """Adds ``existing``: the ready book of equal content (SHA-256), if any. manifest: digest, book_id."""
    known = manifest.join(ready.select("book_id"), "book_id", "left_semi").groupBy("digest").agg(F.min("book_id").alias("existing"))
    return uploads.withColumn("digest", F.sha2("content", 256)).join(known, "digest", "left")


def split_cached(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Requests with their cached results, and those that go to the provider."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


#: Bytes of patterns that an automaton is built of at once, and blocks of them up to which they go to the chunks.
PATTERN_BYTES, PATTERN_BLOCKS = 16 << 20, 8


def _automata(patterns: list[tuple]) -> dict:
    """An automaton for each book; its words carry the ids of the nodes that look for them."""
    import ahocorasick

    out: dict = {}
    for book, text, ids in patterns:
        out.setdefault(book, ahocorasick.Automaton()).add_word(text, ids)
    for automaton in out.values():
        automaton.make_automaton()
    return out


def _first_hits(automata: dict, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(book_id, id, ordinal): the first chunk, of those seen by the task, that holds each text."""
    first: dict = {}
    for frame in frames:
        for book, ordinal, text in zip(frame["book_id"], frame["ordinal"], frame["text"], strict=True):
            if book in automata and text:
                for ids in {id(x): x for _, x in automata[book].iter(text)}.values():
                    for i in ids:
                        first[book, i] = min(ordinal, first.get((book, i), ordinal))
        if len(first) > 100_000:
            yield pd.DataFrame([(b, i, o) for (b, i), o in first.items()], columns=["book_id", "id", "ordinal"])
            first = {}
    yield pd.DataFrame([(b, i, o) for (b, i), o in first.items()], columns=["book_id", "id", "ordinal"])


def text_hits(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, id, ordinal): the first chunk of the node's book that holds its text; nodes without one have no row.

    nodes: book_id, id, text; chunks: book_id, ordinal, text. All texts of a book are looked for at once by an Aho-Corasick
    automaton, in blocks of ``PATTERN_BYTES``. Up to ``PATTERN_BLOCKS`` blocks go to the chunks by broadcast, and only hits
    are shuffled, a row a node and task at most, however long the chunks are. More patterns than that meet the chunks by book
    and block, where each chunk is sent once to each block of its own book.
    """
    kinds = T.StructType([nodes.schema["book_id"], nodes.schema["id"], chunks.schema["ordinal"]])
    texts = nodes.filter(F.length("text") > 0)
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // PATTERN_BYTES))
    same = F.pmod(F.xxhash64("book_id", "text"), F.lit(blocks)).cast("int")
    own = chunks.select("book_id", "ordinal", "text")
    if blocks <= PATTERN_BLOCKS:
        found = None
        for k in range(blocks):
            rows = texts.filter(same == k).select("book_id", "text", "id").collect()  # PATTERN_BYTES, about
            ids: dict = {}
            for book, text, i in rows:
                ids.setdefault((book, text), []).append(i)
            shared = nodes.sparkSession.sparkContext.broadcast([(*key, i) for key, i in ids.items()])
            hits = own.mapInPandas(lambda frames, shared=shared: _first_hits(_automata(shared.value), frames), kinds)
            found = hits if found is None else found.unionByName(hits)
    else:
        dealt = texts.withColumn("block", same).groupBy("book_id", "block", "text").agg(F.collect_set("id").alias("ids"))
        held = dealt.select("book_id", "block", F.lit(0).alias("side"), F.lit(None).cast("long").alias("ordinal"), "text", "ids")
        asked = dealt.select("book_id", "block").distinct()
        sent = own.join(asked, "book_id").select("book_id", "block", F.lit(1).alias("side"), F.col("ordinal").cast("long"), "text")
        both = held.unionByName(sent, allowMissingColumns=True).repartition("book_id", "block")
        found = both.sortWithinPartitions("book_id", "block", "side").mapInPandas(_met_hits, kinds)
    return found.groupBy("book_id", "id").agg(F.min("ordinal").alias("ordinal"))


def _met_hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by book and block, patterns before chunks."""
    at, patterns, automata = None, [], None
    for frame in frames:
        for key, group in frame.groupby(["book_id", "block"], sort=False, dropna=False):
            if key != at:
                at, patterns, automata = key, [], None
            held = group[group["side"] == 0]
            patterns += list(zip(held["book_id"], held["text"], held["ids"], strict=True))
            asked = group[group["side"] == 1]
            if len(asked):
                automata = automata or _automata(patterns)
                yield from _first_hits(automata, iter([asked.astype({"ordinal": "int64"})]))


def backfill_ordinals(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, ordinal): the first chunk of the node's book that holds its text; else the last chunk of its chapter.

    nodes: book_id, id, text, chapter; chunks: book_id, ordinal, chapter_numbers, text. See ``text_hits``.
    """
    found = text_hits(nodes, chunks).withColumnRenamed("ordinal", "_found")
    out = nodes.join(found, ["book_id", "id"], "left")
    of_chapter = chunks.select("book_id", "ordinal", F.explode("chapter_numbers").alias("chapter"))
    of_chapter = of_chapter.groupBy("book_id", "chapter").agg(F.max("ordinal").alias("_last"))
    out = out.join(of_chapter, ["book_id", "chapter"], "left")
    return out.select("id", F.coalesce("_found", "_last").alias("ordinal"))


def migrated(nodes: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Nodes with defaults for missing fields, and ``changed``: whether any was filled."""
    missing = [F.col(c).isNull() if c in nodes.columns else F.lit(True) for c in defaults]
    out = nodes.withColumn("changed", F.greatest(*missing, F.lit(False)))
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), value) if c in nodes.columns else value)
    return out


def type_counts(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "type").agg(F.count("*").alias("n"))
