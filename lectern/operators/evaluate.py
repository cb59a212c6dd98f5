"""Evaluation and validation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import match_form
from lectern.operators import segment


def _forms(df: DataFrame, key: str = "name") -> DataFrame:
    """(key, form): a name's and its aliases' match forms that aren't empty."""
    named = df.select(F.col(key).alias("name"), F.explode(F.concat(F.array(key), F.coalesce("aliases", F.array().cast("array<string>")))).alias("f"))
    return named.select("name", match_form(F.col("f")).alias("form")).filter("form <> ''").distinct()


def _recall(wanted: DataFrame, name: Column) -> DataFrame:
    """One row (found, total, recall, missed) of rows with a ``hit``, null where there is none."""
    return wanted.agg(
        F.count("hit").alias("found"),
        F.count("*").alias("total"),
        F.coalesce(F.count("hit") / F.count("*"), F.lit(0.0)).alias("recall"),
        F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), name))).alias("missed"),
    )


def entity_recall(gold: DataFrame, found: DataFrame, tier: str | None = None) -> DataFrame:
    """One row (found, total, recall, missed): gold names that any extracted name or alias matches.

    Both: name, aliases; gold of one ``tier`` alone if it is given. Forms are compared in match form.
    """
    gold = gold.filter(F.col("tier") == tier) if tier else gold
    hit = _forms(gold).join(_forms(found).select("form").distinct(), "form", "left_semi").select("name").distinct()
    return _recall(gold.select("name").distinct().join(hit.withColumn("hit", F.lit(1)), "name", "left"), F.col("name"))


def relationship_recall(gold: DataFrame, found: DataFrame, characters: DataFrame | None = None) -> DataFrame:
    """One row (found, total, recall, missed): gold pairs that occur in either direction, under any names of both ends.

    Both: source, target; characters: name, aliases of the gold's characters (others have their own form alone).
    """
    pair = lambda a, b: F.array_sort(F.array(a, b)).alias("pair")
    have = found.select(pair(match_form(F.col("source")), match_form(F.col("target")))).distinct()
    wanted = gold.select("source", "target", F.monotonically_increasing_id().alias("_row"))
    names = wanted.select(F.col("source").alias("name")).union(wanted.select("target")).distinct()
    known = names.withColumn("aliases", F.lit(None).cast("array<string>"))
    if characters is not None:
        own = characters.groupBy("name").agg(F.flatten(F.collect_list("aliases")).alias("aliases"))
        known = names.join(own, "name", "left")
    forms = _forms(known)
    both = wanted
    for end in ("source", "target"):
        both = both.join(forms.select(F.col("name").alias(end), F.col("form").alias(f"_{end}")), end)
    hit = both.select("source", "target", pair(F.col("_source"), F.col("_target"))).join(have, "pair", "left_semi")
    hit = hit.select("source", "target").distinct().withColumn("hit", F.lit(1))
    tag = F.concat_ws(" → ", "source", "target")
    return _recall(gold.select("source", "target").join(hit, ["source", "target"], "left"), tag)


def provenance_rate(nodes: DataFrame, provenance: str = "provenance") -> DataFrame:
    share = F.avg((F.coalesce(F.size(provenance), F.lit(0)) > 0).cast("double"))
    return nodes.agg(F.coalesce(share, F.lit(0.0)).alias("rate"))


def pick_winner(runs: DataFrame, factor: float = 1.5, least_rate: float = 0.8) -> DataFrame:
    """The run of best minor recall among those of known, affordable cost and good provenance; the first on ties."""
    known = runs.filter("cost_usd is not null").withColumn("_least", F.min("cost_usd").over(Window.partitionBy()))
    fit = known.filter((F.col("cost_usd") <= factor * F.col("_least")) & (F.col("provenance_rate") >= least_rate))
    return fit.orderBy(F.col("minor_recall").desc(), "seq").limit(1).drop("_least")


def extraction_cost(chunks: Column, size: Column, out_tokens: int = 500, price_in: float = 0.00015, price_out: float = 0.0006) -> Column:
    return F.bround(chunks * (size * price_in + out_tokens * price_out) / 1000, 4)


def source_precision(chapters: Column, expected: Column) -> Column:
    """The share of the results' chapters that are expected; 0 for none."""
    known = F.filter(chapters, lambda c: c.isNotNull())
    hits = F.size(F.filter(known, lambda c: F.array_contains(expected, c)))
    return F.when(F.size(known) > 0, hits / F.size(known)).otherwise(F.lit(0.0))


def mentioned_share(expected: Column, text: Column) -> Column:
    """The share of the expected terms that the text holds; 1 if none are expected."""
    hits = F.size(F.filter(expected, lambda e: F.contains(F.lower(text), F.lower(e))))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(F.lit(1.0))


def spoiler_safe(chapters: Column, most: Column) -> Column:
    return F.when(F.exists(chapters, lambda c: c > most), 0.0).otherwise(1.0)


def chunk_sweep(books: DataFrame, sizes: Sequence[int] = (1500, 1000, 750, 500), text: str = "text") -> DataFrame:
    """(book_id, chunk_size, n_chunks, cost_usd) of each book at each chunk size; a literal array of sizes, not a join."""
    rows = books.select("book_id", text, F.explode(F.array(*map(F.lit, sizes))).alias("chunk_size"))
    out = None
    for n in sizes:
        own = rows.filter(F.col("chunk_size") == n)
        chunks = segment.chunk(own, "book_id", text, n).groupBy("book_id").agg(F.count("*").alias("n_chunks"))
        one = own.select("book_id", "chunk_size").join(chunks, "book_id", "left").fillna({"n_chunks": 0})
        out = one if out is None else out.union(one)
    return out.withColumn("cost_usd", extraction_cost(F.col("n_chunks"), F.col("chunk_size")))


def report(metrics: DataFrame, value: str, *by: str, leak: str | None = None) -> DataFrame:
    """Mean, median and number of a metric; with ``leak``, a boolean column, also how many rows leak and whether none does."""
    more = [F.count_if(leak).alias("leaks"), (F.count_if(leak) == 0).alias("ok")] if leak else []
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count("*").alias("n"), *more)


def wikidata_matches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(side, name) of names without a match on the other side. Both: name, aliases (in match form)."""
    forms = lambda df: df.select("name", F.explode("aliases").alias("form"))
    a, b = forms(ours), forms(theirs)
    met = a.alias("a").join(b.alias("b"), "form").select(F.col("a.name").alias("ours"), F.col("b.name").alias("theirs"))
    extra = ours.select("name").join(met.select(F.col("ours").alias("name")), "name", "left_anti")
    missed = theirs.select("name").join(met.select(F.col("theirs").alias("name")), "name", "left_anti")
    return extra.select(F.lit("extra").alias("side"), "name").union(missed.select(F.lit("missed"), "name")).distinct()


def wikidata_recall(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row (found, total, recall, missed) of their names that match one of ours. Both: name, aliases (in match form)."""
    forms = ours.select(F.explode("aliases").alias("form")).distinct()
    hit = theirs.select("name", F.explode("aliases").alias("form")).join(forms, "form", "left_semi").select("name").distinct()
    return _recall(theirs.select("name").distinct().join(hit.withColumn("hit", F.lit(1)), "name", "left"), F.col("name"))


def expected_entities(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, passed): expected names with any name or alias in common with what was found, in lower case."""
    forms = lambda df: df.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("f")).select(
        "name", F.lower("f").alias("form")
    )
    hit = forms(expected).join(forms(found).select("form").distinct(), "form", "left_semi").select("name").distinct()
    return expected.select("name").distinct().join(hit.withColumn("passed", F.lit(True)), "name", "left").fillna(False, ["passed"])


def chapter_coverage(expected: Column, found: Column) -> Column:
    return F.array_sort(F.array_except(expected, found))


def known_answer(terms: Column, excluded: Column, context: Column) -> Column:
    low = F.lower(context)
    some = F.exists(terms, lambda t: F.contains(low, F.lower(t)))
    return some & ~F.exists(excluded, lambda t: F.contains(low, F.lower(t)))


#: Types whose counts the structural checks bound from below.
_COUNTED = {"min_characters": "Character", "min_locations": "Location", "min_relationships": "Relationship", "min_events": "PlotEvent"}


def structural_checks(nodes: DataFrame, least: dict[str, int], chapters: Sequence[int] = ()) -> DataFrame:
    """(name, passed, expected, actual): counts of types, chapters that some node has, and whether there are nodes at all.

    nodes: type, first_chapter, chapter, chapters_present.
    """
    own = F.flatten(F.collect_set(F.array_compact(F.concat(F.array("first_chapter", "chapter"), F.coalesce("chapters_present", F.array().cast("array<int>"))))))
    counts = [F.count_if(F.col("type") == kind).alias(kind) for kind in _COUNTED.values()]
    one = nodes.agg(*counts, F.array_distinct(own).alias("found"), F.count("*").alias("n"))
    check = lambda name, ok, expected, actual: F.struct(F.lit(name).alias("name"), ok.alias("passed"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"))
    checks = [check(k, F.col(kind) >= least.get(k, 0), f">= {least.get(k, 0)}", F.col(kind)) for k, kind in _COUNTED.items()]
    if chapters:
        missing = chapter_coverage(F.array(*map(F.lit, chapters)), F.col("found"))
        text = F.concat(F.lit("missing "), F.array_join(F.transform(missing, lambda x: x.cast("string")), ", "))
        checks.append(check("chapter_coverage", F.size(missing) == 0, f"chapters {sorted(chapters)}", F.when(F.size(missing) > 0, text).otherwise("all")))
    checks.append(check("graph_populated", F.col("n") > 0, "> 0", F.col("n")))
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def expected_events(events: DataFrame, expected: Sequence[tuple[int | None, str, Sequence[str]]]) -> DataFrame:
    """(chapter, note, passed) for a fixture of (chapter or None, note, keywords): some event of the chapter, or of any, has
    a keyword in its description. The fixture is a literal array, so each event is read once. events: chapter, description."""
    spark, text = events.sparkSession, F.lower(F.coalesce("description", F.lit("")))
    kind = "array<struct<i:int,chapter:int,keys:array<string>>>"
    wanted = [F.struct(F.lit(i).alias("i"), F.lit(c).cast("int").alias("chapter"), F.array(*[F.lit(k.lower()) for k in keys]).cast("array<string>").alias("keys")) for i, (c, _, keys) in enumerate(expected)]
    fits = lambda e: (e["chapter"].isNull() | e["chapter"].eqNullSafe(F.col("chapter"))) & F.exists(e["keys"], lambda k: F.contains(text, k))
    hit = events.select(F.explode(F.filter(F.array(*wanted).cast(kind), fits)).alias("e")).select(F.col("e.i").alias("i")).distinct()
    names = spark.createDataFrame([(i, c, note) for i, (c, note, _) in enumerate(expected)], "i int, chapter int, note string")
    return names.join(hit.withColumn("passed", F.lit(True)), "i", "left").select("chapter", "note", F.coalesce("passed", F.lit(False)).alias("passed"))


def rollup(checks: DataFrame) -> DataFrame:
    """One row (passed, failed, skipped, all_passed). checks: status."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    ok = (count("failed") == 0) & ((count("skipped") == 0) | (count("passed") > 0))
    return checks.agg(count("passed").alias("passed"), count("failed").alias("failed"), count("skipped").alias("skipped"), ok.alias("all_passed"))


def expected_relationships(relations: DataFrame, expected: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(source, target, passed) for a fixture of (source, target, keywords): either direction, names as parts of names.

    The fixture is a literal array, so each relationship is read once. relations: source, target, relation, description.
    """
    spark = relations.sparkSession
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a.lower()).alias("a"), F.lit(b.lower()).alias("b"), F.array(*[F.lit(k.lower()) for k in ks]).cast("array<string>").alias("ks")) for i, (a, b, ks) in enumerate(expected)])
    s, t, text = F.lower("source"), F.lower("target"), F.lower(F.concat_ws(" ", "relation", "description"))
    near = lambda x, y: F.contains(x, y) | F.contains(y, x)
    ends = lambda e: (near(s, e["a"]) & near(t, e["b"])) | (near(s, e["b"]) & near(t, e["a"]))
    hit = relations.select(F.explode(F.filter(wanted, lambda e: ends(e) & F.exists(e["ks"], lambda k: F.contains(text, k)))).alias("e"))
    passed = hit.select(F.col("e.i").alias("i")).distinct().withColumn("passed", F.lit(True))
    names = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(expected)], "i int, source string, target string")
    return names.join(passed, "i", "left").select("source", "target", F.coalesce("passed", F.lit(False)).alias("passed"))


def run_summary(nodes: DataFrame, gold: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """One row: counts of each node type and the provenance rate; with a gold standard, its recalls too.

    nodes: type, provenance, and for recalls name, aliases, source, target; gold: name, aliases, tier; pairs: source, target.
    """
    kinds = ("Character", "Location", "PlotEvent", "Relationship", "Theme")
    share = F.avg((F.coalesce(F.size("provenance"), F.lit(0)) > 0).cast("double"))
    out = nodes.agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds], F.coalesce(share, F.lit(0.0)).alias("provenance_rate"))
    if gold is None:
        return out
    people = nodes.filter("type = 'Character'")
    for tier in (None, "major", "minor"):
        one = entity_recall(gold, people, tier).select(F.col("recall").alias(f"recall_{tier or 'all'}"))
        out = out.join(F.broadcast(one))  # one row each
    if pairs is not None:
        own = relationship_recall(pairs, nodes.filter("type = 'Relationship'"), gold).select(F.col("recall").alias("relationship_recall"))
        out = out.join(F.broadcast(own))
    return out
