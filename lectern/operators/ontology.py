"""Ontology mining: frequencies, TF-IDF terms, relation candidates, triples, review edits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import list_runs
from lectern.functions.text import paragraphs
from lectern.sources.scratch import new_path

# Classes of mention categories, and verbs of relations.
CLASSES = {
    "PER": "Character", "LOC": "Location", "FAC": "Location", "GPE": "Location", "VEH": "Object", "ORG": "Organization",
}
RELATION_VERBS = (
    "allies_with", "attacks", "banishes", "befriends", "betrays", "captures", "commands", "defends", "employs", "fears",
    "fights", "follows", "hates", "helps", "imprisons", "joins", "kills", "leads", "leaves", "loves", "marries",
    "mentors", "obeys", "opposes", "protects", "rescues", "rules", "serves", "teaches", "trusts", "visits",
)
# Common English words that are no terms.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but"
    " by can cannot could did do does doing down during each few for from further had has have having he her here hers"
    " herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or"
    " other our ours ourselves out over own same she should so some such than that the their theirs them themselves then"
    " there these they this those through to too under until up very was we were what when where which while who whom why"
    " will with would you your yours yourself yourselves".split()
)


def entity_frequencies(profiles: DataFrame, mentions: DataFrame) -> DataFrame:
    """(class, name, n): profile names with their counts, and a count for each mention that is no pronoun.

    profiles: name, n; mentions: cat, prop, text.
    """
    classes = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    own = profiles.select(F.lit("Character").alias("class"), "name", F.col("n").cast("long").alias("n"))
    found = mentions.filter((F.col("prop") != "PRON") & (F.length("text") > 0)).select(
        classes[F.col("cat")].alias("class"), F.col("text").alias("name"), F.lit(1).cast("long").alias("n")
    )
    both = own.unionByName(found.filter("class is not null"))
    return both.groupBy("class", "name").agg(F.sum("n").alias("n"))


def _kept_words(text: Column, stop: Sequence[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop))


def _with_pairs(kept: str) -> Column:
    """An array of words and its pairs of neighbours."""
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    return F.concat(F.col(kept), F.zip_with(F.slice(kept, F.lit(1), n), F.slice(kept, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def with_terms(docs: DataFrame, text_col: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds ``terms``: words of two characters or more and pairs of neighbours, stop words left out first.

    The words are a column of their own, so the text is read by the pattern once.
    """
    return docs.withColumn("_kept", _kept_words(F.col(text_col), stop)).withColumn("terms", _with_pairs("_kept")).drop("_kept")


def text_units(docs: DataFrame, id_col: str, text_col: str, longer_than: int = 30) -> DataFrame:
    """(unit, text): the paragraphs of more than so many characters, which terms are counted in."""
    parts = F.filter(paragraphs(F.col(text_col)), lambda p: F.length(p) > longer_than)
    return docs.select(F.col(id_col), F.posexplode(parts).alias("_p", "text")).select(F.struct(id_col, "_p").alias("unit"), "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct terms with their counts."""
    for batch in list_runs(batches, "terms"):
        lists = batch.column("terms")
        coded = lists.flatten().dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        key, n = np.unique(owner * kinds + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * kinds), pa.int32())
        terms = coded.dictionary.take(pa.array(key % kinds))
        yield pa.record_batch(
            [pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], ["terms", "counts"]
        )


def _shares(vocabulary):
    """Each term's weights in a task's documents, in units of the documents' lengths, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = vocabulary.value
        known, total = pa.array(terms, pa.string()), np.zeros(len(terms))
        for batch in list_runs(batches, "terms"):
            lists = batch.column("terms")
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            kept = place >= 0
            place, owner = place[kept], owner[kept]
            weight = batch.column("counts").flatten().to_numpy()[kept] * idf[place]
            length = np.sqrt(np.bincount(owner, weight * weight, batch.num_rows))
            total += np.bincount(place, weight / length[owner], len(terms))
        yield pa.record_batch([known, pa.array(total)], ["term", "share"])

    return run


def _kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder, so later passes don't split texts again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tfidf_terms(
    docs: DataFrame, id_col: str, text_col: str, top: int = 100, min_df: int = 2, max_df: float = 0.8, stop: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """(term, score, df): summed TF-IDF with smooth idf and unit length per document (a row of its own).

    The vocabulary is the ``3 * top`` most frequent terms within the document-frequency bounds, ties by term. Texts are read
    and split once: distinct terms with counts are kept as a table in the shared folder, from which frequencies (one shuffle of
    sums a term) and then scores come. The vocabulary is broadcast, and a task hands over a sum a term of it.
    """
    spark = docs.sparkSession
    found = with_terms(docs.select(F.col(text_col).alias("_text")), "_text", stop).select(F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    kinds, path = "terms array<string>, counts array<int>", new_path(spark, "terms")
    found.mapInArrow(_counted, kinds).write.parquet(path)
    kept = spark.read.schema(kinds).parquet(path)
    n = kept.count()
    each = kept.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    stats = each.groupBy("x.terms").agg(F.count("*").alias("df"), F.sum("x.counts").alias("all")).withColumnRenamed("terms", "term")
    best = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.col("all").desc(), "term").limit(3 * top)
    rows = best.select("term", "df").collect()  # 3 * top
    idf = np.array([np.log((1.0 + n) / (1.0 + r["df"])) + 1 for r in rows])
    shared = spark.sparkContext.broadcast(([r["term"] for r in rows], idf))
    scores = kept.mapInArrow(_shares(shared), "term string, share double").groupBy("term").agg(F.sum("share").alias("score"))
    named = spark.createDataFrame([(r["term"], r["df"]) for r in rows], "term string, df long")
    return scores.join(F.broadcast(named), "term").orderBy(F.col("score").desc(), "term").limit(top).select("term", "score", "df")


def verb_relations(verbs: DataFrame, top: int = 50) -> DataFrame:
    """(name, n) of the most frequent verbs of more than two letters. verbs: verb, n (null counts 1)."""
    word = F.lower(F.trim("verb"))
    counts = verbs.select(word.alias("w"), F.coalesce("n", F.lit(1)).alias("n")).filter(F.length("w") > 2)
    counts = counts.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "w").limit(top)
    return counts.groupBy(F.replace("w", F.lit(" "), F.lit("_")).alias("name")).agg(F.sum("n").alias("n"))


def term_relations(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Terms that are relation verbs, or whose first word is one, and that aren't seen yet. found: term; seen: name."""
    words = F.split("term", " ")
    hit = F.element_at(words, 1).isin(*RELATION_VERBS) & (F.size(words) <= 2)
    named = found.filter(hit).select(F.replace("term", F.lit(" "), F.lit("_")).alias("name")).distinct()
    return named.join(seen.select("name"), "name", "left_anti")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


# Classes that every ontology has.
BASE_CLASSES = ("Character", "Location", "Faction", "Organization", "Object")


def triples(
    entities: DataFrame, themes: DataFrame, relations: DataFrame, root: str = "Entity", min_n: int = 2
) -> DataFrame:
    """Distinct (s, p, o): the ontology, its root and base classes, discovered classes, frequent individuals, themes as
    subclasses of Theme, relations as properties, and the classes of events and relationships.

    entities: class, name, n; themes: label, keywords (array); relations: name, evidence. Missing columns of keywords and
    evidence count as empty.
    """
    spark, lit = entities.sparkSession, F.lit
    part = lambda df, s, *pairs: df.select(s.alias("s"), F.explode(F.array(*[F.struct(lit(p).alias("p"), o.alias("o")) for p, o in pairs])).alias("x")).select("s", "x.p", "x.o")
    theme = F.concat(lit("Theme_"), safe_name(F.col("label")))
    keywords = F.array_join("keywords", ", ") if "keywords" in themes.columns else lit("")
    evidence = F.coalesce("evidence", lit("")) if "evidence" in relations.columns else lit("")
    core = [("", "type", "Ontology"), ("", "label", "Book Ontology"), (root, "type", "Class"), (root, "label", root)]
    for kind in (*BASE_CLASSES, "Theme", "PlotEvent", "Relationship"):
        core += [(kind, "type", "Class"), (kind, "subClassOf", root), (kind, "label", kind)]
    kinds, frequent = entities.select("class").distinct(), entities.filter(F.col("n") >= min_n)
    out = [
        spark.createDataFrame(core, "s string, p string, o string"),
        part(kinds, safe_name(F.col("class")), ("type", lit("Class")), ("subClassOf", lit(root)), ("label", F.col("class"))),
        part(frequent, safe_name(F.col("name")), ("type", lit("NamedIndividual")), ("type", safe_name(F.col("class"))), ("label", F.col("name"))),
        part(themes, theme, ("type", lit("Class")), ("subClassOf", lit("Theme")), ("label", F.col("label")), ("comment", keywords)),
        part(
            relations, safe_name(F.col("name")), ("type", lit("ObjectProperty")), ("label", F.col("name")), ("comment", evidence),
            ("domain", lit(root)), ("range", lit(root)),
        ),
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.distinct()


def discovered(
    profiles: DataFrame, mentions: DataFrame, verbs: DataFrame, texts: DataFrame, topics: DataFrame | None = None,
    top: int = 100, min_n: int = 2, root: str = "Entity",
) -> dict[str, DataFrame]:
    """All of ontology discovery: entities, themes, terms (the first 30 are kept), relations and triples.

    profiles, mentions: as in ``entity_frequencies``; verbs: as in ``verb_relations``; texts: id, text; topics: topic and
    text of a provider's clusters, if there are any.
    """
    entities = entity_frequencies(profiles, mentions)
    terms = tfidf_terms(text_units(texts, "id", "text"), "unit", "text", top)
    verbs = verb_relations(verbs)
    more = term_relations(terms.select("term"), verbs.select("name")).withColumn("n", F.lit(None).cast("long"))
    relations = verbs.unionByName(more)
    if topics is None:
        themes = texts.sparkSession.createDataFrame([], "topic int, keywords array<string>, label string")
    else:
        themes = topic_keywords(topics, "topic", "text")
    first = terms.orderBy(F.col("score").desc(), "term").limit(30)
    return {
        "entities": entities, "themes": themes, "terms": first, "relations": relations,
        "triples": triples(entities, themes, relations, root, min_n),
    }


def apply_review(items: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Items after add, remove and rename edits, the last edit of a key counts. edits: op, key, value, seq."""
    last = Window.partitionBy("key").orderBy(F.col("seq").desc())
    final = edits.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("op", F.col("key").alias("_key"), "value")
    kept = items.join(final, F.col(key) == F.col("_key"), "left").filter("op is null or op <> 'remove'")
    kept = kept.withColumn(key, F.when(F.col("op") == "rename", F.col("value")).otherwise(F.col(key))).drop("op", "_key", "value")
    added = final.filter("op = 'add'").select(F.col("_key").alias(key)).join(items.select(key), key, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def found_topics(
    docs: DataFrame, id_col: str, text_col: str, topics: int = 10, longer_than: int = 50, least: int = 10, seed: int = 42,
    features: int = 1 << 14, stop: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """(unit, text, topic): clusters of paragraphs by bisecting k-means over hashed TF-IDF vectors of unit length.

    Units are the paragraphs of more than ``longer_than`` characters; with fewer than ``least`` of them there are no rows.
    Paragraphs without a kept word, and clusters of fewer than ``least`` paragraphs, have the topic -1; the rest are numbered
    by size, then by their old number. Words and clusters are each written once to the shared folder. Centres have ``features`` numbers each, so the driver's part is bounded; paragraphs
    stay where they are. For ``topic_keywords``.
    """
    units = text_units(docs, id_col, text_col, longer_than)
    words = _kept_table(units.withColumn("_words", _kept_words(F.col("text"), stop)), "topic-words")
    if words.limit(least).count() < least:
        return words.select("unit", "text", F.lit(-1).alias("topic")).limit(0)
    counted = HashingTF(numFeatures=features, inputCol="_words", outputCol="_tf").transform(words.filter(F.size("_words") > 0))
    weighed = IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2).fit(counted).transform(counted)
    placed = Normalizer(inputCol="_idf", outputCol="features").transform(weighed)
    model = BisectingKMeans(k=topics, seed=seed, minDivisibleClusterSize=2.0 * least, maxIter=20).fit(placed.select("features"))
    found = _kept_table(model.transform(placed).select("unit", "text", "prediction"), "topic-units")
    sizes = sorted(found.groupBy("prediction").count().collect(), key=lambda r: (-r["count"], r["prediction"]))  # ``topics`` rows
    number = F.create_map(*[F.lit(x) for i, r in enumerate(sizes) for x in (r["prediction"], i if r["count"] >= least else -1)])
    own = found.select("unit", "text", number[F.col("prediction")].alias("topic"))
    return own.unionByName(words.filter(F.size("_words") == 0).select("unit", "text", F.lit(-1).alias("topic")))


def topic_keywords(docs: DataFrame, topic: str, text: str, top: int = 10, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(topic, label, keywords): class TF-IDF of topics, those of ``found_topics`` or given ones; topic -1 is none."""
    words = _kept_words(F.col(text), stop)
    counts = docs.filter(F.col(topic) != -1).select(F.col(topic).alias("topic"), F.explode(words).alias("term"))
    counts = _kept_table(counts.groupBy("topic", "term").agg(F.count("*").alias("tf")), "topic-counts")
    totals = counts.groupBy("term").agg(F.sum("tf").alias("all"))
    mean = counts.groupBy("topic").agg(F.sum("tf").alias("words")).agg(F.avg("words")).first()[0] or 0.0
    scored = counts.join(totals, "term").withColumn("score", F.col("tf") * F.log(1 + F.lit(float(mean)) / F.col("all")))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("score").desc(), "term"))
    best = scored.withColumn("r", rank).filter(F.col("r") <= top)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"])
    return best.groupBy("topic").agg(keys.alias("keywords")).withColumn("label", F.array_join(F.slice("keywords", 1, 3), "_"))
