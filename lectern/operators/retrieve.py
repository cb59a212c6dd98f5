"""Ranking of visible nodes: keyword scores, neighbour expansion, vector search, assembly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import keywords, result_text
from lectern.operators.asof import cursor_ordinals, effective_ordinal, expand_neighbours, linked_versions, valid_at, versions

#: Characters of a question; ``guard_question`` rejects longer ones, and nothing cuts them.
MAX_QUESTION = 2000
# Kinds of search that may be asked for.
SEARCH_TYPES = ("GRAPH_COMPLETION", "CHUNKS", "SUMMARIES", "RAG_COMPLETION")


def guard_question(question: str, search_type: str, states: DataFrame, book_id: str) -> None:
    """Raises for what can't be asked: ValueError for a question or kind of search, LookupError for an unknown book,
    RuntimeError for a book that isn't ready. states: book_id, ready_for_query."""
    if len(question) > MAX_QUESTION:
        raise ValueError(f"a question has up to {MAX_QUESTION} characters, not {len(question)}")
    if search_type not in SEARCH_TYPES:
        raise ValueError(f"unknown kind of search {search_type!r}; there are {', '.join(SEARCH_TYPES)}")
    state = states.filter(F.col("book_id") == book_id).select("ready_for_query").first()
    if state is None:
        raise LookupError(f"no book {book_id!r}")
    if not state[0]:
        raise RuntimeError(f"book {book_id!r} is still being processed")


def unwrapped(results: DataFrame, wrapped: str = "search_result") -> DataFrame:
    """Provider results with their payload's fields at the top: content, chapter and entity_type.

    A row has its fields itself, or in the struct ``wrapped``. ``kind`` is the payload's class; text and maps have none.
    """
    inner = F.col(wrapped) if wrapped in results.columns else F.struct(*results.columns)
    names = set(results.schema[wrapped].dataType.names) if wrapped in results.columns else set(results.columns)
    get = lambda c, kind: inner[c].cast(kind) if c in names else F.lit(None).cast(kind)
    latest = F.greatest(get("first_chapter", "int"), get("last_known_chapter", "int"), get("chapter", "int"))
    return results.select(
        result_text(get("description", "string"), get("name", "string"), get("text", "string"), inner).alias("content"),
        latest.alias("chapter"), F.when(~get("kind", "string").isin("str", "dict"), get("kind", "string")).alias("entity_type"),
    )


def keyword_score(haystack: Column, question: str | Column) -> Column:
    """How many keywords of the question, repeats counted, the lower-case text contains."""
    words = keywords(F.lit(question) if isinstance(question, str) else question)
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.contains(haystack, w).cast("int"))


def haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def content(name: Column, description: Column) -> Column:
    name, description = (F.nullif(c, F.lit("")) for c in (name, description))
    return F.coalesce(F.concat(name, F.lit(" — "), description), name, description)


def triplet_content(source: Column, relation: Column, target: Column, description: Column) -> Column:
    arrow = F.concat_ws(" → ", source, relation, target)
    return F.concat(arrow, F.coalesce(F.concat(F.lit(" — "), F.nullif(description, F.lit(""))), F.lit("")))


def rank_nodes(nodes: DataFrame, question: str, name: str = "name", description: str = "description") -> DataFrame:
    """Adds ``score`` and ``content``; rows without any keyword go, unless the question has none. Order: score, then seq."""
    score = keyword_score(haystack(F.col(name), F.col(description)), question)
    no_words = F.size(keywords(F.lit(question))) == 0
    ranked = nodes.withColumn("score", score).withColumn("content", content(F.col(name), F.col(description)))
    return ranked.filter(no_words | (F.col("score") > 0))


def rank_triplets(edges: DataFrame, question: str) -> DataFrame:
    """The same for relationships (source, relation, target, description)."""
    ends = [F.col(c) for c in ("source", "target", "relation", "description")]
    ranked = edges.withColumn("score", keyword_score(haystack(*ends), question)).withColumn(
        "content", triplet_content(*[F.col(c) for c in ("source", "relation", "target", "description")])
    )
    no_words = F.size(keywords(F.lit(question))) == 0
    return ranked.filter(no_words | (F.col("score") > 0))


def answer_items(
    nodes: DataFrame,
    edges: DataFrame,
    question: str,
    use_triplets: bool = False,
    seed_count: int = 5,
    cap: int = 20,
    degree_cap: int = 50,
) -> DataFrame:
    """Ranked items of visible nodes (name, description, seq) and edges, then unseen neighbours of the first names.

    Columns: kind, name, content, score, rank_group (0 ranked, 1 appended), seq.
    """
    own = rank_nodes(nodes, question).select(F.lit("node").alias("kind"), "name", "content", "score", F.lit(0).alias("src"), "seq")
    if use_triplets:
        other = rank_triplets(edges, question)
        own = own.unionByName(
            other.select(F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("name"), "content", "score", F.lit(1).alias("src"), "seq")
        )
    order = (F.col("score").desc(), "src", "seq")
    top = own.orderBy(*order).limit(seed_count)
    seeds = top.filter("name is not null").groupBy("name").agg(F.min(F.struct(-F.col("score"), "src", "seq")).alias("rank"))
    near = expand_neighbours(edges, seeds, degree_cap, cap).filter("hop = 1").select("name")
    added = nodes.join(near, "name", "left_semi").join(own.filter("kind = 'node'").select("name"), "name", "left_anti")
    added = added.select(
        F.lit("node").alias("kind"), "name", content(F.col("name"), F.col("description")).alias("content"),
        F.lit(0).alias("score"), F.lit(2).alias("src"), "seq",
    )
    return own.unionByName(added).orderBy((F.col("src") == 2).asc(), *order).limit(cap)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k most similar rows with ``similarity``; a top-k on each partition comes first."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", cosine(F.col(vector), literal)).orderBy(F.col("similarity").desc(), tie).limit(k)


#: Bytes of queries that are broadcast at once; products that a task holds at once; rows of results in a batch.
QUERY_BYTES, PRODUCTS, FOUND_ROWS = 16 << 20, 1 << 20, 1 << 16


def _nearest_rows(asked, k: int, key: str, vector: str):
    """The best ``k`` rows of a task for each query of a block: matrix products, and a heap of ``k`` a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = asked.value
        lengths = _norms(queries)
        best = np.full((len(ids), k), -np.inf)
        best_key = np.zeros((len(ids), k), np.int64)
        step, held = max(1, PRODUCTS // max(1, len(ids))), []
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, step):
                rows = batch.slice(at, step)
                keys = rows.column(key).to_numpy(zero_copy_only=False)
                vectors = _vectors(rows.column(vector), queries.shape[1])
                norms = _norms(vectors)
                about = queries @ vectors.T
                about /= np.where(lengths > 0, lengths, 1)[:, None]
                about /= np.where(norms > 0, norms, 1)
                least = best[:, -1]
                if about.shape[1] > k and least.min() == -np.inf:
                    least = np.maximum(least, np.partition(about, -k, axis=1)[:, -k])
                # A product sums in its own order, so what is close is summed again.
                query, row = np.nonzero(about >= least[:, None] - 1e-9)
                del about
                score = np.zeros(len(query))
                for d in range(queries.shape[1]):
                    score += queries[query, d] * vectors[row, d]
                size = lengths[query] * norms[row]
                score = np.where(size > 0, score / np.where(size > 0, size, 1), 0.0)
                held.append((query, score, keys[row]))
                if sum(len(q) for q, _, _ in held) >= FOUND_ROWS:
                    _keep_best(best, best_key, held)
        _keep_best(best, best_key, held)
        for at in range(0, max(1, len(ids)), max(1, FOUND_ROWS // k)):
            some = slice(at, at + max(1, FOUND_ROWS // k))
            query, place = np.nonzero(best[some] > -np.inf)
            yield pa.record_batch(
                [pa.array(ids[some][query]), pa.array(best_key[some][query, place]), pa.array(best[some][query, place])], ["query_id", key, "similarity"]
            )

    return run


def _keep_best(best: np.ndarray, best_key: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Takes the held queries, scores and keys into the queries' best ones: higher scores first, then smaller keys."""
    if not held:
        return
    query, score, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    by = np.argsort(query, kind="stable")
    query, score, keys = query[by], score[by], keys[by]
    k, own = best.shape[1], np.unique(query)
    for at in range(0, len(own), max(1, FOUND_ROWS // k)):
        some = own[at : at + max(1, FOUND_ROWS // k)]
        new = slice(np.searchsorted(query, some[0]), np.searchsorted(query, some[-1], "right"))
        owner = np.concatenate([np.repeat(some, k), query[new]])
        scores = np.concatenate([best[some].reshape(-1), score[new]])
        names = np.concatenate([best_key[some].reshape(-1), keys[new]])
        order = np.lexsort((names, -scores, owner))
        first = np.searchsorted(owner[order], some)
        order = order[first[:, None] + np.arange(k)]
        best[some], best_key[some] = scores[order], names[order]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers as doubles; a shorter one ends in zeros, a null one is zero, and so are null numbers."""
    column = column.fill_null([])
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    place = np.arange(len(flat)) - np.repeat(lengths.cumsum() - lengths, lengths)
    owner, kept = np.repeat(np.arange(len(lengths)), lengths), place < width
    out = np.zeros((len(lengths), width))
    out[owner[kept], place[kept]] = flat[kept]
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * rows[:, d]
    return np.sqrt(total)


def nearest_each(vectors: DataFrame, asked: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, similarity): the ``k`` most similar rows to each of many queries, ties to the smaller key.

    Queries go to the vectors in blocks of ``QUERY_BYTES``, a pass over the vectors for each block; there they are multiplied
    with many rows at once. Norms are taken once a row, no pair becomes a row, and a task hands over
    ``k`` rows a query at most. asked: query_id (long) and the vector column, of one length; key: a long.
    """
    spark = vectors.sparkSession
    own = asked.filter(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), vector)
    n, width = own.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = max(1, -(-n * max(1, width or 0) * 8 // QUERY_BYTES))
    rows, out = vectors.select(F.col(key).cast("long").alias(key), vector), None
    for b in range(blocks):
        one = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # QUERY_BYTES, about
        matrix = _vectors(one[vector].combine_chunks(), width or 1) if n else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((one["query_id"].to_numpy(), matrix))
        found = rows.mapInArrow(_nearest_rows(shared, k, key, vector), f"query_id long, `{key}` long, similarity double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return out.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def visible_triplets(found: DataFrame, names: DataFrame, cursor: int) -> DataFrame:
    """Search results whose endpoints are visible and whose chapter, if any, is up to the cursor."""
    known = names.select(F.col("name").alias("_name")).distinct()
    kept = found.filter(F.col("chapter").isNull() | (F.col("chapter") <= cursor))
    for end in ("source", "target"):
        kept = kept.join(known, F.col(end) == F.col("_name"), "left_semi")
    return kept.filter(F.col("relation").isNotNull())


def splice_front(first: DataFrame, rest: DataFrame) -> DataFrame:
    """Items of ``first`` whose content ``rest`` lacks, then ``rest``; both have content and rank."""
    new = first.join(rest.select("content"), "content", "left_anti")
    return new.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


def graph_cursor(requested: Column, stored_chapter: Column, paragraph: Column) -> Column:
    """The chapter up to which the graph shows: one less while a chapter is being read."""
    chapter = F.least(F.coalesce(requested, stored_chapter), stored_chapter)
    return F.when(paragraph.isNotNull(), F.greatest(chapter - 1, F.lit(0))).otherwise(chapter)


def read_paragraphs(paragraphs: Column, cursor: Column) -> Column:
    """The chapter's paragraphs up to the cursor's, inclusive."""
    return F.slice(paragraphs, F.lit(1), F.greatest(F.lit(0), F.least(cursor + 1, F.size(paragraphs))))


def composed_answer(answer: Column, plain: Column, chaptered: Column) -> Column:
    """The answer if it says anything; else the contents of results without a chapter, else of those with one."""
    joined = [F.nullif(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n\n"), F.lit("")) for c in (plain, chaptered)]
    said = F.when(F.trim(answer) != "", answer)
    return F.coalesce(said, *joined, F.lit("Nothing in what you have read so far answers that."))


#: Questions up to which they are broadcast to meet their books' nodes; more meet them by a shuffle on the book.
BROADCAST_QUESTIONS = 50_000


def answers(
    nodes: DataFrame, edges: DataFrame, chapter_index: DataFrame, asked: DataFrame, use_triplets: bool = False,
    seed_count: int = 5, cap: int = 20, degree_cap: int = 50,
) -> DataFrame:
    """Ranked items for many readers' questions in one pass: ask_id, position (from 0), kind, name, content, score.

    nodes: book_id, type, name, description, chapter, source_chunk_ordinal, seq; edges: book_id, source, relation, target,
    description, chapter, source_chunk_ordinal, seq; asked: ask_id (unique), book_id, cursor, question.

    Nodes and edges become versions with the range of ordinals at which they are seen, so a question finds its snapshot by
    its book and its ordinal alone. A question keeps ``cap`` rows of what matches its words; of these the first
    ``seed_count`` named ones lead to neighbours, which come last. No more than ``cap`` rows a question and task are
    shuffled for ranking, and ``degree_cap`` + 1 edges a seed. A question whose cursor has no ordinal, or whose book
    is unknown, has no rows; null or wordless questions rank all they see by ``seq``.
    """
    own, ends = ("source_chunk_ordinal", "chapter"), ["source", "target"]
    at = cursor_ordinals(asked, chapter_index).filter(F.col("ordinal").isNotNull())
    asks = asked.join(at, ["book_id", "cursor"]).select(
        "ask_id", "book_id", "ordinal", keywords(F.coalesce("question", F.lit(""))).alias("words")
    )
    asks = F.broadcast(asks) if asked.count() <= BROADCAST_QUESTIONS else asks
    placed = lambda df: effective_ordinal(df, chapter_index, *own).withColumnRenamed("effective_ordinal", "_from")
    known = placed(nodes.filter("type <> 'Relationship'").select("book_id", "type", "name", "description", *own, "seq"))
    seen = versions(known, ["book_id", "type", "name"], "_from", "seq").select(
        "book_id", "name", "_from", "_until", "seq", haystack(F.col("name"), F.col("description")).alias("hay"),
        content(F.col("name"), F.col("description")).alias("content"),
    )
    linked = linked_versions(placed(edges), known, ["book_id", "source", "relation", "target"], "_from", "seq", ends, ["book_id"])

    def matched(rows: DataFrame, kind: str, src: int) -> DataFrame:
        met = rows.join(asks, "book_id").filter(valid_at("_from", "ordinal"))
        score = F.aggregate("words", F.lit(0), lambda n, w: n + F.contains(F.col("hay"), w).cast("int"))
        met = met.withColumn("score", score).filter((F.size("words") == 0) | (F.col("score") > 0))
        return met.select("ask_id", "book_id", F.lit(kind).alias("kind"), "name", "content", "score", F.lit(src).alias("src"), "seq")

    found = matched(seen, "node", 0)
    if use_triplets:
        said = [F.col(c) for c in ("source", "relation", "target", "description")]
        arrows = linked.withColumns({"hay": haystack(*said), "content": triplet_content(*said), "name": F.lit(None).cast("string")})
        found = found.unionByName(matched(arrows, "edge", 1))
    ranked = Window.partitionBy("ask_id").orderBy(F.col("score").desc(), "src", "seq")
    top = found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= max(cap, seed_count))
    seeds = top.filter((F.col("r") <= seed_count) & F.col("name").isNotNull())
    seeds = seeds.groupBy("ask_id", "book_id", "name").agg(F.min("r").alias("rank")).join(asks.select("ask_id", "ordinal"), "ask_id")
    both = F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("to")), F.struct(F.col("target").alias("name"), F.col("source").alias("to")))
    sides = linked.filter("source <> target").select("book_id", "_from", "_until", F.col("seq").alias("edge"), F.explode(both).alias("x"))
    near = sides.select("book_id", "_from", "_until", "edge", "x.*").join(seeds, ["book_id", "name"]).filter(valid_at("_from", "ordinal"))
    fan = Window.partitionBy("ask_id", "name")
    near = near.withColumn("n", F.row_number().over(fan.orderBy("edge"))).filter(F.col("n") <= degree_cap + 1)
    near = near.withColumn("n", F.max("n").over(fan)).filter(F.col("n") <= degree_cap)
    reached = seeds.select("ask_id", "book_id", "name", F.lit(0).alias("hop"), "rank", F.lit(0).cast("long").alias("edge")).union(
        near.select("ask_id", "book_id", F.col("to").alias("name"), F.lit(1), "rank", F.col("edge").cast("long"))
    )
    reached = reached.groupBy("ask_id", "book_id", "name").agg(F.min(F.struct("hop", "rank", "edge")).alias("place"))
    nearest = Window.partitionBy("ask_id").orderBy("place", "name")
    grown = reached.withColumn("r", F.row_number().over(nearest)).filter((F.col("r") <= cap) & (F.col("place.hop") == 1))
    words = asks.select("ask_id", "ordinal", "words")
    new = seen.join(grown.select("ask_id", "book_id", "name"), ["book_id", "name"]).join(words, "ask_id").filter(valid_at("_from", "ordinal"))
    listed = (F.size("words") == 0) | F.exists("words", lambda w: F.contains(F.col("hay"), w))
    new = new.withColumn("listed", F.max(listed).over(fan)).filter(~F.col("listed"))
    added = new.select("ask_id", F.lit("node").alias("kind"), "name", "content", F.lit(0).alias("score"), F.lit(2).alias("src"), "seq")
    items = top.select("ask_id", "kind", "name", "content", "score", "src", "seq").unionByName(added)
    last = Window.partitionBy("ask_id").orderBy(F.col("src") == 2, F.col("score").desc(), "src", "seq")
    items = items.withColumn("position", F.row_number().over(last) - 1).filter(F.col("position") < cap)
    return items.select("ask_id", "position", "kind", "name", "content", "score", "src", "seq")


def answer_at(
    nodes: DataFrame, edges: DataFrame, chapter_index: DataFrame, cursors: DataFrame, question: str, use_triplets: bool = False,
    seed_count: int = 5, cap: int = 20, degree_cap: int = 50,
) -> DataFrame:
    """``answers`` to one question of one reader. cursors: (book_id, cursor), one row."""
    asked = cursors.select(F.lit(0).alias("ask_id"), "book_id", "cursor", F.lit(question).alias("question"))
    return answers(nodes, edges, chapter_index, asked, use_triplets, seed_count, cap, degree_cap).drop("ask_id")


def asked_about(quote: Column, question: Column) -> Column:
    """The second form, for a question about a quotation."""
    return F.concat(F.lit('Asked about "'), quote, F.lit('": '), question)


def quoted_question(question: Column, excerpt: Column) -> Column:
    return F.when(F.length(excerpt) > 0, F.concat(F.lit('About "'), excerpt, F.lit('": '), question)).otherwise(question)


def context(items: DataFrame, paragraphs: DataFrame, most: int = 15) -> DataFrame:
    """(part, rank, content): the first items and the paragraphs read so far. Both: content, rank."""
    first = items.orderBy("rank").limit(most).select(F.lit(0).alias("part"), "rank", "content")
    return first.unionByName(paragraphs.select(F.lit(1).alias("part"), "rank", "content"))


def contexts(items: DataFrame, paragraphs: DataFrame, by: Sequence[str], most: int = 15) -> DataFrame:
    """``context`` of many questions at once: (by, part, rank, content), the first ``most`` items of each. Both: by, content, rank."""
    order = Window.partitionBy(*by).orderBy("rank")
    first = items.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    shaped = lambda df, part: df.select(*by, F.lit(part).alias("part"), "rank", "content")
    return shaped(first, 0).unionByName(shaped(paragraphs, 1))


def legacy_search(nodes: DataFrame, question: str, cap: int = 20) -> DataFrame:
    """Nodes by how many of the question's words their text contains; words are split at blanks."""
    words = F.filter(F.split(F.lower(F.lit(question)), r"\s+"), lambda w: F.length(w) > 2)
    text = haystack(F.col("name"), F.col("description"))
    score = F.size(F.filter(words, lambda w: F.contains(text, w)))
    ranked = nodes.withColumn("score", score).filter("score > 0").withColumn("content", content(F.col("name"), F.col("description")))
    return ranked.orderBy(F.col("score").desc(), "seq").limit(cap)
