"""Tabular and JSON sources with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import safe_int, strip

NODE = (
    "type string, __type__ string, name string, description string, first_chapter int, last_known_chapter int, chapter int,"
    " source_chunk_ordinal int, realis string, aliases array<string>, relation_type string, valence double,"
    " confidence double, source_name string, target_name string, source struct<name:string,first_chapter:int>,"
    " target struct<name:string,first_chapter:int>, participants array<struct<name:string,first_chapter:int>>,"
    " members array<struct<name:string>>, related_characters array<struct<name:string>>,"
    " provenance array<struct<chunk_id:string,quote:string,char_start:int,char_end:int>>"
)
#: Collections of the keyed file shape and the types of their items.
COLLECTIONS = {
    "characters": "Character", "locations": "Location", "factions": "Faction", "themes": "Theme", "events": "PlotEvent",
    "relationships": "Relationship",
}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated files without quoting; short rows end in nulls, blank lines go."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.na.drop("all")


def _first(df: DataFrame, *names: str) -> Column:
    own = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{own[n.lower()]}`") for n in names if n.lower() in own]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tokens(raw: DataFrame) -> DataFrame:
    cluster = strip(_first(raw, "COREF", "coref_id"))
    return raw.select(
        safe_int(_first(raw, "token_ID_within_document", "token_id")).alias("token_id"),
        safe_int(_first(raw, "sentence_ID", "sentence_id")).alias("sentence_id"),
        safe_int(_first(raw, "paragraph_ID")).alias("paragraph_id"),
        _first(raw, "word", "text").alias("text"),
        _first(raw, "lemma").alias("lemma"),
        _first(raw, "POS_tag", "pos").alias("pos"),
        _first(raw, "dependency_relation", "dep").alias("dep"),
        F.when(~cluster.isin("", "-1", "-"), cluster.try_cast("int")).alias("coref_id"),
        safe_int(_first(raw, "byte_onset", "start_char")).alias("start_char"),
        safe_int(_first(raw, "byte_offset", "end_char")).alias("end_char"),
    )


def mentions(raw: DataFrame) -> DataFrame:
    ints = [safe_int(_first(raw, *names)).alias(names[-1]) for names in (("COREF", "coref_id"), ("start_token",), ("end_token",))]
    texts = [F.coalesce(_first(raw, c), F.lit("")).alias(c) for c in ("prop", "cat", "text")]
    return raw.select(*ints, *texts)


def quotes(raw: DataFrame) -> DataFrame:
    who = strip(_first(raw, "char_id", "speaker"))
    return raw.select(
        _first(raw, "quote", "text").alias("text"),
        F.when(~who.isin("", "-1"), who.try_cast("int")).alias("speaker_coref_id"),
        safe_int(_first(raw, "quote_start", "start_token")).alias("start_token"),
        safe_int(_first(raw, "quote_end", "end_token")).alias("end_token"),
    )


def read_nodes(spark: SparkSession, keyed_glob: str | None, flat_glob: str | None) -> DataFrame:
    """Node snapshots of both file shapes, one row a node with ``batch_file``, ``part`` and ``pos`` for their order.

    Keyed files hold an array per collection, flat files an array of nodes; files that are no JSON give no rows.
    """
    parts = []
    path = F.col("_metadata.file_path").alias("batch_file")
    if keyed_glob:
        raw = spark.read.text(keyed_glob, wholetext=True).select(path, "value")
        for part, (collection, kind) in enumerate(COLLECTIONS.items()):
            items = F.from_json(F.get_json_object("value", f"$.{collection}"), f"array<struct<{_fields()}>>")
            rows = raw.select("batch_file", F.lit(part).alias("part"), F.posexplode(items).alias("pos", "node"))
            parts.append(rows.select("batch_file", "part", "pos", F.lit(kind).alias("kind"), "node.*"))
    if flat_glob:
        raw = spark.read.text(flat_glob, wholetext=True).select(path, "value")
        listed = F.coalesce(F.get_json_object("value", "$.datapoints"), F.col("value"))
        rows = raw.select("batch_file", F.lit(99).alias("part"), F.posexplode(F.from_json(listed, f"array<struct<{_fields()}>>")).alias("pos", "node"))
        parts.append(rows.select("batch_file", "part", "pos", F.lit(None).cast("string").alias("kind"), "node.*"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    label = F.coalesce("type", "__type__", "kind", F.lit("Entity"))
    source, target = (F.coalesce(F.nullif(f"{e}_name", F.lit("")), f"{e}.name") for e in ("source", "target"))
    return out.withColumn("type", label).withColumn("source_name", source).withColumn("target_name", target).drop("__type__", "kind")


def _fields() -> str:
    """The node schema as struct fields."""
    depth, out, word = 0, [], ""
    for c in NODE:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    out.append(word.strip())
    return ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in out))


def read_profiles(spark: SparkSession, glob: str) -> DataFrame:
    """Aliases of character profiles: book_id, coref_id, alias, n, pos, gender; a profile without names has a null alias.

    A profile's ``names`` is a map of counts, or a list of names that count once. Files that are no JSON give no rows.
    ``book_id`` is the file's name up to its first dot.
    """
    book = F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("book_id")
    raw = spark.read.text(glob, wholetext=True).select(book, "value")
    items = F.from_json(F.get_json_object("value", "$.characters"), "array<struct<id:int,g:string,names:string>>")
    rows = raw.select("book_id", F.posexplode(items).alias("_k", "x")).select("book_id", "_k", "x.*")
    listed = F.transform(F.from_json("names", "array<string>"), lambda n: F.struct(n.alias("key"), F.lit(1).cast("long").alias("value")))
    names = F.when(F.col("names").startswith("["), listed).otherwise(F.map_entries(F.from_json("names", "map<string,bigint>")))
    named = rows.select("book_id", F.coalesce("id", F.lit(-1)).alias("coref_id"), "g", F.posexplode_outer(names).alias("pos", "entry"))
    return named.select(
        "book_id", "coref_id", F.col("entry.key").alias("alias"), F.col("entry.value").alias("n"), "pos", F.coalesce("g", F.lit("unknown")).alias("gender")
    )


#: Columns of stored chunks and of the index from chapters to chunks.
CHUNK = "book_id string, ordinal int, chunk_id string, batch string, chapter_numbers array<int>, start_char int, end_char int, text string"
INDEX = "book_id string, chapter int, first_ordinal int, last_ordinal int, paragraph_breakpoints array<int>"


def _checked(df: DataFrame, *columns: str) -> DataFrame:
    """Fails the job at a row that lacks one of these columns."""
    for c in columns:
        message = F.concat(F.lit(f"a row has no {c}: "), F.to_json(F.struct(*[x for x in df.columns if x != "text"])))
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(message)).otherwise(F.col(c)))
    return df


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the books' chunks, sorted by ordinal. A chunk without ordinal or id fails the job, and nothing is replaced."""
    own = chunks if "batch" in chunks.columns else chunks.withColumn("batch", F.lit(""))
    typed = _typed(_checked(own, "ordinal", "chunk_id"), CHUNK)
    write_table(typed.repartition("book_id").sortWithinPartitions("book_id", "ordinal"), path)


def write_index(index: DataFrame, path: str) -> None:
    """Replaces the books' chapter index, sorted by chapter."""
    typed = _typed(_checked(index, "chapter", "first_ordinal", "last_ordinal"), INDEX)
    write_table(typed.repartition("book_id").sortWithinPartitions("book_id", "chapter"), path)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", "))])


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored chunks or an index; an empty table where nothing is stored or it can't be read."""
    try:
        return _typed(spark.read.option("ignoreCorruptFiles", True).parquet(path), schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def chunk_headers(chunks: DataFrame, chunk_tokens: int) -> DataFrame:
    """(book_id, chunk_size_tokens, total_chunks)."""
    return chunks.groupBy("book_id").agg(F.lit(chunk_tokens).alias("chunk_size_tokens"), F.count("*").alias("total_chunks"))


def write_artifacts(tables: Mapping[str, DataFrame], path: str) -> None:
    """Named tables of a stage (coreference, batches), each in a folder of its own; books are replaced one by one."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", "book_id" if "book_id" in df.columns else None)


def batch_artifacts(batches: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Input texts and nodes of batches. A node that can't be written as JSON leaves its type and id.

    batches: book_id, batch, text; nodes: book_id, batch, type, id, and whatever else.
    """
    rest = [c for c in nodes.columns if c not in ("book_id", "batch")]
    stub = F.to_json(F.struct("type", "id"))
    kept = nodes.select("book_id", "batch", F.coalesce(F.to_json(F.struct(*rest)), stub).alias("node"))
    return {"input_texts": batches.select("book_id", "batch", "text"), "nodes": kept}


def write_report(rows: DataFrame, path: str) -> None:
    """Checks or runs as JSON lines; a run's rows replace those of its last one."""
    rows.write.mode("overwrite").json(path)


def markdown_report(rows: DataFrame, title: str, *columns: str) -> DataFrame:
    """A report as numbered lines of text: title, header, a line per row. For aggregates; lines are sorted in one task."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in columns]
    body = rows.select(F.lit(1).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = ["# " + title, "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = rows.sparkSession.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "part int, line string")
    return top.unionByName(body).orderBy("part", "line")


def read_chapters(spark: SparkSession, glob: str, states: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter, text) of chapter_NN.txt files in a book's folder; with ``states``, of books that are ready."""
    name = F.col("_metadata.file_path")
    rows = spark.read.text(glob, wholetext=True).select(
        F.regexp_extract(name, r"/([^/]+)/raw/chapters/[^/]+$", 1).alias("book_id"),
        F.regexp_extract(name, r"chapter_(\d+)\.txt$", 1).cast("int").alias("chapter"),
        F.col("value").alias("text"),
    )
    return rows.join(states.filter("ready_for_query").select("book_id"), "book_id", "left_semi") if states is not None else rows


def full_texts(chapters: DataFrame) -> DataFrame:
    """(book_id, text): a book's chapters in order, joined by empty lines."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "text"))), lambda x: x["text"])
    return chapters.groupBy("book_id").agg(F.array_join(items, "\n\n").alias("text"))


def write_table(df: DataFrame, path: str, partition: str | None = "book_id") -> None:
    """Replaces the partitions that the rows belong to; reruns after a crash give the same table."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_ntriples(triples: DataFrame, path: str, base: str = "urn:lectern:") -> None:
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"), F.lit(">"))
    escaped = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    value = F.when(F.col("p") == "label", F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(iri(F.col("o")))
    triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), value, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def write_rdf_xml(triples: DataFrame, path: str, base: str = "urn:lectern:", book: str = "book_id") -> None:
    """One well-formed RDF/XML document a book, in the folder of the book's partition; replaces what is there.

    triples: ``book``, s, p, o. Labels are literals, all other objects names; type, label and subClassOf are those of RDF and
    RDF Schema. A book's lines are sorted and written by one task without ever being held together, and Spark's
    commit lets no half-written document appear.
    """
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    text = F.regexp_replace("o", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "\uFFFD")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    known = F.when(F.col("p") == "type", "rdf:type").when(F.col("p").isin("label", "subClassOf"), F.concat(F.lit("rdfs:"), "p"))
    tag = F.coalesce(known, F.concat(F.lit("own:_"), safe(F.col("p"))))
    about = F.concat(F.lit(f'  <rdf:Description rdf:about="{base}'), safe(F.col("s")), F.lit('"><'), tag)
    ended = F.concat(F.lit("</"), tag, F.lit("></rdf:Description>"))
    value = F.when(F.col("p") == "label", F.concat(about, F.lit(">"), text, ended)).otherwise(
        F.concat(about, F.lit(f' rdf:resource="{base}'), safe(F.col("o")), F.lit('"/></rdf:Description>'))
    )
    known_rows = triples.filter("s is not null and p is not null and o is not null")
    lines = known_rows.select(F.col(book), F.lit(1).alias("_part"), value.alias("value")).distinct()
    spaces = f'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:own="{base}"'
    ends = F.array(
        F.struct(F.lit(0).alias("_part"), F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {spaces}>').alias("value")),
        F.struct(F.lit(2).alias("_part"), F.lit("</rdf:RDF>").alias("value")),
    )
    frame = known_rows.select(book).distinct().select(book, F.explode(ends).alias("x")).select(book, "x._part", "x.value")
    whole = lines.unionByName(frame).repartition(book).sortWithinPartitions(book, "_part", "value")
    whole.select(book, "value").write.mode("overwrite").partitionBy(book).text(path)


def read_states(spark: SparkSession, glob: str) -> DataFrame:
    """(book_id, status, ready_for_query, current_batch, total_batches) of pipeline states; missing fields get defaults."""
    schema = "book_id string, status string, ready_for_query boolean, current_batch int, total_batches int"
    raw = spark.read.schema(schema).option("multiLine", True).json(glob).filter("book_id is not null")
    return raw.fillna({"status": "pending", "ready_for_query": False, "current_batch": 0, "total_batches": 0})


def read_progress(spark: SparkSession, glob: str) -> DataFrame:
    """(book_id, current_chapter, current_paragraph); the first chapter by default."""
    raw = spark.read.schema("book_id string, current_chapter int, current_paragraph int").option("multiLine", True).json(glob)
    return raw.filter("book_id is not null").fillna({"current_chapter": 1})


def read_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON fixture: a list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
