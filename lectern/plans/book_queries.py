"""More operators on whole tables: the chapter index, annotations, answers, views and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import annotate, asof, coref, evaluate, graph, retrieve, segment, views
from lectern.plans.registry import query, table

# ---- Conversations as books: a turn is a chunk, three turns are a chapter.

_TALK = """
    c AS (SELECT conv_id AS book_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal,
                 CAST(turn // 3 AS INTEGER) AS chapter, turn, text FROM conversations),
    p AS (SELECT book_id, chapter, min(ordinal) AS f, max(ordinal) AS l, count(*) AS k,
                 len(list_filter(string_split(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10)) <> '')) AS n
          FROM c GROUP BY ALL),
    i AS (SELECT *, list_transform(range(0, n), lambda x: least(x * k // n, k - 1)) AS points FROM p)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "book_id")
    talk = talk.withColumn("chapter", F.floor(F.col("turn") / 3).cast("int"))
    return segment.stamp_ordinals(talk, "book_id", "turn")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    chapters = chunks.groupBy("book_id", "chapter").agg(F.array_join(texts, "\n\n").alias("text"))
    return segment.chapter_index(chunks, chapters)


@query(f"""
    WITH {_TALK}
    SELECT book_id, chapter, f AS first_ordinal, l AS last_ordinal, array_to_string(points, ',') AS points FROM i
""")
def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array_join(F.transform("paragraph_breakpoints", lambda x: x.cast("string")), ",").alias("points")
    return _index(spark, sf_dir).select("book_id", "chapter", "first_ordinal", "last_ordinal", points)


@query(f"""
    WITH {_TALK}, a AS (SELECT DISTINCT book_id, chapter FROM c),
    q AS (SELECT *, unnest([NULL, 0, 1, 2, 9]) AS paragraph FROM a)
    SELECT q.book_id, q.chapter, CAST(coalesce(paragraph, -1) AS INTEGER) AS paragraph,
           CAST(CASE WHEN paragraph IS NULL OR n = 0 THEN l ELSE f + points[least(paragraph, n - 1) + 1] END AS INTEGER) AS ordinal
    FROM q JOIN i USING (book_id, chapter)
""")
def paragraph_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.array(*[F.lit(x).cast("int") for x in (None, 0, 1, 2, 9)])).alias("paragraph")
    cursors = _chunks(spark, sf_dir).select("book_id", "chapter").distinct().select("book_id", "chapter", at)
    return segment.ordinal_at(cursors, _index(spark, sf_dir)).fillna({"paragraph": -1})


@query(f"WITH {_TALK} SELECT c.book_id, ordinal, i.chapter FROM c JOIN i ON c.book_id = i.book_id AND ordinal BETWEEN f AND l")
def chunk_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chapter_of(_chunks(spark, sf_dir).select("book_id", "ordinal"), _index(spark, sf_dir))


@query(f"""
    WITH {_TALK}
    SELECT book_id, chapter, CASE WHEN length(trim(t)) < 80 AND NOT regexp_matches(trim(t), '[.!?:]$') AND NOT regexp_matches(t, '[*#]')
                                  THEN trim(t) ELSE 'Chapter ' || chapter END AS title,
           words, chapter > min(chapter) OVER w AS has_prev, chapter < max(chapter) OVER w AS has_next
    FROM (SELECT book_id, chapter, arg_min(text, turn) AS t,
                 CAST(sum(len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''))) AS BIGINT) AS words FROM c GROUP BY ALL)
    WINDOW w AS (PARTITION BY book_id)
""")
def chapter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    chapters = chunks.groupBy("book_id", "chapter").agg(F.array_join(texts, "\n").alias("text"))
    return views.chapter_list(chapters, chapters.select("book_id").distinct())


# ---- Annotations: a book an event type or nation, a cluster a user or supplier.


@query("""
    WITH a AS (SELECT event_type AS book_id, user_id AS coref_id, 'n' || floor(value / 20)::INT AS alias, count(*) AS n, min(event_id) AS pos FROM events GROUP BY ALL)
    SELECT book_id, coref_id, arg_min(alias, struct_pack(n := -n, pos := pos)) AS canonical_name, CAST(sum(n) AS BIGINT) AS mentions FROM a GROUP BY ALL
""")
def named_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.concat(F.lit("n"), F.floor(F.col("value") / 20).cast("string")).alias("alias")
    names = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("book_id"), F.col("user_id").alias("coref_id"), alias)
    names = names.agg(F.count("*").alias("n"), F.min("event_id").alias("pos"))
    out = annotate.canonical_names(names)
    return out.select("book_id", "coref_id", "canonical_name", annotate.mention_total(F.col("aliases")).alias("mentions"))


@query("""
    WITH m AS (SELECT event_type AS b, user_id AS c, CASE WHEN value > 60 THEN 0 ELSE 1 END AS tier, 'the x' || floor(value / 10)::INT AS t, event_id FROM events WHERE value >= 5),
    g AS (SELECT b, c, tier, t, count(*) AS n, min(event_id) AS first FROM m GROUP BY ALL),
    best AS (SELECT b, c, arg_min(struct_pack(t := t, tier := tier), struct_pack(tier := tier, n := -n, first := first)) AS x FROM g GROUP BY ALL)
    SELECT b AS book_id, c AS coref_id, CASE WHEN x.tier = 1 THEN replace(x.t, 'the x', 'The X') ELSE x.t END AS canonical_name
    FROM best UNION ALL
    SELECT DISTINCT event_type, user_id, 'CHARACTER_' || user_id FROM events AS e WHERE NOT EXISTS (SELECT 1 FROM best WHERE b = event_type AND c = user_id)
""")
def enriched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "book_id", "user_id": "coref_id", "event_id": "seq"})
    name = F.concat(F.lit("CHARACTER_"), F.col("coref_id").cast("string")).alias("canonical_name")
    profiles = events.select("book_id", "coref_id", name).distinct()
    prop = F.when(F.col("value") > 60, "PROP").when(F.col("value") >= 5, "NOM").otherwise("PRON").alias("prop")
    text = F.concat(F.lit("the x"), F.floor(F.col("value") / 10).cast("string")).alias("text")
    return annotate.enrich_names(profiles, events.select("book_id", "coref_id", prop, text, "seq")).select("book_id", "coref_id", "canonical_name")


@query("""
    SELECT o_orderkey, coalesce(c_name, 'Unknown') AS speaker_name, coalesce(c_name, o_orderpriority) AS canonical_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = o_orderpriority[3:20]
""")
def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.substring("o_orderpriority", 3, 20).alias("book_id")
    orders = table(spark, sf_dir, "orders").select(book, "o_orderkey", F.col("o_custkey").alias("coref_id"), F.col("o_orderpriority").alias("text"))
    profiles = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("book_id"), F.col("c_custkey").alias("coref_id"), F.col("c_name").alias("canonical_name")
    )
    named = annotate.entity_names(annotate.speaker_names(orders, profiles, "coref_id"), profiles)
    return named.select("o_orderkey", "speaker_name", "canonical_name")


@query("""
    WITH m AS (SELECT c_nationkey AS book_id, '- #' || c_custkey || ' ' || c_name || ' (' || c_mktsegment || ')' AS line,
                      row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal > 0)
    SELECT book_id, string_agg(line, chr(10) ORDER BY n) AS sheet FROM m WHERE n <= 50 GROUP BY book_id
""")
def cheat_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("coref_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("text"),
        F.col("c_mktsegment").alias("cat"), F.when(F.col("c_acctbal") > 0, "PROP").otherwise("PRON").alias("prop"),
    )
    return annotate.cheat_sheet(mentions)


@query("""
    WITH t AS (SELECT p_brand AS b, p_size AS c, p_partkey AS k, p_name, p_type, p_retailprice,
                      p_partkey * 10 - lag(p_partkey * 10 + CASE WHEN p_retailprice > 1000 THEN 10 ELSE 4 END) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS gap FROM part)
    SELECT b AS book_id, c AS chapter, md5(string_agg(CASE WHEN coalesce(gap, 0) = 0 THEN '' ELSE ' ' END || p_name
           || CASE WHEN p_retailprice > 950 THEN ' [' || p_type || ']' ELSE '' END, '' ORDER BY k)) AS digest
    FROM t GROUP BY ALL
""")
def resolved_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, size = F.col("p_partkey") * 10, F.when(F.col("p_retailprice") > 1000, 10).otherwise(4)
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "book_id", "p_size": "chapter"})
    tokens = part.select("book_id", "chapter", F.col("p_partkey").alias("token_id"), F.col("p_name").alias("text"), start.alias("start_char"), (start + size).alias("end_char"))
    rules = part.filter("p_retailprice > 950").select("book_id", F.col("p_partkey").alias("end_token"), F.col("p_type").alias("label"))
    return coref.resolved_text(tokens, rules).select("book_id", "chapter", F.md5("text").alias("digest"))


# ---- One book of parts and suppliers, linked by lineitems.

_QUESTION = "Which cold widget or economy supplier?"
_BOOK = """
    idx AS (SELECT p_size AS chapter, max(p_partkey) AS l FROM part GROUP BY 1),
    cur AS (SELECT coalesce(max(l) FILTER (chapter = 25), max(l)) AS o FROM idx WHERE chapter <= 25),
    nodes AS (SELECT p_name AS name, p_type AS d, p_partkey AS seq, coalesce(CASE WHEN p_retailprice > 1000 THEN p_partkey END, l) AS v FROM part LEFT JOIN idx ON chapter = p_size
              UNION ALL SELECT s_name, n_name, 1000000000 + s_suppkey, l FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN idx ON chapter = s_nationkey),
    seen AS (SELECT name, d, seq FROM nodes, cur WHERE v <= o QUALIFY row_number() OVER (PARTITION BY name ORDER BY v DESC, seq) = 1),
    edges AS (SELECT p_name AS source, l_returnflag AS relation, s_name AS target, l_orderkey * 10 + l_linenumber AS seq, l AS v
              FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN idx ON chapter = month(l_shipdate)),
    linked AS (SELECT source, relation, target, seq FROM edges, cur
               WHERE v <= o AND source IN (SELECT name FROM seen) AND target IN (SELECT name FROM seen)
               QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY v DESC, seq) = 1)
"""


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chapter index, cursor)."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    book = F.lit("book").alias("book_id")
    node = lambda df, name, d, chapter, own, seq: df.select(
        book, F.lit("Thing").alias("type"), F.col(name).alias("name"), F.col(d).alias("description"), F.col(chapter).alias("chapter"),
        own.cast("long").alias("source_chunk_ordinal"), seq.alias("seq"),
    )
    own = F.when(F.col("p_retailprice") > 1000, F.col("p_partkey"))
    nodes = node(part, "p_name", "p_type", "p_size", own, F.col("p_partkey"))
    nodes = nodes.unionByName(node(supplier, "s_name", "n_name", "s_nationkey", F.lit(None), F.lit(1_000_000_000) + F.col("s_suppkey")))
    line = table(spark, sf_dir, "lineitem")
    line = line.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("source")), "l_partkey")
    line = line.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target")), "l_suppkey")
    edges = line.select(
        book, "source", F.col("l_returnflag").alias("relation"), "target", F.lit("").alias("description"), F.month("l_shipdate").alias("chapter"),
        F.lit(None).cast("long").alias("source_chunk_ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    index = part.groupBy(F.col("p_size").alias("chapter")).agg(F.min("p_partkey").alias("first_ordinal"), F.max("p_partkey").alias("last_ordinal"))
    cursors = spark.createDataFrame([("book", 25)], "book_id string, cursor int")
    return nodes, edges, index.withColumn("book_id", F.lit("book")), cursors


@query(f"WITH {_BOOK} SELECT name, d AS description, seq FROM seen")
def ordinal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, index, cursors = _book(spark, sf_dir)
    out = asof.book_snapshot(nodes, index, cursors, ["type", "name"], "source_chunk_ordinal", "chapter", "seq")
    return out.select("name", "description", "seq")


@query(f"""
    WITH {_BOOK},
    k AS (SELECT unnest(['which', 'cold', 'widget', 'economy', 'supplier']) AS w),
    scored AS (SELECT name, d, seq, name || ' — ' || d AS content, CAST(sum(CASE WHEN contains(lower(name || ' ' || d), w) THEN 1 ELSE 0 END) AS INTEGER) AS score FROM seen, k GROUP BY ALL),
    own AS (SELECT * FROM scored WHERE score > 0),
    seeds AS (SELECT name, score, seq FROM own ORDER BY score DESC, seq LIMIT 5),
    u AS (SELECT seq, source AS a, target AS b FROM linked UNION ALL SELECT seq, target, source FROM linked),
    fans AS (SELECT a FROM u JOIN seeds ON a = name GROUP BY a HAVING count(*) <= 50),
    near AS (SELECT b AS name, min(struct_pack(score := -score, seq := seeds.seq, edge := u.seq)) AS place FROM u JOIN seeds ON a = name
             WHERE a IN (SELECT a FROM fans) AND b NOT IN (SELECT name FROM seeds) GROUP BY b),
    grown AS (SELECT name FROM (SELECT name, 0 AS hop, struct_pack(score := -score, seq := seq, edge := 0::BIGINT) AS place FROM seeds UNION ALL SELECT name, 1, place FROM near)
              ORDER BY hop, place, name LIMIT 20),
    added AS (SELECT name, d, seq FROM seen WHERE name IN (SELECT name FROM grown) AND name NOT IN (SELECT name FROM own)),
    items AS (SELECT name, content, score, 0 AS part, seq FROM own UNION ALL SELECT name, name || ' — ' || d, 0, 1, seq FROM added)
    SELECT CAST(row_number() OVER (ORDER BY part, score DESC, seq) - 1 AS INTEGER) AS position, name, content, score FROM items ORDER BY position LIMIT 20
""")
def answer_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the cursor to ranked items, in order."""
    nodes, edges, index, cursors = _book(spark, sf_dir)
    return retrieve.answer_at(nodes, edges, index, cursors, _QUESTION).select("position", "name", "content", "score")


# ---- Four volumes that share their suppliers; a reader of each nation and market segment asks from a chapter.


def _volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chapter index, questions)."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))
    part = part.withColumn("book_id", F.col("p_partkey") % 4)
    node = lambda df, name, d, chapter, own, seq: df.select(
        "book_id", F.lit("Thing").alias("type"), F.col(name).alias("name"), F.col(d).alias("description"), F.col(chapter).alias("chapter"),
        own.cast("long").alias("source_chunk_ordinal"), seq.alias("seq"),
    )
    nodes = node(part, "p_name", "p_type", "p_size", F.when(F.col("p_retailprice") > 1000, F.col("p_partkey")), F.col("p_partkey"))
    shared = supplier.withColumn("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    nodes = nodes.unionByName(node(shared, "s_name", "n_name", "s_nationkey", F.lit(None), F.lit(1_000_000_000) + F.col("s_suppkey")))
    line = table(spark, sf_dir, "lineitem")
    line = line.join(part.select("book_id", F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("source")), "l_partkey")
    line = line.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target")), "l_suppkey")
    edges = line.select(
        "book_id", "source", F.col("l_returnflag").alias("relation"), "target", F.lit("").alias("description"), F.month("l_shipdate").alias("chapter"),
        F.lit(None).cast("long").alias("source_chunk_ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    index = part.groupBy("book_id", F.col("p_size").alias("chapter")).agg(F.min("p_partkey").alias("first_ordinal"), F.max("p_partkey").alias("last_ordinal"))
    readers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    asked = readers.select(
        F.concat_ws(" ", "c_nationkey", "c_mktsegment").alias("ask_id"), (F.col("c_nationkey") % 4).cast("long").alias("book_id"),
        (F.col("c_nationkey") * 2 + 1).alias("cursor"),
        F.concat(F.lit("Which "), F.when(F.col("c_nationkey") % 3 == 0, "cold").when(F.col("c_nationkey") % 3 == 1, "economy plated").otherwise("hot small"),
                 F.lit(" widget for "), F.lower("c_mktsegment"), F.lit("? supplier#00000000"), F.col("c_nationkey").cast("string")).alias("question"),
    )
    return nodes, edges, index, asked


@query("""
    WITH idx AS (SELECT p_partkey % 4 AS b, p_size AS chapter, max(p_partkey) AS l FROM part GROUP BY ALL),
    readers AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer),
    asks AS (SELECT c_nationkey || ' ' || c_mktsegment AS ask, c_nationkey % 4 AS b, c_nationkey * 2 + 1 AS cur,
                    ['which'] || CASE c_nationkey % 3 WHEN 0 THEN ['cold'] WHEN 1 THEN ['economy', 'plated'] ELSE ['hot', 'small'] END
                    || ['widget', 'for', lower(c_mktsegment), 'supplier', '00000000' || c_nationkey] AS words FROM readers),
    cur AS (SELECT ask, asks.b, words, coalesce(max(l) FILTER (chapter = cur), max(l)) AS o FROM asks JOIN idx ON idx.b = asks.b AND chapter <= cur GROUP BY ALL),
    nodes AS (SELECT p_partkey % 4 AS b, p_name AS name, p_type AS d, p_partkey AS seq, coalesce(CASE WHEN p_retailprice > 1000 THEN p_partkey END, l) AS v
              FROM part LEFT JOIN idx ON chapter = p_size AND b = p_partkey % 4
              UNION ALL SELECT k.b, s_name, n_name, 1000000000 + s_suppkey, l FROM supplier JOIN nation ON n_nationkey = s_nationkey, (SELECT unnest([0, 1, 2, 3]) AS b) AS k
              LEFT JOIN idx ON chapter = s_nationkey AND idx.b = k.b),
    seen AS (SELECT ask, words, nodes.* FROM nodes JOIN cur USING (b) WHERE v <= o QUALIFY row_number() OVER (PARTITION BY ask, name ORDER BY v DESC, seq) = 1),
    edges AS (SELECT l_partkey % 4 AS b, p_name AS source, l_returnflag AS relation, s_name AS target, l_orderkey * 10 + l_linenumber AS seq, l AS v
              FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN idx ON chapter = month(l_shipdate) AND idx.b = l_partkey % 4),
    linked AS (SELECT ask, source, relation, target, seq FROM edges JOIN cur USING (b)
               WHERE v <= o AND (ask, source) IN (SELECT (ask, name) FROM seen) AND (ask, target) IN (SELECT (ask, name) FROM seen)
               QUALIFY row_number() OVER (PARTITION BY ask, source, relation, target ORDER BY v DESC, seq) = 1),
    scored AS (SELECT *, name || ' — ' || d AS content, CAST(len(list_filter(words, lambda w: contains(lower(name || ' ' || d), w))) AS INTEGER) AS score FROM seen),
    own AS (SELECT * FROM scored WHERE score > 0),
    seeds AS (SELECT ask, name, score, seq FROM own QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, seq) <= 5),
    u AS (SELECT ask, seq, source AS a, target AS z FROM linked UNION ALL SELECT ask, seq, target, source FROM linked),
    fans AS (SELECT u.ask, a FROM u JOIN seeds ON u.ask = seeds.ask AND a = name GROUP BY ALL HAVING count(*) <= 50),
    near AS (SELECT u.ask, z AS name, min(struct_pack(score := -score, seq := seeds.seq, edge := u.seq)) AS place FROM u JOIN seeds ON u.ask = seeds.ask AND a = name
             WHERE (u.ask, a) IN (SELECT (ask, a) FROM fans) AND (u.ask, z) NOT IN (SELECT (ask, name) FROM seeds) GROUP BY ALL),
    grown AS (SELECT ask, name FROM (SELECT ask, name, 0 AS hop, struct_pack(score := -score, seq := seq, edge := 0::BIGINT) AS place FROM seeds UNION ALL SELECT ask, name, 1, place FROM near)
              QUALIFY row_number() OVER (PARTITION BY ask ORDER BY hop, place, name) <= 20),
    added AS (SELECT ask, name, content, seq FROM scored WHERE (ask, name) IN (SELECT (ask, name) FROM grown) AND (ask, name) NOT IN (SELECT (ask, name) FROM own)),
    items AS (SELECT ask, name, content, score, 0 AS part, seq FROM own UNION ALL SELECT ask, name, content, 0, 1, seq FROM added)
    SELECT ask AS ask_id, CAST(row_number() OVER (PARTITION BY ask ORDER BY part, score DESC, seq) - 1 AS INTEGER) AS position, name, content, score
    FROM items QUALIFY position < 20
""")
def answers_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of many readers of several books, answered in one pass."""
    return retrieve.answers(*_volumes(spark, sf_dir)).select("ask_id", "position", "name", "content", "score")


@query("""
    WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS seq, p_name AS s, l_returnflag AS r, s_name AS t, lower(p_name || ' ' || s_name || ' ' || l_returnflag || ' ') AS hay
               FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
    x AS (SELECT *, CAST(len(list_filter(['which', 'cold', 'widget', 'economy', 'supplier'], lambda w: contains(hay, w))) AS INTEGER) AS score FROM e)
    SELECT seq, s || ' → ' || r || ' → ' || t AS content, score FROM x WHERE score > 0
""")
def ranked_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.rank_triplets(_book(spark, sf_dir)[1], _QUESTION).select("seq", "content", "score")


# ---- Records of extraction.


@query("""
    WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '' END AS label, c_acctbal > 0 AS a, c_nationkey > 12 AS b, c_custkey > 70 AS c FROM customer)
    SELECT c_custkey, CASE WHEN label <> '' THEN label WHEN a AND b AND c THEN 'Relationship' WHEN c AND a THEN 'PlotEvent' WHEN b AND NOT a THEN 'Faction'
                           WHEN a THEN 'Location' ELSE 'Unknown' END AS type FROM r
""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("c_acctbal") > 0, F.col("c_nationkey") > 12, F.col("c_custkey") > 70
    has = {"relation_type": a, "source": b, "target": c, "chapter": c, "participants": a, "members": b & ~a, "name": a, "first_chapter": a}
    label = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", graph.infer_type(label, has).alias("type"))


@query("""
    SELECT doc_id, q <> '' AND (contains(text, q) OR contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), q)) AS quoted
    FROM (SELECT doc_id, text, trim(regexp_replace(text[5:44], '\\s+', ' ', 'g')) AS q FROM documents)
""")
def quoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's provenance, a quote from it with blanks collapsed, is verified."""
    quote = T.strip(F.regexp_replace(F.substring("text", 5, 40), r"\s+", " "))
    provenance = F.array(F.struct(quote.alias("quote")))
    return table(spark, sf_dir, "documents").select("doc_id", graph.has_provenance(F.col("text"), provenance).alias("quoted"))


@query("""
    SELECT c_custkey, 1 AS pass FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_nationkey > 5 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'FURNITURE')
    UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'FURNITURE'
""")
def gleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass adds what the first one lacks."""
    customer, key = table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"]
    first = customer.filter("c_acctbal > 0 AND c_mktsegment = 'FURNITURE'").select(*key, F.lit(3).alias("pass"))
    merged = graph.merge_gleaned(first, customer.filter("c_nationkey > 5").select(*key, F.lit(2).alias("pass")), ["c_nationkey"])
    whole = customer.filter("c_acctbal > 0").select(*key, F.lit(1).alias("pass"))
    return graph.merged_chunks(whole, merged).select("c_custkey", "pass")


@query("""
    WITH t AS (SELECT o_orderstatus AS book_id, 'b' || year(o_orderdate) AS batch, max(o_orderkey) AS top FROM orders GROUP BY ALL)
    SELECT o_orderkey, top AS source_chunk_ordinal FROM orders JOIN t ON batch = 'b' || year(o_orderdate) AND book_id = o_orderstatus
""")
def stamped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.struct("o_orderstatus", F.year("o_orderdate").alias("y"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", batch.alias("batch"))
    return graph.batch_ordinals(orders, orders.withColumnRenamed("o_orderkey", "ordinal")).select("o_orderkey", "source_chunk_ordinal")


_RECORDS = """
    ch AS (SELECT c_nationkey AS b, c_mktsegment AS name, c_name AS d, c_custkey AS seq FROM customer),
    ids AS (SELECT b, name, 'character:' || name AS key FROM ch GROUP BY ALL)
"""


def _uuid_sql(text: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({text}))"
    return f"""(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (CASE ('0x' || h[17:17])::INT & 3 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END)
               || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"""


_UUIDS = {k: _uuid_sql(v) for k, v in {
    "segment": "'character:' || c_mktsegment", "faction": "'faction:' || name", "theme": "'theme:' || name", "member": "'character:' || k.name", "place": "'location:' || n_name",
    "event": "'event:' || chapter || ':' || coalesce(nullif(d, ''), 'unnamed_' || seq)[1:60]", "knows": "'rel:BUILDING:knows:FURNITURE'",
    "building": "'character:BUILDING'", "furniture": "'character:FURNITURE'", "spot": "'location:' || spot",
}.items()}


@query(f"""
    WITH r AS (SELECT s_nationkey AS b, s_name AS name, s_suppkey AS seq, s_suppkey % 9 AS chapter, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE '' END AS d,
                      'NATION_' || (s_nationkey + s_suppkey % 2) AS spot FROM supplier),
    known AS (SELECT DISTINCT c_nationkey AS b, c_mktsegment AS name FROM customer),
    m AS (SELECT r.b, r.seq, coalesce((SELECT string_agg({_UUIDS["member"]}, ',' ORDER BY k.name) FROM known AS k WHERE k.b = r.b AND k.name IN ('BUILDING', 'FURNITURE')), '') AS members FROM r)
    SELECT 'Character' AS type, c_nationkey AS book_id, c_custkey AS seq, {_UUIDS["segment"]} AS id, 1 AS chapter, '' AS members, '' AS ends, '' AS location_id FROM customer
    UNION ALL SELECT 'Location', n_nationkey, n_nationkey, {_UUIDS["place"]}, 1, '', '', '' FROM nation
    UNION ALL SELECT 'Faction', b, seq, {_UUIDS["faction"]}, 1, members, '', '' FROM r JOIN m USING (b, seq)
    UNION ALL SELECT 'Theme', b, seq, {_UUIDS["theme"]}, 1, members, '', '' FROM r JOIN m USING (b, seq) WHERE seq % 5 = 0
    UNION ALL SELECT 'PlotEvent', b, seq, {_UUIDS["event"]}, CAST(chapter AS INTEGER), members, '', CASE WHEN spot = 'NATION_' || b THEN {_UUIDS["spot"]} ELSE '' END FROM r JOIN m USING (b, seq)
    UNION ALL SELECT 'Relationship', b, seq, {_UUIDS["knows"]}, 1, '', {_UUIDS["building"]} || ' knows ' || {_UUIDS["furniture"]}, '' FROM r
    WHERE (SELECT count(*) FROM known AS k WHERE k.b = r.b AND k.name IN ('BUILDING', 'FURNITURE')) = 2
""")
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a book a nation: its market segments are characters, it is a place, its suppliers are the rest."""
    book, first = F.col("c_nationkey").alias("book_id"), F.lit(1).alias("first_chapter")
    empty = [F.lit(None).cast("string").alias("description"), first]
    characters = table(spark, sf_dir, "customer").select(book, F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"), *empty)
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("book_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("seq"), *empty)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"), *empty)
    named = supplier.withColumn("names", F.array(F.lit("BUILDING"), F.lit("nobody"), F.lit("FURNITURE")))
    relations = supplier.withColumns({"source": F.lit("BUILDING"), "relation": F.lit("knows"), "target": F.lit("FURNITURE")})
    events = named.withColumns({
        "chapter": F.col("seq") % 9, "description": F.when(F.col("seq") % 4 > 0, F.col("name")).otherwise(""),
        "location": F.concat(F.lit("NATION_"), (F.col("book_id") + F.col("seq") % 2).cast("string")),
    })
    out = graph.to_nodes(characters, places, named, events, relations, named.filter("seq % 5 = 0"))
    ends = F.when(F.col("source_id").isNotNull(), F.concat_ws(" ", "source_id", "relation", "target_id")).otherwise("")
    members = F.array_join(F.coalesce("members", F.array().cast("array<string>")), ",").alias("members")
    return out.select("type", "book_id", "seq", "id", "chapter", members, ends.alias("ends"), F.coalesce("location_id", F.lit("")).alias("location_id"))


# ---- Views.


@query("""
    SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return views.latest(log, "user_id", "event_type", at="ts").select("user_id", "event_type", "event_id", "value")


@query("""
    WITH b AS (SELECT o_custkey AS book_id, count(*) AS chapters FROM orders GROUP BY 1)
    SELECT c_custkey AS book_id, coalesce(chapters, 0) AS chapters, coalesce(n, 1) AS current_chapter
    FROM customer LEFT JOIN b ON book_id = c_custkey LEFT JOIN (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1) ON user_id = c_custkey WHERE c_acctbal > 0
""")
def ready_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_acctbal") > 0).alias("ready_for_query"))
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"))
    progress = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("book_id")).agg(F.count("*").cast("int").alias("current_chapter"))
    return views.ready_books(states, chapters, progress).select("book_id", "chapters", "current_chapter")


@query("""
    WITH m AS (SELECT user_id, min(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) AS r FROM events GROUP BY 1)
    SELECT c_custkey AS sid, CASE r WHEN 0 THEN 'ask' WHEN 1 THEN 'note' WHEN 2 THEN 'highlight' END AS mark FROM customer LEFT JOIN m ON user_id = c_custkey
""")
def sentence_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "view", "note").otherwise("highlight")
    cards = table(spark, sf_dir, "events").select(F.col("user_id").alias("anchor"), kind.alias("kind"))
    return views.sentence_marks(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid")), cards).select("sid", "mark")


@query("""
    SELECT doc_id, length(trim(text, ' ' || chr(10))) >= 50 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 15 AS content,
           CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS shown,
           len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) AS paragraphs,
           len(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''’-]+'), lambda w: length(w) > 2)) AS keywords,
           CAST(list_sum(list_transform(string_split(source, ''), lambda c: unicode(c))) % 6 AS INTEGER) AS mood
    FROM documents WHERE source IS NOT NULL
""")
def document_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar operators on every document that has a source."""
    text: Column = F.col("text")
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    return docs.select(
        "doc_id", T.is_content_chapter(text).alias("content"), T.shortened(text, 80).alias("shown"), F.size(T.paragraphs(text)).alias("paragraphs"),
        F.size(T.keywords(text)).alias("keywords"), T.mood(F.col("source")).alias("mood"),
    )


# ---- Evaluation.


@query("""
    WITH g AS (SELECT DISTINCT c_name AS s, n_name AS t FROM customer JOIN nation ON n_nationkey = c_nationkey),
    h AS (SELECT DISTINCT n_name AS s, c_name AS t FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 2000)
    SELECT count(*) FILTER (hit) AS found, count(*) AS total, count(*) FILTER (hit) / count(*) AS recall
    FROM (SELECT EXISTS (SELECT 1 FROM h WHERE h.s = g.t AND h.t = g.s) AS hit FROM g)
""")
def relationship_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs of customer and nation, found the other way round and under an alias."""
    nation = table(spark, sf_dir, "nation")
    both = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    gold = both.select(F.col("c_name").alias("source"), F.col("n_name").alias("target")).distinct()
    found = both.filter("c_acctbal > 2000").select(F.concat(F.lit("alias of "), "n_name").alias("source"), F.upper("c_name").alias("target"))
    aliases = nation.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("Alias of "), "n_name")).alias("aliases"))
    return evaluate.relationship_recall(gold, found, aliases).select("found", "total", "recall")


@query("""
    WITH c AS (SELECT DISTINCT c FROM (SELECT p_size AS c FROM part UNION SELECT s_nationkey FROM supplier UNION SELECT CAST(day(ts) AS INTEGER) FROM events)),
    m AS (SELECT list_filter([1, 2, 3, 700, 701], lambda x: x NOT IN (SELECT unnest(list(c)) FROM c)) AS missing),
    n AS (SELECT (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM events) AS e)
    SELECT 'min_characters' AS name, p >= 3 AS passed, '>= 3' AS expected, CAST(p AS VARCHAR) AS actual FROM n
    UNION ALL SELECT 'min_locations', s >= 1000000, '>= 1000000', CAST(s AS VARCHAR) FROM n
    UNION ALL SELECT 'min_relationships', l >= 7000, '>= 7000', CAST(l AS VARCHAR) FROM n
    UNION ALL SELECT 'min_events', e >= 5000000, '>= 5000000', CAST(e AS VARCHAR) FROM n
    UNION ALL SELECT 'chapter_coverage', len(missing) = 0, 'chapters [1, 2, 3, 700, 701]', CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') ELSE 'all' END FROM m
    UNION ALL SELECT 'graph_populated', p + s + l + e > 0, '> 0', CAST(p + s + l + e AS VARCHAR) FROM n
""".replace("list_filter([1, 2, 3, 700, 701], lambda x: x NOT IN (SELECT unnest(list(c)) FROM c))", "(SELECT list(v.x ORDER BY v.x) FROM (VALUES (1), (2), (3), (700), (701)) AS v(x) WHERE v.x NOT IN (SELECT c FROM c))"))
def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are characters, suppliers places, lines relationships and events events of their days."""
    none, missing = F.lit(None).cast("array<int>").alias("chapters_present"), F.lit(None).cast("int")
    node = lambda t, kind, first, chapter: table(spark, sf_dir, t).select(F.lit(kind).alias("type"), first.alias("first_chapter"), chapter.alias("chapter"), none)
    nodes = node("part", "Character", F.col("p_size"), missing).unionByName(node("supplier", "Location", missing, F.col("s_nationkey")))
    nodes = nodes.unionByName(node("lineitem", "Relationship", missing, missing)).unionByName(node("events", "PlotEvent", missing, F.dayofmonth("ts")))
    least = {"min_characters": 3, "min_locations": 1_000_000, "min_relationships": 7000, "min_events": 5_000_000}
    return evaluate.structural_checks(nodes, least, [1, 2, 3, 700, 701])


@query("""
    SELECT * FROM (VALUES (1, 'steel', (SELECT count(*) > 0 FROM part WHERE p_size = 1 AND (contains(lower(p_name), 'widget') OR contains(lower(p_name), 'zzz')))),
                          (0, 'any', (SELECT count(*) > 0 FROM part WHERE contains(lower(p_name), 'cold'))), (3, 'none', false)) AS v(chapter, note, passed)
""")
def expected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "part").select(F.col("p_size").alias("chapter"), F.col("p_name").alias("description"))
    return evaluate.expected_events(events, [(1, "steel", ["Widget", "zzz"]), (None, "any", ["COLD"]), (3, "none", [])]).fillna({"chapter": 0})


@query("""
    WITH n AS (SELECT n_name, s_acctbal > 6000 AS ours, unnest(list_append(list_filter(regexp_split_to_array(lower(n_name), '[-''\\s]+'), lambda w: length(w) >= 4), lower(n_name))) AS form
               FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey),
    h AS (SELECT n_name, bool_or(form IN (SELECT form FROM n WHERE ours)) AS hit FROM n GROUP BY 1)
    SELECT count(*) FILTER (hit) AS found, count(*) AS total, count(*) FILTER (hit) / count(*) AS recall FROM h
""")
def wikidata_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.unicode import wikidata_aliases

    nation = table(spark, sf_dir, "nation")
    named = lambda df: df.select(F.col("n_name").alias("name"), wikidata_aliases(F.col("n_name")).alias("aliases"))
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 6000")
    ours = nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return evaluate.wikidata_recall(named(ours), named(nation)).select("found", "total", "recall")


@query("""
    SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) AS n, count(*) FILTER (value > 300) AS leaks, count(*) FILTER (value > 300) = 0 AS ok
    FROM events GROUP BY event_type
""")
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("leak", F.col("value") > 300)
    out = evaluate.report(events, "value", "event_type", leak="leak")
    return out.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


_KINDS = ("Character", "Location", "PlotEvent", "Relationship", "Theme", "Faction")


@query("""
    WITH k AS (SELECT *, s_suppkey % 6 AS k FROM supplier),
    g AS (SELECT n_nationkey % 2 = 0 AS major, n_nationkey IN (SELECT s_nationkey FROM k WHERE k = 0) AS hit FROM nation)
    SELECT count(*) FILTER (k = 0) AS "Character", count(*) FILTER (k = 1) AS "Location", count(*) FILTER (k = 2) AS "PlotEvent",
           count(*) FILTER (k = 3) AS "Relationship", count(*) FILTER (k = 4) AS "Theme", count(*) FILTER (s_nationkey > 10) / count(*) AS provenance_rate,
           (SELECT count(*) FILTER (hit) / count(*) FROM g) AS recall_all, (SELECT count(*) FILTER (hit) / count(*) FROM g WHERE major) AS recall_major,
           (SELECT count(*) FILTER (hit) / count(*) FROM g WHERE NOT major) AS recall_minor
    FROM k
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes of all types; nations are the gold standard, every second a major one."""
    none = F.lit(None).cast("array<string>").alias("aliases")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("type")
    quotes = F.when(F.col("s_nationkey") > 10, F.array(F.lit("quote"))).alias("provenance")
    nodes = table(spark, sf_dir, "supplier").select(kind, quotes, F.concat(F.lit("nation "), "s_nationkey").alias("name"), none)
    tier = F.when(F.col("n_nationkey") % 2 == 0, "major").otherwise("minor").alias("tier")
    gold = table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation "), "n_nationkey").alias("name"), none, tier)
    return evaluate.run_summary(nodes, gold)
