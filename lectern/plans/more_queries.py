"""Operators of reading, serving and checking on whole tables, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import asof, evaluate, graph, ontology, retrieve, views
from lectern.plans.registry import query, table

# ---- Events as logs: a user is a book or a card, a day a chapter.


@query("""
    SELECT user_id AS id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'
""")
def folded_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as their log leaves them: a click deletes."""
    op = F.when(F.col("event_type") == "click", "delete").otherwise("update")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), op.alias("op"), F.col("event_id").alias("at"), "value")
    return views.fold_cards(log).select("id", "value")


@query("""
    SELECT user_id AS book_id, CAST(day(ts) AS INTEGER) AS chapter, arg_max(value, event_id) AS cutoff FROM events
    GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'view'
""")
def chapter_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff that was set last in each chapter; a view clears it."""
    op = F.when(F.col("event_type") == "view", "clear").otherwise("set")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("book_id"), F.dayofmonth("ts").alias("chapter"), F.col("value").alias("cutoff"), op.alias("op"), F.col("event_id").alias("updated_at")
    )
    return views.cutoffs(log)


@query("""
    WITH s AS (SELECT l_orderkey AS book_id, string_agg(l_linenumber || ' ' || l_returnflag || ' ' || l_linestatus || ' ' || l_partkey, ';'
                      ORDER BY l_linenumber, l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)) AS stages FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS book_id, o_orderstatus AS status, o_totalprice > 100000 AS ready_for_query, stages FROM orders LEFT JOIN s ON book_id = o_orderkey
""")
def pipeline_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as stages, errors without their traces."""
    error = F.concat(F.lit("Traceback\n  line\n"), F.col("l_partkey").cast("string"), F.lit("\n"))
    stages = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("stage"),
        F.col("l_linestatus").alias("status"), error.alias("error"),
    )
    states = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book_id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("ready_for_query")
    )
    told = F.transform("stages", lambda x: F.concat_ws(" ", x["position"].cast("string"), x["stage"], x["status"], x["error"]))
    return views.pipeline_status(stages, states).withColumn("stages", F.array_join(told, ";"))


@query("""
    WITH u AS (SELECT user_id, list(day(ts)) AS days, string_agg(DISTINCT event_type, ' ') AS said FROM events GROUP BY user_id)
    SELECT user_id, len(list_filter(days, lambda d: d IN (1, 2, 3, 5, 8, 13))) / len(days) AS precision,
           len(list_filter(['Click', 'view', 'ghost'], lambda t: contains(lower(said), lower(t)))) / 3 AS mentioned,
           CASE WHEN list_max(days) > 29 THEN 0.0 ELSE 1.0 END AS safe
    FROM u
""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a user's days were expected, which terms their events say, and whether any is beyond the cursor."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_list(F.dayofmonth("ts")).alias("days"), F.array_join(F.collect_set("event_type"), " ").alias("said")
    )
    expected, terms = F.array(*map(F.lit, (1, 2, 3, 5, 8, 13))), F.array(*map(F.lit, ("Click", "view", "ghost")))
    return per.select(
        "user_id", evaluate.source_precision(F.col("days"), expected).alias("precision"),
        evaluate.mentioned_share(terms, F.col("said")).alias("mentioned"), evaluate.spoiler_safe(F.col("days"), F.lit(29)).alias("safe"),
    )


@query("""
    SELECT event_id, CASE WHEN p IS NOT NULL THEN greatest(c - 1, 0) ELSE c END AS cursor, least(c + 1, 30) >= d AS openable,
           CASE WHEN event_type = 'view' THEN NULL ELSE coalesce(nullif(user_id % 3, 0), c) END AS scope,
           least(100.0, greatest(0.0, c / 20 * 100)) AS fraction
    FROM (SELECT *, least(coalesce(CASE WHEN user_id % 2 = 0 THEN d + 5 END, 15), 15) AS c, CASE WHEN event_type = 'click' THEN 1 END AS p
          FROM (SELECT *, CAST(day(ts) AS INTEGER) AS d FROM events))
""")
def reading_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's reader may see: the graph's cursor, which chapter opens, the graph's scope, how far they are."""
    day = F.dayofmonth("ts")
    rows = table(spark, sf_dir, "events").withColumn("d", day)
    requested, paragraph = F.when(F.col("user_id") % 2 == 0, F.col("d") + 5), F.when(F.col("event_type") == "click", 1)
    chapter = F.least(F.coalesce(requested, F.lit(15)), F.lit(15))
    return rows.select(
        "event_id", retrieve.graph_cursor(requested, F.lit(15), paragraph).alias("cursor"), views.can_open(F.col("d"), F.least(chapter, F.lit(29))).alias("openable"),
        views.graph_scope(F.col("event_type") == "view", F.nullif(F.col("user_id") % 3, F.lit(0)), chapter).alias("scope"),
        views.progress_fraction(chapter, F.lit(20)).alias("fraction"),
    )


# ---- Relationships and nodes of the trade tables.


@query("""
    SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey, l_suppkey,
           coalesce(CASE WHEN l_returnflag = 'R' THEN l_linenumber END, CASE WHEN l_suppkey % 7 > 0 THEN greatest(l_partkey % 50, l_suppkey % 40) END, -1) AS chapter,
           NOT (l_linestatus = 'F' AND l_returnflag <> 'A') AS actual, greatest(l_linenumber, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 50 END) AS latest
    FROM lineitem
""")
def relationship_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's own chapter, else the later one of its ends, if both are known; whether it is actual; its latest chapter."""
    own = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("long"))
    source, target = F.col("l_partkey") % 50, F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey") % 40)
    realis = F.when(F.col("l_returnflag") == "A", "actual").otherwise("generic")
    kind = F.when(F.col("l_linestatus") == "F", "PlotEvent").otherwise("Character")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_partkey", "l_suppkey", F.coalesce(asof.relationship_chapter(own, source, target), F.lit(-1)).alias("chapter"),
        asof.is_actual(kind, realis).alias("actual"),
        asof.effective_chapter(F.col("l_linenumber").cast("long"), F.when(F.col("l_partkey") % 3 > 0, source)).alias("latest"),
    )


@query("""
    WITH c AS (SELECT c_custkey, list_filter([CASE WHEN length(c_name) > 200 THEN 'quote' END, CASE WHEN c_nationkey - 3 < 0 THEN 'char_start' END,
                      CASE WHEN c_nationkey - 1 < 0 THEN 'char_end' END, CASE WHEN NOT c_acctbal / 5000 BETWEEN -1 AND 1 THEN 'valence' END,
                      CASE WHEN NOT c_acctbal / 9000 BETWEEN 0 AND 1 THEN 'confidence' END,
                      CASE WHEN lower(c_mktsegment) NOT IN ('actual', 'generic', 'other') THEN 'realis' END], lambda x: x IS NOT NULL) AS e FROM customer)
    SELECT c_custkey, array_to_string(e, ' ') AS errors FROM c
""")
def constraint_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which field constraints each record breaks."""
    found = graph.constraint_errors(
        F.col("c_name"), F.col("c_nationkey") - 3, F.col("c_nationkey") - 1, F.col("c_acctbal") / 5000, F.col("c_acctbal") / 9000, F.lower("c_mktsegment")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, " ").alias("errors"))


@query("""
    WITH m AS (SELECT c_nationkey AS nation, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'none' END AS type, CASE WHEN c_acctbal > 0 AND c_acctbal > 5000 THEN 0 ELSE 1 END AS filled FROM customer)
    SELECT nation, type, count(*) AS n, CAST(sum(filled) AS BIGINT) AS filled FROM m GROUP BY ALL
""")
def migrated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with missing fields filled, counted by nation and type, and how many were filled."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("type"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("valence"),
    )
    out = graph.migrated(rows, {"type": F.lit("none"), "valence": F.lit(0.0)})
    counts = graph.type_counts(out, "nation")
    filled = out.groupBy("nation", "type").agg(F.sum(F.col("changed").cast("long")).alias("filled"))
    return counts.join(filled, ["nation", "type"])


@query("""
    SELECT s_suppkey, s_acctbal + 1000 AS cost_usd FROM supplier, (SELECT min(s_acctbal + 1000) AS least FROM supplier WHERE s_nationkey > 2)
    WHERE s_nationkey > 2 AND s_acctbal + 1000 <= 8 * least AND s_nationkey / 25 >= 0.4 ORDER BY s_suppkey % 13 DESC, s_suppkey LIMIT 1
""")
def sweep_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs: the best of the affordable ones whose rate is good enough."""
    runs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") > 2, F.col("s_acctbal") + 1000).alias("cost_usd"), (F.col("s_nationkey") / 25).alias("provenance_rate"),
        (F.col("s_suppkey") % 13).alias("minor_recall"), F.col("s_suppkey").alias("seq"),
    )
    return evaluate.pick_winner(runs, 8, 0.4).select("s_suppkey", "cost_usd")


@query("""
    WITH w(name, alias) AS (SELECT n_name, 'Supplier#' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 9, '0') FROM nation)
    SELECT name, lower(name) IN (SELECT lower(s_name) FROM supplier) OR lower(alias) IN (SELECT lower(s_name) FROM supplier) AS passed FROM w
""")
def expected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as expected entities, whose alias is a supplier's name."""
    alias = F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("n_nationkey") * 7).cast("string"), 9, "0"))
    expected = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(alias).alias("aliases"))
    found = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    return evaluate.expected_entities(expected, found)


_FIXTURE = [("cold", "Supplier#00000000", ["returned"]), ("supplier#000000001", "widget", ["flag a", "flag n"]), ("nobody", "cold", ["flag"])]


@query("""
    WITH e AS (SELECT lower(p_name) AS s, lower(s_name) AS t, lower('flag ' || l_returnflag || ' ' || CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'kept' END) AS x
               FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
    w(source, target, k) AS (VALUES ('cold', 'Supplier#00000000', ['returned']), ('supplier#000000001', 'widget', ['flag a', 'flag n']), ('nobody', 'cold', ['flag']))
    SELECT source, target, EXISTS (SELECT 1 FROM e WHERE len(list_filter(k, lambda y: contains(x, y))) > 0 AND (
        ((contains(s, lower(source)) OR contains(lower(source), s)) AND (contains(t, lower(target)) OR contains(lower(target), t)))
        OR ((contains(s, lower(target)) OR contains(lower(target), s)) AND (contains(t, lower(source)) OR contains(lower(source), t))))) AS passed FROM w
""")
def fixture_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of a fixture, either way round, among all lines."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    line = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    relations = line.select(
        F.col("p_name").alias("source"), F.col("s_name").alias("target"), F.concat(F.lit("flag "), "l_returnflag").alias("relation"),
        F.when(F.col("l_returnflag") == "R", "Returned").otherwise("kept").alias("description"),
    )
    return evaluate.expected_relationships(relations, _FIXTURE)


@query("""
    WITH v AS (SELECT *, embedding::DOUBLE[] AS e FROM embeddings),
    f AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_cosine_similarity(v.e, q.e) AS s FROM v AS q, v WHERE q.vec_id % 20 = 0
          QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) <= 40)
    SELECT query_id, vec_id, round(s, 4) AS similarity FROM f
    WHERE (vec_id % 30 <= 20 OR vec_id % 3 = 0) AND label IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AND vec_id % 10 IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
""")
def visible_vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as relationships: of each query's 40 nearest those whose ends are visible and whose chapter, if any, has been read."""
    vectors = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieve.nearest_each(vectors, asked, 40).join(vectors.select("vec_id", "label"), "vec_id")
    found = found.withColumns({
        "chapter": F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 30), "source": F.col("label").cast("string"),
        "target": (F.col("vec_id") % 10).cast("string"), "relation": F.lit("near"),
    })
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("name"))
    return retrieve.visible_triplets(found, names, 20).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


@query("""
    WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, CAST(0 AS INTEGER) AS part, CAST(n AS INTEGER) AS rank, md5(text) AS digest FROM c WHERE n <= 3 AND conv_id % 2 = 0
    UNION ALL SELECT conv_id, 1, CAST(n AS INTEGER), md5(text) FROM c WHERE conv_id % 2 = 1
""")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and read paragraphs side by side, of each conversation: the first three turns of even ones, all turns of odd ones."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(order)).select("conv_id", "rank", F.col("text").alias("content"))
    out = retrieve.contexts(turns.filter("conv_id % 2 = 0"), turns.filter("conv_id % 2 = 1"), ["conv_id"], 3)
    return out.select("conv_id", "part", "rank", F.md5("content").alias("digest"))


@query(r"""
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'book') AS stem,
           CASE WHEN length(html) > 60 THEN html[1:60] || '...' ELSE html END AS short, len(regexp_extract_all(html, '\[([^\]]+)\]', 1)) AS brackets
    FROM pages
""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's file name, its beginning, and how many bracketed notes it holds."""
    return table(spark, sf_dir, "pages").select(
        "page_id", T.filename_stem(F.col("url")).alias("stem"), T.shortened(F.col("html"), 60).alias("short"),
        F.size(T.bracketed(F.col("html"))).cast("long").alias("brackets"),
    )


@query()
def discovered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all documents' paragraphs with their keywords. SQL has no k-means; tests find planted topics."""
    found = ontology.found_topics(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ontology.topic_keywords(found, "topic", "text").select("topic", "label", F.array_join("keywords", " ").alias("keywords"))
