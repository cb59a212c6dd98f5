from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.operators import anchors, evaluate, graph, ontology, retrieve, views
from lectern.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_anchored_chapters_and_fallback(spark):
    one, two = "Dear all. Good day.\n\n***", "“Hope.”\n\nAnd then? Yes."
    chapters = spark.createDataFrame([("b", 1, one), ("b", 2, two)], "book_id string, chapter int, text string")
    full = spark.createDataFrame([("b", one + "\n\n" + two)], "book_id string, text string")
    tokens = spark.createDataFrame(
        [("b", 4, 0, 0, 4), ("b", 4, 0, 5, 9), ("b", 4, 1, 10, 19), ("b", 9, 2, 21, 24), ("b", -1, 0, 26, 30)],
        "book_id string, paragraph_id int, sentence_id int, start_char int, end_char int",
    )
    out = anchors.anchored(chapters, tokens, full).select("chapter", "sid", "text", "kind", "fallback")
    assert rows(out, "chapter", "sid") == [
        (1, "p1.s1", "Dear all.", "body", False), (1, "p1.s2", "Good day.", "body", False), (1, "p2.s1", "***", "scene_break", False),
        (2, "p1.s1", "“Hope.”", "epigraph", True), (2, "p2.s1", "And then?", "body", True), (2, "p2.s2", "Yes.", "body", True),
    ]
    nested = anchors.chapter_details(anchors.anchored(chapters, tokens, full)).filter("chapter = 2").first()
    assert [len(p.sentences) for p in nested.paragraphs] == [1, 2]


def test_cards(spark):
    log = spark.createDataFrame([(1, "create", 0, "a"), (1, "update", 2, "b"), (2, "create", 1, "c"), (2, "delete", 3, "c")], "id int, op string, at int, body string")
    assert rows(views.fold_cards(log).select("id", "body")) == [(1, "b")]
    cards = spark.createDataFrame([("p1.s1", "ask"), ("p1.s2", "note")], "anchor string, kind string")
    asked = spark.createDataFrame([("p1.s1",), ("p1.s2",)], "anchor string")
    assert rows(views.new_questions(asked, cards)) == [("p1.s2",)]


def test_legacy_search(spark):
    nodes = spark.createDataFrame([("Bob", "the clerk", 0), ("Tim", "son of bob", 1)], "name string, description string, seq int")
    assert [r.name for r in retrieve.legacy_search(nodes, "who is bob the clerk").collect()] == ["Bob", "Tim"]


def test_migration_marks_what_changed(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "generic")], "name string, realis string")
    out = graph.migrated(nodes, {"realis": F.lit("actual"), "valence": F.lit(0.0)}).select("name", "realis", "valence", "changed")
    assert rows(out, "name") == [("a", "actual", 0.0, True), ("b", "generic", 0.0, True)]
    assert rows(graph.migrated(nodes, {"realis": F.lit("x")}).select("changed"), "changed") == [(False,), (True,)]


def test_topics(spark):
    docs = spark.createDataFrame([(0, "ghost ghost chain night"), (1, "goose pudding goose night"), (-1, "noise")], "topic int, text string")
    out = ontology.topic_keywords(docs, "topic", "text", 2)
    assert rows(out.select("topic", "keywords"), "topic") == [(0, ["ghost", "chain"]), (1, ["goose", "pudding"])]


def test_fixture_relationships(spark):
    rel = spark.createDataFrame([("Bob Cratchit", "Scrooge", "works for", None)], "source string, target string, relation string, description string")
    out = evaluate.expected_relationships(rel, [("scrooge", "Cratchit", ["work"]), ("Bob", "Tim", ["father"])])
    assert rows(out, "source") == [("Bob", "Tim", False), ("scrooge", "Cratchit", True)]


def test_run_summary(spark):
    nodes = spark.createDataFrame([("Character", ["q"]), ("Theme", None)], "type string, provenance array<string>")
    assert rows(evaluate.run_summary(nodes)) == [(1, 0, 0, 0, 1, 0.5)]


def test_state_files(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"book_id": "a", "ready_for_query": true}')
    (tmp_path / "p1.json").write_text('{"book_id": "a"}')
    assert rows(tables.read_states(spark, str(tmp_path / "s*.json"))) == [("a", "pending", True, 0, 0)]
    assert rows(tables.read_progress(spark, str(tmp_path / "p*.json"))) == [("a", 1, None)]


def test_settings_order():
    s = Settings.load({"batch_size": 4, "use_triplets": "yes"}, {"LECTERN_BATCH_SIZE": "7"})
    assert (s.batch_size, s.use_triplets, s.chunk_tokens) == (7, True, 1500)


def test_topic_keywords_split_texts_once(spark):
    """Scores come from written counts; no later pass goes by the pattern again."""
    from lectern.operators import ontology

    docs = spark.createDataFrame([(0, "apples pears apples"), (1, "ships sails ships"), (-1, "none")], "topic int, text string")
    out = ontology.topic_keywords(docs, "topic", "text")
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.topic: r.keywords[0] for r in out.collect()} == {0: "apples", 1: "ships"}
