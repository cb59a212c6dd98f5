"""Operators that no query exercises: readers, checked writers, guards, reader state, sweeps."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.identity import cache_key
from lectern.operators import asof, evaluate, graph, ontology, retrieve, segment, views
from lectern.sources import archive, tables
from lectern.streaming import progress


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_profile_files(spark, tmp_path):
    people = [{"id": 1, "names": {"Bob": 2, "Rob": 3}, "g": "he"}, {"id": 2, "names": ["Eve"]}, {"id": 3, "names": {}}, {}]
    (tmp_path / "tale.book").write_text(json.dumps({"characters": people}))
    (tmp_path / "bad.book").write_text("no json")
    out = tables.read_profiles(spark, str(tmp_path / "*.book"))
    assert set(rows(out.select("book_id", "coref_id", "alias", "n", "gender"))) == {
        ("tale", 1, "Bob", 2, "he"), ("tale", 1, "Rob", 3, "he"), ("tale", 2, "Eve", 1, "unknown"), ("tale", 3, None, None, "unknown"), ("tale", -1, None, None, "unknown"),
    }


def test_chunks_are_stored_and_replaced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert tables.read_stored(spark, path, tables.CHUNK).count() == 0
    texts = spark.createDataFrame([("a", "batch_03", "one two. " * 40), ("a", "batch_01", "x"), ("b", "odd", "y")], "book_id string, batch string, text string")
    chunks = segment.rebuilt_chunks(texts, 25)
    assert rows(chunks.select("book_id", "ordinal", "chapter_numbers").filter("ordinal = 0"), "book_id") == [("a", 0, [1]), ("b", 0, [1])]
    tables.write_chunks(chunks, path)
    tables.write_chunks(chunks.filter("book_id = 'b'").withColumn("text", F.lit("new")), path)
    kept = tables.read_stored(spark, path, tables.CHUNK)
    assert kept.filter("book_id = 'a'").count() == chunks.filter("book_id = 'a'").count() > 3
    assert rows(kept.filter("book_id = 'b'").select("text", "chunk_id")) == [("new", "b::chunk_0000")]
    assert rows(tables.chunk_headers(kept, 25), "book_id")[1] == ("b", 25, 1)
    with pytest.raises(Exception, match="no ordinal"):
        tables.write_chunks(chunks.withColumn("ordinal", F.lit(None).cast("int")), path)
    assert tables.read_stored(spark, path, tables.CHUNK).count() == kept.count()
    index = segment.chapter_index(kept.withColumn("chapter", F.element_at("chapter_numbers", 1)), spark.createDataFrame([("a", 1, "p")], "book_id string, chapter int, text string"))
    tables.write_index(index, str(tmp_path / "index"))
    assert tables.read_stored(spark, str(tmp_path / "index"), tables.INDEX).count() == index.count()


def test_artifacts_and_reports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1, "Character", "i", "Bob")], "book_id string, batch int, type string, id string, name string")
    batches = spark.createDataFrame([("a", 1, "text")], "book_id string, batch int, text string")
    tables.write_artifacts(tables.batch_artifacts(batches, nodes), str(tmp_path / "out"))
    assert json.loads(spark.read.parquet(str(tmp_path / "out/nodes")).first().node) == {"type": "Character", "id": "i", "name": "Bob"}
    report = spark.createDataFrame([("x|y", 1.5)], "name string, score double")
    tables.write_report(report, str(tmp_path / "run"))
    assert rows(spark.read.json(str(tmp_path / "run"))) == [("x|y", 1.5)]
    assert [r.line for r in tables.markdown_report(report, "Run", "name", "score").collect()] == ["# Run", "", "| name | score |", "| --- | --- |", "| x y | 1.5 |"]
    chapters = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two")], "path string, chapter int, text string")
    book = archive.book_rows(chapters)
    full = book["full_texts"].first().text
    for r in book["chapters"].collect():
        assert full[r.start_char : r.end_char] == r.text


def test_limits_from_the_environment():
    assert archive.Limits.load({"LECTERN_EPUB_RATIO": "5", "LECTERN_EPUB_TOTAL_BYTES": "9"}) == archive.Limits(5.0, 100 << 20, 9)
    assert archive.Limits.load({}) == archive.Limits()


def test_ready_chapters(spark, tmp_path):
    for book in ("a", "b"):
        folder = tmp_path / book / "raw/chapters"
        folder.mkdir(parents=True)
        (folder / "chapter_02.txt").write_text("two")
        (folder / "chapter_10.txt").write_text("ten")
    states = spark.createDataFrame([("a", True), ("b", False)], "book_id string, ready_for_query boolean")
    out = tables.read_chapters(spark, str(tmp_path / "*/raw/chapters/*.txt"), states)
    assert rows(out, "chapter") == [("a", 2, "two"), ("a", 10, "ten")]
    assert rows(tables.full_texts(out)) == [("a", "two\n\nten")]


def test_annotation_files(spark):
    raw = spark.createDataFrame([("7", "0", "1", "PROP", "PER", "Bob"), ("x", None, "2", None, None, None)], "COREF string, start_token string, end_token string, prop string, cat string, text string")
    assert rows(tables.mentions(raw), "end_token") == [(7, 0, 1, "PROP", "PER", "Bob"), (-1, -1, 2, "", "", "")]
    said = spark.createDataFrame([("hi", "-1", "3", "4"), ("ho", "5", "x", None)], "quote string, char_id string, quote_start string, quote_end string")
    assert rows(tables.quotes(said), "text") == [("hi", None, 3, 4), ("ho", 5, -1, -1)]


def test_triples_as_text(spark, tmp_path):
    triples = spark.createDataFrame([("A b", "label", 'say "x"'), ("A b", "type", "Class")], "s string, p string, o string")
    tables.write_ntriples(triples, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == [
        '<urn:lectern:A_b> <urn:lectern:label> "say \\"x\\"" .', "<urn:lectern:A_b> <urn:lectern:type> <urn:lectern:Class> .",
    ]
    gold = tmp_path / "gold.json"
    gold.write_text('[{"name": "Bob"}]')
    assert rows(tables.read_gold(spark, str(gold), "name string")) == [("Bob",)]


def test_question_guards(spark):
    states = spark.createDataFrame([("a", True), ("b", False)], "book_id string, ready_for_query boolean")
    retrieve.guard_question("x" * 2000, "CHUNKS", states, "a")
    for error, args in ((ValueError, ("x" * 2001, "CHUNKS", "a")), (ValueError, ("x", "SQL", "a")), (LookupError, ("x", "CHUNKS", "c")), (RuntimeError, ("x", "CHUNKS", "b"))):
        with pytest.raises(error):
            retrieve.guard_question(args[0], args[1], states, args[2])
    nodes = spark.createDataFrame([("needle", None)], "name string, description string")
    long = "word " * 500 + "needle"
    assert [r.score for r in retrieve.rank_nodes(nodes, long).collect()] == [1]


def test_results_are_unwrapped(spark):
    inner = "struct<description:string,name:string,text:string,chapter:int,first_chapter:int,kind:string>"
    found = spark.createDataFrame([(("", "Bob", None, 3, 5, "Character"),), ((None, None, "said", None, None, "str"),)], f"search_result {inner}")
    assert rows(retrieve.unwrapped(found), "content") == [("Bob", 5, "Character"), ("said", None, None)]
    plain = spark.createDataFrame([("d", 2)], "description string, chapter int")
    assert rows(retrieve.unwrapped(plain)) == [("d", 2, None)]


def test_answers_are_assembled(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert get(retrieve.composed_answer(F.lit(" "), texts(), texts("a", "b"))) == "a\n\nb" and get(retrieve.composed_answer(F.lit("yes"), texts("a"), texts())) == "yes"
    assert get(retrieve.quoted_question(F.lit("why?"), F.lit("ex"))) == 'About "ex": why?' and get(retrieve.quoted_question(F.lit("why?"), F.lit(""))) == "why?"
    assert get(retrieve.asked_about(F.lit("q"), F.lit("why?"))) == 'Asked about "q": why?'
    assert get(retrieve.graph_cursor(F.lit(9), F.lit(4), F.lit(2))) == 3 and get(retrieve.graph_cursor(F.lit(None).cast("int"), F.lit(4), F.lit(None))) == 4
    assert get(retrieve.read_paragraphs(texts("a", "b", "c"), F.lit(1))) == ["a", "b"]
    first = spark.createDataFrame([("a", 0), ("b", 1)], "content string, rank int")
    rest = spark.createDataFrame([("b", 0), ("c", 1)], "content string, rank int")
    assert rows(retrieve.splice_front(first, rest).select("content"), "part", "rank") == [("a",), ("b",), ("c",)]
    assert rows(retrieve.context(first, rest, 1), "part", "rank") == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    found = spark.createDataFrame([("a", "r", "b", None), ("a", "r", "b", 9), ("a", None, "b", 1), ("a", "r", "z", 1)], "source string, relation string, target string, chapter int")
    assert rows(retrieve.visible_triplets(found, names, 3)) == [("a", "r", "b", None)]
    assert get(T.result_text(F.lit(""), F.lit("n"), F.lit("t"), F.struct(F.lit(1)))) == "n"
    assert get(asof.effective_chapter(F.lit(2), F.lit(None).cast("int"), F.lit(5))) == 5
    assert get(asof.relationship_chapter(F.lit(None).cast("int"), F.lit(2), F.lit(7))) == 7
    same = asof.identity(F.lit("PlotEvent"), F.lit("n"), *[F.lit("")] * 3, F.lit(3), F.lit("d"))
    assert tuple(get(same)) == ("PlotEvent", ["3", "d"])


def test_reader_state(spark):
    log = spark.createDataFrame([("a", 1, 5, "set", 0), ("a", 1, 7, "set", 1), ("a", 2, 3, "set", 0), ("a", 2, None, "clear", 9)], "book_id string, chapter int, cutoff int, op string, updated_at int")
    assert rows(views.cutoffs(log)) == [("a", 1, 7)]
    ties = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y")], "key string, updated_at int, v string")
    assert rows(views.latest(ties, "key")) == rows(views.latest(ties.orderBy(F.desc("v")), "key")) == [("k", 1, "y")]
    stages = spark.createDataFrame([("a", 1, "graph", "failed", "Trace\n  line\nError: x"), ("a", 0, "parse", "done", None)], "book_id string, position int, stage string, status string, error string")
    states = spark.createDataFrame([("a", "failed", False)], "book_id string, status string, ready_for_query boolean")
    status = views.pipeline_status(stages, states).first()
    assert [(s.stage, s.error) for s in status.stages] == [("parse", None), ("graph", "Error: x")]
    cards = spark.createDataFrame([(i, "p1.s1", "ask", i) for i in range(5)], "id int, anchor string, kind string, updated_at int")
    assert rows(views.found_card(cards, "p1.s1", "ask").select("id")) == [(0,)]
    threads = views.follow_ups(cards, spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, at int, text string"))
    assert [r.text for r in threads.filter("id = 1").first().thread] == ["a", "b"]
    opened = spark.createDataFrame([(0, 0), (1, 1), (4, 2)], "id int, seq int")
    out = views.with_overrides(cards, opened, "anchor").filter("expanded").select("id")
    # 4, 3 at first; 0 takes 3's place, 1 takes 0's (the oldest expanded), 4 is expanded already
    assert rows(out, "id") == [(1,), (4,)]
    assert views.with_overrides(cards.filter("id < 2"), opened.limit(0), "anchor").filter("expanded").count() == 2
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "book_id string, chapter int, note string")
    assert rows(views.annotations_of(marks, "a", 2)) == [("a", 2, "y")]
    page = views.page_cards(cards.withColumn("kind", F.when(F.col("id") == 4, "highlight").otherwise("ask")), spark.createDataFrame([("p1.s1",)], "anchor string"), "anchor")
    assert rows(page.filter("expanded").select("id"), "id") == [(2,), (3,)]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(views.graph_scope(F.lit(False), F.lit(None).cast("int"), F.lit(4))) == 4 and get(views.hidden(F.lit("p2.s10"), F.lit("p2.s9")))
    assert get(views.can_open(F.lit(3), F.lit(2))) and get(views.progress_fraction(F.lit(1), F.lit(4))) == 25.0


def test_moves_are_checked(spark):
    books = spark.createDataFrame([("a", 3)], "book_id string, chapters int")
    moves = spark.createDataFrame([("a", 1, None), ("a", 4, 0), ("a", 2, -1), ("z", 1, 0), ("a", 0, 0)], "book_id string, chapter int, paragraph int")
    assert rows(progress.checked_moves(moves, books)) == [("a", 1, None)]
    stamped = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 11:00:00",)], "ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.moves for r in progress.activity(stamped).collect()] == [2]


def test_scores_and_sweeps(spark):
    books = spark.createDataFrame([("a", "word " * 900), ("b", "")], "book_id string, text string")
    out = evaluate.chunk_sweep(books.withColumn("text", F.replace("text", F.lit("word word "), F.lit("word. word\n\n"))), (500, 100))
    assert {(r.book_id, r.chunk_size): r.n_chunks for r in out.collect()} == {("a", 500): 3, ("a", 100): 14, ("b", 500): 1, ("b", 100): 1}
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(evaluate.extraction_cost(F.lit(10), F.lit(1500))) == round(10 * (1500 * 0.00015 + 500 * 0.0006) / 1000, 4)
    ints, texts = lambda *x: F.array(*map(F.lit, x)), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert get(evaluate.source_precision(ints(1, 2, 2), ints(2))) == pytest.approx(2 / 3) and get(evaluate.mentioned_share(texts("Bob", "x"), F.lit("bob"))) == 0.5
    assert get(evaluate.spoiler_safe(ints(1, 9), F.lit(3))) == 0.0 and get(evaluate.known_answer(texts("bob"), texts("eve"), F.lit("Bob only")))
    assert get(evaluate.chapter_coverage(ints(3, 1), ints(1))) == [3]
    names = "name string, aliases array<string>"
    wanted, found = spark.createDataFrame([("Bob", ["B"]), ("Eve", None)], names), spark.createDataFrame([("b", None)], names)
    assert rows(evaluate.expected_entities(wanted, found), "name") == [("Bob", True), ("Eve", False)]
    ours, theirs = spark.createDataFrame([("x", ["x"]), ("y", ["y"])], names), spark.createDataFrame([("X", ["x"]), ("Z", ["z"])], names)
    assert rows(evaluate.wikidata_matches(ours, theirs), "side") == [("extra", "y"), ("missed", "Z")]
    nodes = spark.createDataFrame([(["q"],), ([],)], "provenance array<string>")
    assert rows(evaluate.provenance_rate(nodes)) == [(0.5,)]


def test_graph_pieces(spark):
    kinds = {"relation_type": F.lit(True)}
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    none = F.lit(None).cast("string")
    assert get(graph.infer_type(none, kinds)) == "Unknown" and get(graph.infer_type(F.lit(""), {"name": F.lit(True)})) == "Unknown"
    assert get(graph.infer_type(none, {"chapter": F.lit(True), "description": F.lit(True)})) == "Unknown"
    requests = spark.createDataFrame([("a", "k1"), ("b", "k2")], "q string, cache_key string")
    cached, left = graph.split_cached(requests, spark.createDataFrame([("k1", "answer")], "cache_key string, result string"))
    assert rows(cached.select("q", "result")) == [("a", "answer")] and rows(left.select("q")) == [("b",)]
    assert len(get(cache_key(F.lit("a"), F.lit("b")))) == 64
    nodes = spark.createDataFrame([("Character", None, 2), ("Character", 5, 2)], "type string, last_known_chapter int, first_chapter int")
    assert rows(nodes.select(graph.default_last_known().alias("x")), "x") == [(2,), (5,)] and rows(graph.type_counts(nodes)) == [("Character", 2)]
    records = spark.createDataFrame([("a", 0, "d1", 3), ("a", 1, "d2", 1), ("b", 2, "e", 2)], "k string, seq int, d string, c int")
    written = spark.createDataFrame([("a", "both"), ("b", "ignored")], "k string, resolved_description string")
    assert rows(graph.consolidate(records, ["k"], "d", "c", "seq", written).select("k", "d", "c"), "k") == [("a", "both", 1), ("b", "e", 2)]
    seen = spark.createDataFrame([("loves",)], "name string")
    found = spark.createDataFrame([("loves",), ("betrays bob",), ("ghost",)], "term string")
    assert rows(ontology.term_relations(found, seen)) == [("betrays_bob",)]


def test_discovery(spark):
    profiles = spark.createDataFrame([("Bob", 3)], "name string, n long")
    mentions = spark.createDataFrame([("LOC", "NOM", "town"), ("PER", "PRON", "he")], "cat string, prop string, text string")
    verbs = spark.createDataFrame([("loves", 2)], "verb string, n long")
    texts = spark.createDataFrame([(1, "ghost chains rattle loudly here\n\nghost chains rattle in the dark night\n\nnothing else is said in this paragraph")], "id int, text string")
    out = ontology.discovered(profiles, mentions, verbs, texts)
    assert ("ghost chains",) in rows(out["terms"].select("term")) and rows(out["relations"].select("name")) == [("loves",)]
    assert {("Bob", "type", "Character"), ("loves", "domain", "Entity")} <= set(rows(out["triples"]))
    assert out["themes"].count() == 0
