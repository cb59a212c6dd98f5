import io
import zipfile

from pyspark.sql import functions as F

from lectern.operators import annotate, asof, coref, evaluate, graph, ontology, retrieve, segment, views
from lectern.sources import archive, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_snapshot_keeps_first_of_ties_and_first_place(spark):
    nodes = spark.createDataFrame([("a", 1, 0, "x"), ("b", 2, 1, "y"), ("a", 2, 2, "z"), ("a", 2, 3, "w"), ("c", None, 4, "v")], "k string, v int, seq int, d string")
    out = asof.snapshot(nodes, ["k"], "v", "seq", 2).select("k", "v", "d", "first_seq")
    assert rows(out, "first_seq") == [("a", 2, "z", 0), ("b", 2, "y", 1)]
    cursors = spark.createDataFrame([(1,), (2,), (9,)], "cursor int")
    many = asof.snapshots(nodes, cursors, ["k"], "v", "seq", "cursor").select("cursor", "k", "d")
    assert rows(many, "cursor", "k") == [(1, "a", "x"), (2, "a", "z"), (2, "b", "y"), (9, "a", "z"), (9, "b", "y")]


def test_edges_need_both_ends(spark):
    edges = spark.createDataFrame([("a", "r", "b", 1, 0), ("a", "r", "b", 2, 1), ("a", "r", "z", 1, 2), ("b", "r", "a", 5, 3)], "source string, relation string, target string, version int, seq int")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(asof.visible_edges(edges, names, "version", "seq", 3).select("source", "target", "version")) == [("a", "b", 2)]


def test_expansion_skips_hubs_and_loops(spark):
    edges = [(i, "hub", f"n{i}") for i in range(51)] + [(100 + i, "ok", f"m{i}") for i in range(50)] + [(200, "ok", "ok")]
    edges = spark.createDataFrame(edges, "seq long, source string, target string")
    seeds = spark.createDataFrame([("hub", 0), ("ok", 1)], "name string, rank int")
    out = rows(asof.expand_neighbours(edges, seeds, 50, 20))
    assert out[:2] == [("hub", 0), ("ok", 0)] and len(out) == 20 and {n for n, h in out if h} == {f"m{i}" for i in range(18)}


def test_cursor_translation_and_chunk_index(spark):
    """Two books whose numbers overlap."""
    index = spark.createDataFrame(
        [("a", 1, 0, 3, [0, 1, 3]), ("a", 4, 4, 5, []), ("b", 1, 0, 0, [0]), ("b", 2, 1, 9, [0, 8])],
        "book_id string, chapter int, first_ordinal int, last_ordinal int, paragraph_breakpoints array<int>",
    )
    cursors = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", 1), ("b", 7), ("c", 1)], "book_id string, cursor int")
    out = rows(asof.cursor_ordinals(cursors, index), "book_id", "cursor")
    assert out == [("a", 0, None), ("a", 1, 3), ("a", 3, 3), ("a", 4, 5), ("b", 1, 0), ("b", 7, 9), ("c", 1, None)]
    at = spark.createDataFrame([("a", 1, None), ("a", 1, 1), ("a", 1, 9), ("a", 4, 2), ("b", 2, 1)], "book_id string, chapter int, paragraph int")
    assert [r[3] for r in rows(segment.ordinal_at(at, index), "book_id", "chapter", "paragraph")] == [3, 1, 3, 5, 9]
    before = segment.ordinal_before(spark.createDataFrame([("a", 1), ("a", 3), ("a", 4), ("b", 2), ("b", 5)], "book_id string, chapter int"), index)
    assert rows(before, "book_id", "chapter") == [("a", 1, -1), ("a", 3, 3), ("a", 4, 3), ("b", 2, 0), ("b", 5, 9)]
    of = segment.chapter_of(spark.createDataFrame([("a", 2), ("a", 9), ("b", 2), ("b", 9)], "book_id string, ordinal int"), index)
    assert rows(of, "book_id", "ordinal") == [("a", 2, 1), ("a", 9, None), ("b", 2, 2), ("b", 9, 2)]
    chunks = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("b", 0, 1)], "book_id string, ordinal int, chapter int")
    chapters = spark.createDataFrame([("a", 1, "a\n\nb\n\nc\n\nd"), ("b", 1, "x\n\ny")], "book_id string, chapter int, text string")
    assert rows(segment.chapter_index(chunks, chapters), "book_id") == [("a", 1, 0, 2, [0, 0, 1, 2]), ("b", 1, 0, 0, [0, 0])]


def test_book_snapshots_by_ordinal(spark):
    """Each book's reader has a chapter; a node without an ordinal counts from its chapter's end."""
    index = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 2, 3), ("b", 1, 0, 5)], "book_id string, chapter int, first_ordinal int, last_ordinal int")
    nodes = spark.createDataFrame(
        [("a", "X", 1, 0, 0, "old"), ("a", "X", 2, 3, 1, "new"), ("a", "Y", 1, None, 2, "no ordinal"), ("b", "X", 1, 5, 0, "other book"), ("a", "Z", 9, None, 3, "no chapter")],
        "book_id string, name string, chapter int, ordinal int, seq int, d string",
    )
    cursors = spark.createDataFrame([("a", 1), ("b", 1)], "book_id string, cursor int")
    out = asof.book_snapshot(nodes, index, cursors, ["name"], "ordinal", "chapter", "seq").select("book_id", "name", "d")
    assert rows(out, "book_id", "name") == [("a", "X", "old"), ("a", "Y", "no ordinal"), ("b", "X", "other book")]


def test_many_cursors_meet_on_strips(spark, monkeypatch):
    nodes = spark.createDataFrame([("k", v, v, f"d{v}") for v in (1, 4, 90)] + [("l", 50, 0, "e")], "k string, v int, seq int, d string")
    cursors = spark.createDataFrame([(c,) for c in range(-3, 120, 7)], "cursor int")
    whole = rows(asof.snapshots(nodes, cursors, ["k"], "v", "seq", "cursor").select("cursor", "k", "d"), "cursor", "k")
    monkeypatch.setattr(asof, "BROADCAST_CURSORS", 0)
    monkeypatch.setattr(asof, "STRIPS", 5)
    assert rows(asof.snapshots(nodes, cursors, ["k"], "v", "seq", "cursor").select("cursor", "k", "d"), "cursor", "k") == whole
    assert len(whole) == 27


def test_chunks_keep_segments_whole(spark):
    docs = spark.createDataFrame([("a", "x" * 30 + "\n" + "y" * 15 + "\n" + "z" * 20), ("b", "one. two"), ("c", ""), ("d", None), ("e", "p\x00q\n\nr")], "id string, text string")
    out = rows(segment.chunk(docs, "id", "text", 10).select("id", "chunk", "text", "start_char", "end_char"), "id", "chunk")
    assert out == [("a", 0, "x" * 30, 0, 30), ("a", 1, "y" * 15 + "\n" + "z" * 20, 31, 67), ("b", 0, "one.  two", 0, 9), ("c", 0, "", 0, 0), ("e", 0, "p\x00q\n\nr", 0, 6)]


def test_batches(spark):
    chapters = spark.createDataFrame([("b", i, "x" * n) for i, n in enumerate((40, 400, 40, 40))], "book string, n int, text string")
    assert [r[1:4] for r in rows(segment.fixed_batches(chapters, "book", "n", "text", 3), "batch")] == [(0, 0, 3), (1, 3, 1)]
    assert [r[1:4] for r in rows(segment.budget_batches(chapters, "book", "n", "text", 100), "batch")] == [(0, 0, 1), (1, 1, 1), (2, 2, 2)]


def test_ranking_counts_repeats_and_drops_misses(spark):
    nodes = spark.createDataFrame([("Bob Cratchit", "a clerk", 0), ("Tim", None, 1), ("Ghost", "of bob", 2)], "name string, description string, seq int")
    out = retrieve.rank_nodes(nodes, "Bob and bob clerk?").select("name", "score", "content")
    assert rows(out, F.desc("score")) == [("Bob Cratchit", 3, "Bob Cratchit — a clerk"), ("Ghost", 2, "Ghost — of bob")]
    assert retrieve.rank_nodes(nodes, "??").count() == 3
    edges = spark.createDataFrame([("Bob Cratchit", "father of", "Tim", "kind", 0)], "source string, relation string, target string, description string, seq int")
    items = retrieve.answer_items(nodes, edges, "clerk", use_triplets=False).select("name", "score").collect()
    assert [tuple(r) for r in items] == [("Bob Cratchit", 1), ("Tim", 0)]


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in rows(df.select(retrieve.cosine(F.col("a"), F.col("b"))))] == [0.0, 0.7071]


def test_validation_keeps_longest_description(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    rel = spark.createDataFrame([("a", "r", "b", "x", 0), ("a", "r", "b", "xx", 1), ("a", "r", "b", "yy", 2), ("a", "r", "q", "z", 3)], "source string, relation string, target string, description string, seq int")
    assert rows(graph.validate_relationships(rel, names).select("source", "target", "description", "seq")) == [("a", "b", "xx", 0)]
    chunked = rel.withColumn("chunk", F.col("seq") % 2)
    known = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1)], "name string, chunk int")
    out = graph.validate_relationships(chunked, known, by=["chunk"])
    assert rows(out.select("source", "target", "description", "chunk")) == [("a", "b", "yy", 0)]


def test_name_resolution_last_record_wins(spark):
    groups = spark.createDataFrame([(1, ["a", "x", "b"]), (2, [])], "id int, names array<string>")
    characters = spark.createDataFrame([("a", "i1", 0), ("a", "i2", 1), ("b", "i3", 2)], "name string, id string, seq int")
    assert rows(graph.resolve_names(groups, "id", "names", characters), "id") == [(1, ["i2", "i3"]), (2, [])]


def test_provenance_and_constraints(spark):
    df = spark.createDataFrame([("some text", [("me te",)]), ("some text", [("no",)]), ("t", [])], "t string, p array<struct<quote:string>>")
    assert [r[0] for r in rows(df.select(graph.has_provenance(F.col("t"), F.col("p"))))] == [True, False, True]
    bad = spark.range(1).select(graph.constraint_errors(F.lit("q"), F.lit(-1), F.lit(0), F.lit(2.0), F.lit(None).cast("double"), F.lit("maybe")).alias("e"))
    assert rows(bad) == [(["char_start", "valence", "realis"],)]


def test_backfill_by_text_then_chapter(spark):
    nodes = spark.createDataFrame([("n1", "b", 1, "small dog"), ("n2", "b", 2, "absent words"), ("n3", "b", 9, "cat")], "id string, book_id string, chapter int, text string")
    chunks = spark.createDataFrame([("b", 0, "a cat", [1]), ("b", 1, "the small dog", [1, 2]), ("b", 2, "a small dog", [2])], "book_id string, ordinal int, text string, chapter_numbers array<int>")
    assert rows(graph.backfill_ordinals(nodes, chunks), "id") == [("n1", 1), ("n2", 2), ("n3", 0)]


def test_names_from_mentions(spark):
    books = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("book_id")
    profiles = spark.createDataFrame([(1, "CHARACTER_1"), (2, "CHARACTER_2"), (3, "Ann")], "coref_id int, canonical_name string").select("*", books)
    mentions = [(1, "PROP", "Bob", 0), (1, "PROP", "Rob", 1), (1, "PROP", "Rob", 2), (2, "NOM", "him", 3), (2, "NOM", "the ghost", 4), (3, "PROP", "Z", 5)]
    mentions = spark.createDataFrame([("a", *m) for m in mentions] + [("b", 2, "PROP", "Eve", 0)], "book_id string, coref_id int, prop string, text string, seq int")
    out = annotate.enrich_names(profiles, mentions).select("book_id", "coref_id", "canonical_name", "aliases")
    assert rows(out, "book_id", "coref_id") == [
        ("a", 1, "Rob", {"Bob": 1, "Rob": 2}), ("a", 2, "The Ghost", {"the ghost": 1}), ("a", 3, "Ann", None),
        ("b", 1, "CHARACTER_1", None), ("b", 2, "Eve", {"Eve": 1}), ("b", 3, "Ann", None),
    ]


def test_annotations_put_together(spark):
    """Two books with the same ids: names, speakers, offsets and sentences are each book's own."""
    names = spark.createDataFrame([("a", 1, "Bob", 3, 0), ("a", 1, "Rob", 3, 1), ("b", 1, None, None, None)], "book_id string, coref_id int, alias string, n long, pos int")
    tokens = [(b, i, 0, w, 10 * k + i, 10 * k + i + 1) for k, b in enumerate("ab") for i, w in enumerate(("He", "ran", ".", "He"))]
    tokens = spark.createDataFrame(tokens, "book_id string, token_id int, sentence_id int, text string, start_char int, end_char int")
    mentions = [("a", 1, "PROP", "Bob", "PER", 0, 1, 0), ("b", 1, "NOM", "the cat", "PER", 0, 9, 0), ("b", 7, "PRON", "it", "VEH", 1, 1, 1)]
    mentions = spark.createDataFrame(mentions, "book_id string, coref_id int, prop string, text string, cat string, start_token int, end_token int, seq int")
    quotes = spark.createDataFrame([("a", "hi", 1, 0, 1), ("b", "ho", 5, 0, 1)], "book_id string, text string, speaker_coref_id int, start_token int, end_token int")
    out = annotate.parsed(tokens, mentions, quotes, names)
    assert rows(out["profiles"].select("book_id", "canonical_name"), "book_id") == [("a", "Bob"), ("b", "The Cat")]
    assert rows(out["tokens"].filter("token_id = 3").select("sentence_id"), "book_id") == [(1,), (1,)]
    assert rows(out["mentions"].select("canonical_name", "start_char", "end_char"), "book_id", "seq") == [("Bob", 0, 2), ("The Cat", 10, 0), ("it", 11, 12)]
    assert rows(out["quotes"].select("speaker_name", "start_char"), "book_id") == [("Bob", 0), ("Unknown", 10)]
    sheets = annotate.sheets(
        names, entities=annotate.cheat_sheet(out["mentions"]), quotes=annotate.quote_sheet(out["quotes"].withColumn("seq", F.lit(0))),
        classes=annotate.class_sheet(spark.createDataFrame([("a", "Character", 0), ("a", "Theme", 1)], "book_id string, class string, seq int")),
        relations=annotate.relation_sheet(spark.createDataFrame([("b", "loves", 0), ("b", "fears", 1)], "book_id string, name string, seq int")),
    )
    a, b = sheets.orderBy("book_id").collect()
    assert (a.entities, a.quotes, a.classes) == ("- #1 Bob (PER)", '- Bob: "hi"', "Character, Theme, PlotEvent, Relationship")
    assert (b.entities, b.relations) == ("- #1 the cat (PER)", "loves, fears") and b.classes.startswith("Character, Location") and a.relations.startswith("(use")
    profiles = annotate.cluster_names(spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 1)], "book_id string, coref_id int, canonical_name string, seq int"))
    assert rows(profiles) == [("a", 1, "y")]
    assert spark.range(1).select(annotate.mention_total(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("n")).first().n == 5


def test_coref_rules_and_rewrite(spark):
    mentions = spark.createDataFrame(
        [("b", 1, 0, 0, "PROP", "Ann"), ("b", 2, 1, 4, "PROP", "Eve"), ("b", 1, 1, 6, "PRON", "she"), ("b", 1, 6, 9, "PRON", "she"), ("b", 2, 9, 12, "NOM", "STAVE ONE")],
        "book_id string, coref_id int, sentence_id int, end_token int, prop string, text string",
    )
    labels = spark.createDataFrame([("b", 1, "Ann"), ("b", 2, "Eve"), ("c", 1, "Zoe")], "book_id string, coref_id int, label string")
    out = coref.annotate(mentions, labels, labels.select("book_id", "coref_id"))
    assert rows(out.select("end_token", "rule"), "end_token") == [(0, None), (4, None), (6, "ambiguity"), (9, "distance"), (12, None)]
    tokens = spark.createDataFrame([("b", 1, 5, "and", 0, 3), ("b", 1, 6, "she", 5, 8), ("b", 1, 7, ".", 8, 9), ("b", -1, 8, "x", 9, 10)], "book_id string, chapter int, token_id int, text string, start_char int, end_char int")
    marks = out.filter("rule is not null").select("book_id", "end_token", "label")
    assert rows(coref.resolved_text(tokens, marks)) == [("b", 1, "and she [Ann].")]


    texts = spark.createDataFrame([("b", 1, 0, "and\n\nshe.")], "book_id string, chapter int, start_char int, text string")
    assert rows(coref.resolved_text(tokens, marks, texts=texts)) == [("b", 1, "and\n\nshe [Ann].")]
    profiles = spark.createDataFrame([("b", 1, "Ann"), ("b", 9, "Max")], "book_id string, coref_id int, canonical_name string")
    stats = coref.cluster_stats(out, profiles)
    assert rows(stats.select("coref_id", "canonical_name", "mention_count", "resolution_count", F.size("mentions")), "coref_id") == [
        (1, "Ann", 3, 2, 3), (2, "CHARACTER_2", 2, 0, 2), (9, "Max", 0, 0, 0),
    ]
    assert [r.coref_id for r in coref.top_clusters(stats, 2).collect()] == [1, 2]
    assert rows(coref.rule_counts(out, "book_id"), "rule") == [("b", "ambiguity", 1), ("b", "distance", 1)]
    assert coref.artifacts(out, profiles, texts)["log"].count() == 2
    last = spark.createDataFrame([("b", 4, 0, "x"), ("b", 4, 1, "y")], "book_id string, end_token int, seq int, label string")
    assert [r.label for r in coref.last_mention_per_token(last, "end_token").collect()] == ["y"]


def test_shortest_unique_alias(spark):
    """Names are unique within a book: two books may each own a Bob."""
    aliases = [(1, "Bob", 0), (1, "Bob Cratchit", 1), (2, "bob", 0), (2, "Robert", 1), (3, "X", 0), (4, "x", 0)]
    aliases = spark.createDataFrame([("a", *x) for x in aliases] + [("b", 1, "Bob", 0)], "book_id string, coref_id int, alias string, pos int")
    assert rows(coref.shortest_unique_alias(aliases), "book_id", "coref_id") == [
        ("a", 1, "Bob Cratchit"), ("a", 2, "Robert"), ("a", 3, "X"), ("a", 4, "x"), ("b", 1, "Bob"),
    ]


def test_chapter_ranges(spark):
    chapters = [("a", 1, 0, 10), ("a", 2, 10, 9000), ("a", 3, 9000, 9000), ("b", 1, 5, 9001)]
    chapters = spark.createDataFrame(chapters, "book_id string, chapter int, start_char int, end_char int")
    tokens = [("a", 0, 0), ("a", 1, 9), ("a", 2, 10), ("a", 3, 8999), ("a", 4, 99999), ("b", 0, 0), ("b", 1, 9000), ("b", 2, 9000)]
    tokens = spark.createDataFrame(tokens, "book_id string, token_id int, start_char int")
    out = annotate.assign_chapters(tokens, chapters).select("book_id", "token_id", "chapter")
    assert rows(out, "book_id", "token_id") == [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, -1), ("b", 0, -1), ("b", 1, 1), ("b", 2, 1)]
    assert rows(annotate.chapter_token_ranges(chapters, tokens), "book_id", "chapter") == [("a", 1, 0, 2), ("a", 2, 2, 4), ("a", 3, 0, 0), ("b", 1, 1, 3)]


def test_metrics(spark):
    none = "name string, aliases array<string>"
    gold = spark.createDataFrame([("Bob Cratchit", ["Bob"]), ("Tim", None)], none)
    found = spark.createDataFrame([("bob!", None)], none)
    assert rows(evaluate.entity_recall(gold, found)) == [(1, 2, 0.5, ["Tim"])]
    pairs = "source string, target string"
    wanted, have = spark.createDataFrame([("A", "b"), ("c", "d"), ("Tim", "Bob Cratchit")], pairs), spark.createDataFrame([("B", "a"), ("bob", "tim")], pairs)
    assert rows(evaluate.relationship_recall(wanted, have)) == [(1, 3, 1 / 3, ["Tim → Bob Cratchit", "c → d"])]
    assert rows(evaluate.relationship_recall(wanted, have, gold)) == [(2, 3, 2 / 3, ["c → d"])]
    tiers = spark.createDataFrame([("Bob", None, "major"), ("Eve", None, "minor")], f"{none}, tier string")
    assert [rows(evaluate.entity_recall(tiers, found, t))[0][:2] for t in (None, "major", "minor")] == [(1, 2), (1, 1), (0, 1)]
    runs = spark.createDataFrame([(0, 1.0, 0.9, 0.5), (1, 1.4, 0.9, 0.7), (2, 1.4, 0.5, 0.9), (3, 9.0, 0.9, 0.9), (4, None, 1.0, 1.0)], "seq int, cost_usd double, provenance_rate double, minor_recall double")
    assert evaluate.pick_winner(runs).first()["seq"] == 1
    checks = spark.createDataFrame([("passed",), ("skipped",)], "status string")
    assert rows(evaluate.rollup(checks)) == [(1, 0, 1, True)]


def test_review_edits(spark):
    items = spark.createDataFrame([("a",), ("b",)], "name string")
    edits = spark.createDataFrame([("remove", "a", None, 0), ("rename", "b", "bb", 1), ("add", "c", None, 2)], "op string, key string, value string, seq int")
    assert rows(ontology.apply_review(items, edits, "name"), "name") == [("bb",), ("c",)]


def test_reader_views(spark):
    cards = spark.createDataFrame([(i, "b", i) for i in range(4)], "id int, book string, updated_at int")
    assert [r[3] for r in rows(views.expanded_cards(cards, "book"), "id")] == [False, False, True, True]
    moves = spark.createDataFrame([("u", "p1.s2"), ("u", "p1.s10"), ("u", "p1.s9")], "user string, sid string")
    assert rows(views.advanced_cursor(moves, "user")) == [("u", "p1.s10")]


def test_archives(spark, tmp_path):
    def book(path, bodies, spine):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
            items = "".join(f'<item id="{k}" href="{k}.xhtml"/>' for k in bodies)
            refs = "".join(f'<itemref idref="{k}"/>' for k in spine)
            z.writestr("o/p.opf", f'<p xmlns="u"><manifest>{items}</manifest><spine>{refs}</spine></p>')
            for k, body in bodies.items():
                z.writestr(f"o/{k}.xhtml", body)

    text = "<p>" + "many words make a chapter of some length here " * 3 + "</p>"
    book(tmp_path / "a.epub", {"x": text + "<p>X</p>", "y": text + "<p>Y</p>", "cover": "<p>hi</p>"}, ["cover", "y", "x"])
    book(tmp_path / "bomb.epub", {"x": "0" * 5_000_000}, ["x"])
    (tmp_path / "bad.epub").write_bytes(io.BytesIO(b"no zip").getvalue())
    docs = archive.read_epubs(spark, str(tmp_path / "*.epub"))
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in docs.filter("error is not null").collect()}
    assert "ratio" in errors["bomb.epub"] and "BadZipFile" in errors["bad.epub"]
    chapters = archive.with_offsets(archive.chapters_of(docs))
    out = rows(chapters.select("chapter", F.substring("text", -1, 1), "start_char"), "chapter")
    assert [r[:2] for r in out] == [(1, "Y"), (2, "X")] and out[0][2] == len("=== CHAPTER 1 ===\n\n")


def test_node_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "k1.json").write_text('{"characters": [{"name": "Bob", "first_chapter": 1}], "relationships": [{"source_name": "Bob", "target_name": "Tim"}]}')
    (tmp_path / "f1.json").write_text('[{"type": "Relationship", "source": {"name": "Ann"}, "target": {"name": "Eve"}}, {"name": "odd"}]')
    (tmp_path / "f2.json").write_text("not json")
    nodes = tables.read_nodes(spark, str(tmp_path / "k*.json"), str(tmp_path / "f*.json"))
    out = {tuple(r) for r in nodes.select("type", "name", "source_name", "target_name").collect()}
    assert out == {("Character", "Bob", None, None), ("Relationship", None, "Bob", "Tim"), ("Relationship", None, "Ann", "Eve"), ("Entity", "odd", None, None)}


def test_token_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('token_ID_within_document\tword\tCOREF\tbyte_onset\n0\t"Hi\t-1\t0\n1\tBob\t7\t4\n\n2\tx\n')
    out = tables.tokens(tables.read_tsv(spark, str(tmp_path / "t.tsv"))).select("token_id", "text", "coref_id", "start_char")
    assert rows(out, "token_id") == [(0, '"Hi', None, 0), (1, "Bob", 7, 4), (2, "x", None, -1)]
