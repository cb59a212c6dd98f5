from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import unicode as U
from lectern.functions.identity import event_id, named_node_id


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], kinds).select(f(*map(F.col, names)).alias("x")).first()["x"]


def test_cleaning_passes(spark):
    text = "\n".join(
        ["“A motto”", "42", "Chapter 1 . 5", "Chapter 2 . 9", "Keep this­  ", "All rights reserved.", "", "",
         "Chapter 3 . 7", "next", "* * *", "", "", "", "last 12"]
    )
    assert one(spark, T.clean, text) == "“A motto”\nKeep this\nChapter 3 . 7\nnext\n***\n\nlast 12\n"
    assert one(spark, T.clean, "") == "\n"
    assert one(spark, T.clean, "7") == "\n"
    assert one(spark, T.clean, None) is None


def test_cleaning_counts(spark):
    text = "\n".join(["7", "Chapter 1 . 5", "Chapter 2 . 9", "a\u00a0b\u00adc &amp; &lt;", "Published by X", "-----", "* * *", "“q”", "12"])
    counts = one(spark, lambda c: T.cleaning_counts(c, ascii_marks=True), text).asDict()
    assert counts == {"entities": 2, "page_numbers": 2, "copyright_lines": 1, "toc_lines": 2, "quotes": 2, "nbsp": 1, "invisibles": 1, "scene_breaks": 2}
    assert one(spark, U.clean_document, "e\u0301 &amp; x\n12\n") == "\u00e9 & x\n"


def test_epigraph_survives_line_passes(spark):
    assert one(spark, T.clean, "— Anonymous\n1\nbody") == "— Anonymous\nbody\n"


def test_only_runs_of_contents_lines_go(spark):
    assert one(spark, T.drop_toc_runs, "Chapter I 3\nx") == "Chapter I 3\nx"
    assert one(spark, T.drop_toc_runs, "a\nChapter I 3\nChapter II 9\nChapter III 12") == "a\n"
    long = "Chapter 1 2\n" * 20_000
    assert one(spark, T.drop_toc_runs, long + "end") == "end"


def test_words_and_sentences(spark):
    assert one(spark, T.word_count, "a b c  d") == 4
    assert one(spark, T.word_count, "") == 0
    assert one(spark, T.sentences, 'He said "No." She left! (Then) ok') == ['He said "No."'[:-1], "She left!", "(Then) ok"]
    assert one(spark, T.keywords, "Who is Bob's dog, the Bob's DOG?") == ["who", "bob's", "dog", "the", "bob's", "dog"]


def test_quote_match_tiers(spark):
    assert one(spark, T.quote_matches, "a  b\nC", "a b c")
    assert not one(spark, T.quote_matches, "abc", "")
    assert one(spark, T.quote_matches, None, "x") is False


def test_titles_and_names(spark):
    assert one(spark, T.chapter_title, "\n  The End of It\nmore", 3) == "The End of It"
    assert one(spark, T.chapter_title, "It was over.\nmore", 3) == "Chapter 3"
    assert one(spark, T.title_of_id, "a_tale_0123abcd") == "A Tale"
    assert one(spark, T.filename_stem, "My Book--1!") == "my_book_1"
    assert one(spark, T.safe_int, " 12 ") == 12 and one(spark, T.safe_int, "x") == -1


def test_sentence_keys_compare_in_order(spark):
    key = lambda a, b: T.sentence_key(a) < T.sentence_key(b)
    assert one(spark, key, "p2.s9", "p2.s10") and one(spark, key, "odd", "p1.s1")


def test_unicode_functions(spark):
    assert one(spark, U.nfc, "é") == "é"
    assert one(spark, U.decode_entities, "a &amp; b &#8217;") == "a & b ’"
    slugs = {"Étude - Nº 1!": "etude_no_1", "_x_": "x", "A Tale (x) -.epub": "a_tale_x", "dir/Two  Words.final.epub": "two_wordsfinal", ".hidden": "hidden"}
    assert {k: one(spark, U.slugify, k) for k in slugs} == slugs
    forms = {" O'Brien.": "o'brien", "Jean-Luc Né": "jean-luc ne", '"Bob"': "bob"}
    assert {k: one(spark, U.wikidata_form, k) for k in forms} == forms
    assert one(spark, U.wikidata_aliases, "Jean-Luc O'Brien, Jr") == ["jean-luc o'brien, jr", "jean", "brien,"]
    page = "<p>One<br>two<script>x</p>y</script></p><div>three &amp; four</div>"
    assert one(spark, U.html_to_text, page) == "One\ntwo\n\nthree & four"


def test_ids_equal_the_library(spark):
    import uuid

    for name in ("Scrooge", "Éa \U0001f600", ""):
        assert one(spark, lambda c: named_node_id("Character", c), name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"character:{name}"))
    assert one(spark, event_id, 3, "x" * 99) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "event:3:" + "x" * 60))


def test_boilerplate_and_headings(spark):
    text = "Licence\n*** start of the book ***\nBody one\nBody two\n*** END of it"
    assert one(spark, lambda c: T.trim_boilerplate(c, "*** START", "*** end"), text) == "Body one\nBody two\n"
    assert one(spark, lambda c: T.trim_boilerplate(c, "*** START", "*** end"), "plain") == "plain"
    parts = one(spark, T.split_at_headings, "intro\nSTAVE ONE " + "a" * 300 + "\n stave two " + "b" * 300)
    assert [p.strip()[:9] for p in parts] == ["STAVE ONE", "stave two"]
    assert one(spark, T.split_at_headings, "no heading") == ["no heading"]
    assert one(spark, T.mood, "ab") == (97 + 98) % 6


def test_runs_of_bounded_size():
    """Texts and lists go through Python in runs of about so many bytes and items, in order, nulls kept."""
    import pyarrow as pa

    from lectern.functions import arrow

    texts = pa.array(["a" * 30, None, "", "bc", "d" * 5] * 3)
    assert arrow.mapped(texts, str.upper, 16).to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert arrow.mapped(texts.slice(0, 0), str.upper).to_pylist() == []
    batch = pa.record_batch([pa.array([["x"] * n for n in (3, 0, 9, 2, 2, 1)])], ["terms"])
    cut = list(arrow.list_runs(iter([batch.slice(1), batch.slice(0, 1)]), "terms", 4))
    assert [[len(x) for x in b.column("terms").to_pylist()] for b in cut] == [[0], [9], [2, 2], [1], [3]]
