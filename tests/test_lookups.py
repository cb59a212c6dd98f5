"""Lookups that avoid scans or pairs: answers of many readers, the index of characters, text hits, vector search, topics, archives."""

import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import asof, gram_index, graph, ontology, retrieve
from lectern.sources import archive

NODES = "book_id string, type string, name string, description string, chapter int, source_chunk_ordinal long, seq long"
EDGES = "book_id string, source string, relation string, target string, description string, chapter int, source_chunk_ordinal long, seq long"


def one_by_one(nodes, edges, index, asked, use_triplets, seeds, cap, degree):
    """Each question by itself, in plain Python."""
    out = []
    spans = {(b, c): last for b, c, _, last in index}
    for ask, book, cursor, question in asked:
        before = [(c, last) for (b, c), last in spans.items() if b == book and c <= cursor]
        if not before:
            continue
        at = spans.get((book, cursor), max(last for _, last in before))
        place = lambda r: r[-2] if r[-2] is not None else spans.get((book, r[-3]))

        def latest(rows, key):
            best = {}
            for r in rows:
                if r[0] == book and place(r) is not None and place(r) <= at:
                    k = tuple(r[i] for i in key)
                    if k not in best or (-place(r), r[-1]) < (-place(best[k]), best[k][-1]):
                        best[k] = r
            return list(best.values())

        seen = latest([n for n in nodes if n[1] != "Relationship"], (1, 2))
        names = {n[2] for n in seen if n[2]}
        linked = [e for e in latest(edges, (1, 2, 3)) if e[1] in names and e[3] in names]
        words = [w for w in question.lower().replace("?", "").split() if len(w) > 2]
        score = lambda *parts: sum(w in " ".join(p or "" for p in parts).lower() for w in words)
        text = lambda n: " — ".join(x for x in n[2:4] if x)
        own = [(-score(*n[2:4]), 0, n[-1], n[2], text(n)) for n in seen]
        if use_triplets:
            arrow = lambda e: " → ".join(e[1:4]) + (f" — {e[4]}" if e[4] else "")
            own += [(-score(*e[1:5]), 1, e[-1], None, arrow(e)) for e in linked]
        own = sorted(x for x in own if not words or x[0] < 0)
        rank = {}
        for r, x in enumerate(own[:seeds]):
            if x[3] is not None:
                rank.setdefault(x[3], r)
        near = {}
        for name, r in rank.items():
            ends = [(e[-1], b) for e in linked for a, b in ((e[1], e[3]), (e[3], e[1])) if a == name and a != b]
            if len(ends) <= degree:
                for s, b in ends:
                    if b not in rank:
                        near[b] = min(near.get(b, (r, s)), (r, s))
        room = max(0, cap - len(rank))
        grown = sorted(near, key=lambda b: (*near[b], b))[:room]
        listed = {x[3] for x in own}
        added = sorted((n[-1], n[2], text(n)) for n in seen if n[2] in grown and n[2] not in listed)
        items = [(x[3], x[4], -x[0]) for x in own] + [(n, c, 0) for _, n, c in added]
        out += [(ask, k, *x) for k, x in enumerate(items[:cap])]
    return out


@pytest.mark.parametrize("use_triplets, broadcast", [(False, 50_000), (True, 50_000), (True, 0)])
def test_answers_of_many_readers(spark, monkeypatch, use_triplets, broadcast):
    monkeypatch.setattr(retrieve, "BROADCAST_QUESTIONS", broadcast)
    rng = random.Random(3)
    people, things = [f"ann{i}" for i in range(9)] + ["", "Bob"], ["a clerk", "the old ghost", None, "goose and pudding"]
    books = ["x", "y", "z"]
    index = [(b, c, 10 * c, 10 * c + 7) for b in books[:2] for c in range(1, 6) if (b, c) != ("y", 3)]
    nodes, edges = [], []
    for s in range(160):
        own = rng.choice([None, None, rng.randint(5, 60)])
        kind = rng.choice(["Character", "Location", "Relationship"])
        nodes.append((rng.choice(books), kind, rng.choice(people), rng.choice(things), rng.randint(0, 6), own, s))
    for s in range(120):
        ends = rng.choice(people), rng.choice(["knows", "fears"]), rng.choice(people)
        edges.append((rng.choice(books), *ends, rng.choice(["", "since long"]), rng.randint(1, 5), rng.choice([None, rng.randint(5, 60)]), s))
    questions = ["Who is Bob?", "old ghost ghost", "ann1 ann2 fears", "??", "clerk", "nothing here"]
    asked = [(f"{b}{c}{k}", b, c, q) for b in (*books, "none") for c in (0, 1, 3, 9) for k, q in enumerate(questions)]
    frames = (spark.createDataFrame(r, s) for r, s in ((nodes, NODES), (edges, EDGES), (index, "book_id string, chapter int, first_ordinal long, last_ordinal long")))
    got = retrieve.answers(*frames, spark.createDataFrame(asked, "ask_id string, book_id string, cursor int, question string"), use_triplets, 3, 7, 4)
    rows = [tuple(r) for r in got.select("ask_id", "position", "name", "content", "score").collect()]
    want = one_by_one(nodes, edges, index, asked, use_triplets, 3, 7, 4)
    assert sorted(rows, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2]) and len(want) > 100


def test_answers_join_by_keys(spark, tmp_path):
    """No nested loops, and the edges are read once."""
    for name, kinds in (("nodes", NODES), ("edges", EDGES), ("index", "book_id string, chapter int, first_ordinal long, last_ordinal long"), ("asked", "ask_id string, book_id string, cursor int, question string")):
        spark.createDataFrame([], kinds).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / n)) for n in ("nodes", "edges", "index", "asked")]
    plan = retrieve.answers(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count(f"{tmp_path}/edges") == 1


def test_versions(spark):
    nodes = spark.createDataFrame([("a", 3, 1, "x"), ("a", 3, 0, "y"), ("a", 5, 2, "z"), ("b", None, 3, "n")], "k string, v int, seq int, d string")
    out = asof.versions(nodes, ["k"], "v", "seq").select("k", "v", "d", "_until").orderBy("v").collect()
    assert [tuple(r) for r in out] == [("a", 3, "y", 5), ("a", 5, "z", None)]


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abAB é𝄞", k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "aaaaaa", "ab", "abababab"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    gram_index.write_index(nodes, str(tmp_path / "index"), "id", F.col("text"))
    words = sorted({"".join(rng.choices("abé", k=rng.randint(3, 9))) for _ in range(60)} | {"aaa", "aaaa", "abab", "zzz"})
    found = gram_index.occurrences(spark, str(tmp_path / "index"), spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(w, i) for w in words for i, t in enumerate(texts) if w in (t or "").lower()}
    assert {tuple(r) for r in found.collect()} == want and len(found.collect()) == len(want) > 100
    asked = spark.createDataFrame([(1, "aba AB aba? Abab"), (2, "??"), (3, None)], "ask_id int, question string")
    got = {tuple(r) for r in gram_index.keyword_ranks(spark, str(tmp_path / "index"), asked).collect()}
    score = lambda t: 2 * ("aba" in t) + ("abab" in t)
    assert got == {(1, i, score((t or "").lower())) for i, t in enumerate(texts) if score((t or "").lower())}
    with pytest.raises(Exception, match="3 characters"):
        gram_index.occurrences(spark, str(tmp_path / "index"), spark.createDataFrame([("ab",)], "word string")).collect()


def test_index_reads_matching_postings_only(spark, tmp_path):
    nodes = spark.range(400).select("id", F.concat(F.lit("node "), F.md5(F.col("id").cast("string"))).alias("text"))
    gram_index.write_index(nodes, str(tmp_path / "index"), "id", F.col("text"))
    found = gram_index.occurrences(spark, str(tmp_path / "index"), spark.createDataFrame([("ode",)], "word string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "gram" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", scan) and re.search(r"PushedFilters: \[[^\]]*\(gram,", scan), scan
    assert found.count() == 400


@pytest.mark.parametrize("blocks, size", [(8, 16 << 20), (8, 4000), (0, 4000)])
def test_text_hits_equal_scan(spark, monkeypatch, blocks, size):
    monkeypatch.setattr(graph, "PATTERN_BLOCKS", blocks)
    monkeypatch.setattr(graph, "PATTERN_BYTES", size)
    rng = random.Random(9)
    made = lambda k: "".join(rng.choices("ab é", k=k))
    chunks = [(rng.choice("xy"), o, made(rng.randint(0, 60))) for o in range(80)] + [("x", 90, None), (None, 91, "ab")]
    nodes = [(i, rng.choice("xyz"), made(rng.randint(0, 6))) for i in range(200)] + [(300, "x", None)]
    got = graph.text_hits(spark.createDataFrame(nodes, "id long, book_id string, text string"), spark.createDataFrame(chunks, "book_id string, ordinal int, text string"))
    want = set()
    for i, book, text in nodes:
        at = [o for b, o, t in chunks if b == book and text and t and text in t]
        if at:
            want.add((book, i, min(at)))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("size", [16 << 20, 300])
def test_nearest_each_equals_scan(spark, monkeypatch, size):
    monkeypatch.setattr(retrieve, "QUERY_BYTES", size)
    monkeypatch.setattr(retrieve, "PRODUCTS", 200)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(400, [0.0] * 4), (401, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.filter("vec_id % 9 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.vec_id): r.similarity for r in retrieve.nearest_each(vectors, asked, 6).collect()}
    assert not retrieve.nearest_each(vectors, asked.limit(0), 6).count() and not retrieve.nearest_each(vectors.limit(0), asked, 6).count()
    pairs = vectors.crossJoin(asked.withColumnRenamed("embedding", "q")).withColumn("s", retrieve.cosine(F.col("embedding"), F.col("q")))
    by = {}
    for r in pairs.collect():
        by.setdefault(r.query_id, []).append((-r.s, r.vec_id))
    want = {(q, i): -s for q, own in by.items() for s, i in sorted(own)[:6]}
    assert got == want


def test_planted_topics_are_found(spark):
    rng = random.Random(5)
    subjects = [[f"{t}{k}" for k in range(25)] for t in ("ship", "stove", "piano")]
    docs, planted = [], {}
    for d in range(40):
        parts = []
        for p in range(5):
            topic = rng.randrange(3)
            parts.append(" ".join(rng.choices(subjects[topic], k=20)))
            planted[d, p] = topic
        docs.append((d, "\n\n".join(parts)))
    table = spark.createDataFrame(docs, "id long, text string")
    found = {(r.unit.id, r.unit._p): r.topic for r in ontology.found_topics(table, "id", "text", topics=3).collect()}
    assert len(found) == 200 and len(set(zip(found.values(), (planted[u] for u in found), strict=True))) == 3
    again = {(r.unit.id, r.unit._p): r.topic for r in ontology.found_topics(table, "id", "text", topics=3).collect()}
    assert again == found
    keys = ontology.topic_keywords(ontology.found_topics(table, "id", "text", topics=3), "topic", "text", 5).collect()
    assert len(keys) == 3 and all(len({w.rstrip("0123456789") for w in r.keywords}) == 1 for r in keys)
    assert ontology.found_topics(table.limit(1), "id", "text", topics=3).count() == 0


def test_broken_archives_are_rows(spark, tmp_path):
    """Corrupt, cut, encrypted and lying archives give a row each, and the good one its documents."""
    body = "<p>" + "many words make a chapter of some length here " * 3 + "</p>"

    def book(name, kind=zipfile.ZIP_DEFLATED, bodies=2, text=body):
        with zipfile.ZipFile(tmp_path / name, "w", kind) as z:
            z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfiles><rootfile full-path="p.opf"/></rootfiles></c>')
            names = [f"c{k}" for k in range(bodies)]
            items, refs = "".join(f'<item id="{k}" href="{k}.xhtml"/>' for k in names), "".join(f'<itemref idref="{k}"/>' for k in names)
            z.writestr("p.opf", f'<p xmlns="u"><manifest>{items}</manifest><spine>{refs}</spine></p>')
            for k in names:
                z.writestr(f"{k}.xhtml", text.replace("many", k))
        return tmp_path / name

    def patched(name, change):
        raw = bytearray((tmp_path / "good.epub").read_bytes())
        change(raw)
        (tmp_path / name).write_bytes(bytes(raw))

    book("good.epub")
    last = (tmp_path / "good.epub").read_bytes().rindex(b"c1.xhtml", 0, (tmp_path / "good.epub").read_bytes().index(b"PK\x01\x02"))

    def corrupt(raw):
        raw[last + 12 : last + 40] = b"\xff" * 28

    def encrypted(raw):
        at = raw.index(b"PK\x01\x02")
        while at >= 0:
            raw[at + 8] |= 1
            at = raw.find(b"PK\x01\x02", at + 4)

    def unknown(raw):
        at = raw.rindex(b"PK\x01\x02")
        raw[at + 10] = 77

    patched("corrupt.epub", corrupt)
    patched("cut.epub", lambda raw: raw.__delitem__(slice(len(raw) // 2, None)))
    patched("encrypted.epub", encrypted)
    patched("unknown.epub", unknown)
    book("lzma.epub", zipfile.ZIP_LZMA)
    docs = archive.read_epubs(spark, f"{tmp_path}/*.epub").collect()
    by = {}
    for r in docs:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.pos, r.error is None))
    assert sorted(by.pop("good.epub")) == [(0, True), (1, True)] == sorted(by.pop("lzma.epub"))
    assert by == {n: [(-1, False)] for n in ("corrupt.epub", "cut.epub", "encrypted.epub", "unknown.epub")}
    tight = archive.read_epubs(spark, f"{tmp_path}/good.epub", archive.Limits(total_bytes=200)).collect()
    assert [r.pos for r in tight] == [-1] and "more than" in tight[0].error


def test_nearest_rows_in_bounded_batches():
    """Results of many queries leave a task in batches of bounded rows, and are those of brute force."""
    import types

    import numpy as np
    import pyarrow as pa

    from lectern.operators import retrieve

    rng = np.random.default_rng(3)
    queries, vectors, k = rng.normal(size=(3000, 4)), rng.normal(size=(90, 4)), 40
    vectors[40:80] = vectors[:40]  # ties
    one = pa.record_batch([pa.array(np.arange(90)[::-1]), pa.array(vectors.tolist())], ["vec_id", "embedding"])
    out = list(retrieve._nearest_rows(types.SimpleNamespace(value=(np.arange(3000), queries)), k, "vec_id", "embedding")(iter([one.slice(0, 50), one.slice(50)])))
    assert max(b.num_rows for b in out) <= 1 << 16 and sum(b.num_rows for b in out) == 3000 * k
    got = np.concatenate([b.column("vec_id").to_numpy() for b in out]).reshape(3000, k)
    ids = np.arange(90)[::-1]
    for q in (0, 1, 1700, 2999):
        score = sum(queries[q, d] * vectors[:, d] for d in range(4)) / (np.linalg.norm(queries[q]) * retrieve._norms(vectors))
        assert list(got[q]) == [int(x) for x in ids[np.lexsort((ids, -score))[:k]]]
