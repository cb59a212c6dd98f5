"""Reading cursors from late, repeated and restarted input; RDF/XML read back by a parser; palettes beyond 16 bits."""

import os
import random
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import tables
from lectern.streaming import cursors

MOVES = "reader string, book_id string, chapter int, sid string, ts timestamp"
BEGIN = datetime(2024, 1, 1)


def settled(moves):
    """Cursors by hand: each reader's moves in the order of their times."""
    out = {}
    for reader, book, chapter, sid, ts in sorted(set(moves), key=lambda m: (m[4], m[2], cursors._place(m[3]), m[3])):
        at = int((ts - datetime(1970, 1, 1)).total_seconds() * 1e6)
        out[reader, book] = cursors.advanced(out.get((reader, book)), (at, chapter, sid))
    return {k: v[:2] for k, v in out.items()}


def run(spark, folder, table, checkpoint):
    stream = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = cursors.reading_cursors(stream, late="2 hours").writeStream.outputMode("update").foreachBatch(cursors.upserts(str(table)))
    q.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return {(r.reader, r.book_id): (r.chapter, r.sid) for r in cursors.cursor_table(spark, str(table)).collect()}


def test_cursors_from_late_repeated_and_restarted_input(spark, tmp_path):
    rng = random.Random(8)
    moves = []
    for k in range(240):
        ts = BEGIN + timedelta(minutes=10 * k, seconds=rng.randint(0, 59))
        moves.append((f"r{rng.randint(0, 3)}", rng.choice("ab"), rng.randint(1, 2) + k // 120, f"p{rng.randint(0, 3)}.s{rng.randint(0, 12)}", ts))
    files = [moves[a : a + 60] for a in range(0, 240, 60)]
    for a, b in zip(files[:-1], files[1:], strict=True):  # some come an hour late, in the next file, and some come twice
        moved = [m for m in a[50:] if rng.random() < 0.5]
        a[:] = [m for m in a if m not in moved]
        b += moved + rng.sample(a[-8:], 3)
        rng.shuffle(b)
    late = ("r0", "a", 9, "p9.s9", BEGIN - timedelta(days=2))  # far too late: dropped
    end = ("end", "a", 1, "p0.s0", BEGIN + timedelta(days=9))  # lets the watermark pass all others
    for n, rows in enumerate([*files, [late, end], [("end", "a", 1, "p0.s1", end[4] + timedelta(days=1))]]):
        spark.createDataFrame(rows, MOVES).coalesce(1).write.parquet(str(tmp_path / "all" / f"f={n}"))

    def flat(name, upto):
        (tmp_path / name).mkdir(exist_ok=True)
        for n in range(upto):
            file = tmp_path / name / f"{n}.parquet"
            if not file.exists():
                file.write_bytes(next((tmp_path / "all" / f"f={n}").glob("*.parquet")).read_bytes())
                os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files come in the order of their times

    want = settled(moves) | {("end", "a"): (1, "p0.s0")}
    flat("in", 2)
    run(spark, tmp_path / "in", tmp_path / "table", tmp_path / "cp")
    flat("in", 6)
    got = run(spark, tmp_path / "in", tmp_path / "table", tmp_path / "cp")  # goes on from its checkpoint
    assert {k: v for k, v in got.items() if k[0] != "end"} == {k: v for k, v in want.items() if k[0] != "end"}
    again = run(spark, tmp_path / "in", tmp_path / "table", tmp_path / "new")  # all input once more
    assert again == got


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    take = cursors.upserts(str(tmp_path / "t"))
    at = lambda k: BEGIN + timedelta(hours=k)
    one = spark.createDataFrame([("r", "b", 1, "p1.s2", at(1)), ("q", "b", 1, "p1.s1", at(1))], cursors.CURSOR)
    two = spark.createDataFrame([("r", "b", 1, "p1.s1", at(2)), ("q", "b", 2, "p0.s1", at(2))], cursors.CURSOR)
    read = lambda: {tuple(r)[:4] for r in cursors.cursor_table(spark, str(tmp_path / "t")).collect()}
    assert read() == set()
    for number, batch in ((0, one), (0, one), (1, two), (1, two)):
        take(batch, number)
    assert read() == {("r", "b", 1, "p1.s1"), ("q", "b", 2, "p0.s1")}
    take(one, 2)  # older cursors, in a batch of their own
    assert read() == {("r", "b", 1, "p1.s1"), ("q", "b", 2, "p0.s1")}


def test_rdf_xml_is_read_back(spark, tmp_path):
    rows = [
        ("x", "Bob", "type", "Character"), ("x", "Bob", "label", 'Bob & <"Tim"> \r\n\x01 é𝄞'), ("x", "Bob", "label", "second"), ("x", "Bob", "type", "Character"),
        ("x", "Character", "subClassOf", "Entity"), ("y", "Ann Lee", "4 knows", "Eve"), ("y", None, "type", "Z"),
    ]
    triples = spark.createDataFrame(rows, "book_id string, s string, p string, o string")
    tables.write_rdf_xml(triples, str(tmp_path / "rdf"))
    found = {}
    for book in ("x", "y"):
        (file,) = Path(tmp_path / "rdf" / f"book_id={book}").glob("*.txt")
        root = ElementTree.fromstring(file.read_bytes())
        for d in root:
            about = next(v for k, v in d.attrib.items() if k.endswith("about"))
            for p in d:
                value = p.text if not p.attrib else next(iter(p.attrib.values()))
                found.setdefault(book, []).append((about.rpartition(":")[2], p.tag.rpartition("}")[2], value.removeprefix("urn:lectern:")))
    assert sorted(found["x"]) == sorted(
        [("Bob", "type", "Character"), ("Bob", "label", 'Bob & <"Tim"> \r\n� é𝄞'), ("Bob", "label", "second"), ("Character", "subClassOf", "Entity")]
    )
    assert found["y"] == [("Ann_Lee", "_4_knows", "Eve")]


def test_palettes_count_utf16_units(spark):
    ids = ["", "abc", "é", "𝄞", "a𝄞\U0001f600b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "id string").select(T.mood(F.col("id"), 997)).collect()]
    units = lambda s: [int.from_bytes(s.encode("utf-16-be")[k : k + 2]) for k in range(0, 2 * len(s.encode("utf-16-be")) // 2, 2)]
    assert got == [sum(units(x)) % 997 for x in ids]
