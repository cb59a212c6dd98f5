"""The class model: counts and base scores by brute force, exchange gains by recounting, scores by a plain model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import class_model, queries
from lectern.llm.scratch import BATCH_ROWS, Scratch
from tests.llm.test_operators import SF, empty, odd  # noqa: F401


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def check_base(rows, docs):
    """Counts and base scores of every row."""
    counts = Counter(w for i, t in docs if not held(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        own = words_of(t)
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in rows)


def test_op11_query_against_brute_force(spark):
    rows = queries.op11_class_model(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_base(rows, docs)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > 0.9 * sum(r.base_score for r in unseen)


def test_scores_by_a_plain_model(spark, monkeypatch):
    """Given the classes, each token's probability by dictionaries; and however documents are sliced, the same scores."""
    monkeypatch.setattr(class_model, "FREQUENT", 0.01)
    monkeypatch.setattr(class_model, "CLASSES", 6)
    kept = {}
    plain = class_model.exchange
    monkeypatch.setattr(class_model, "exchange", lambda c, s, e: kept.setdefault("classes", plain(c, s, e, 6, 4)))
    rng = np.random.default_rng(2)
    subjects, verbs, things = ["ann", "bob", "cid"], ["sees", "hears", "Likes"], ["the cat", "a dog", "some tea"]
    docs = []
    for i in range(300):
        text = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)}" for _ in range(rng.integers(0, 9)))
        docs.append((i, text + (f" rare{i}" if i % 3 else "")))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = class_model.class_scores(table).collect()
    check_base(rows, docs)
    counts = Counter(w for i, t in docs if not held(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    least = max(class_model.LEAST, math.ceil(0.01 * n))
    frequent = sorted((w for w in counts if counts[w] >= least or not w), key=lambda w: (-counts[w], w.encode()))
    unit = lambda w: frequent.index(w) if w in frequent else len(frequent) + zlib.crc32(w.encode()[-3:]) % class_model.GROUPS
    classes = kept["classes"][0]
    of = lambda w: int(classes[unit(w)])
    pairs, sizes, once = Counter(), Counter(), Counter()
    for i, t in docs:
        if not held(i):
            own = words_of(t)
            pairs.update((of(x), of(y)) for x, y in zip([""] + own, own, strict=False))
    for w, c in counts.items():
        sizes[unit(w)] += c
        once[unit(w)] += c == 1 and w not in frequent
    lefts, rights, by_class = Counter(), Counter(), defaultdict(int)
    for (x, y), c in pairs.items():
        lefts[x] += c
        rights[y] += c
    for u, c in sizes.items():
        by_class[int(classes[u])] += c

    def chance(w, before):
        c, d, u = of(before), of(w), unit(w)
        distinct = max(1, sum(1 for x, _ in pairs if x == c))
        move = (pairs[c, d] + distinct * (rights[d] + 1) / (n + 6)) / (lefts[c] + distinct)
        inside = 1 if w in frequent else (counts[w] or once[u]) / max(1, sizes[u] + once[u])
        base = (counts[w] + 1) / (n + v + 1)
        return 0.95 * move * sizes[u] / max(1, by_class[d]) * inside + 0.05 * base

    want = {i: math.fsum(math.log10(chance(w, b)) for b, w in zip([""] + words_of(t), words_of(t), strict=False)) for i, t in docs}
    assert all(abs(want[r.doc_id] - r.score) < 1e-6 for r in rows)
    monkeypatch.setattr(class_model, "SLICE_BYTES", 40)
    kept.clear()
    again = {r.doc_id: r.score for r in class_model.class_scores(table).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    # Verbs follow names and name no things: the exchange tells them apart.
    apart = [{of(w) for w in words} for words in (["ann", "bob", "cid"], ["sees", "hears", "likes"])]
    assert not apart[0] & apart[1]


def test_gains_by_recounting():
    rng = np.random.default_rng(7)
    units, k = 12, 4
    pairs = rng.integers(0, 6, (units, units)) * (rng.random((units, units)) < 0.6)
    classes = rng.integers(0, k, units)

    def table(own):
        out = np.zeros((k, k))
        np.add.at(out, (own[:, None].repeat(units, 1), own[None, :].repeat(units, 0)), pairs)
        return out

    left = np.array([[pairs[classes == c, u].sum() for c in range(k)] for u in range(units)], float)
    right = np.array([[pairs[u, classes == c].sum() for c in range(k)] for u in range(units)], float)
    for u in range(units):
        own, itself = classes[u], float(pairs[u, u])
        before, after, base = left[u].copy(), right[u].copy(), table(classes)
        before[own] -= itself
        after[own] -= itself
        class_model._put(base, own, -before, -after, -itself)
        gain = class_model.gains(base, before, after, itself)
        lk = [class_model.likelihood(table(np.where(np.arange(units) == u, d, classes))) for d in range(k)]
        assert np.allclose(gain - gain[own], np.array(lk) - lk[own])


@pytest.mark.parametrize("size", [3, 10, 1000])
def test_pieces_cut_at_blanks(size):
    for text in (b"", b"a", b"   ", b"one two  three\nfour", b"x" * 50 + b" y", b" a" * 20):
        parts = list(class_model.pieces(text, size))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_class_model_edges(spark, odd, empty, monkeypatch):  # noqa: F811
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check_base(class_model.class_scores(odd).collect(), docs)
    monkeypatch.setattr(class_model, "SLICE_BYTES", 1000)
    check_base(class_model.class_scores(odd).collect(), docs)
    assert class_model.class_scores(empty).count() == 0
    unlearned = odd.filter(F.col("doc_id").isin([i for i in range(12) if held(i)]))
    assert {r.train_tokens for r in class_model.class_scores(unlearned).collect()} <= {0}


def test_save_leaves_no_shuffle_files(spark):
    """A written table's shuffle files go with the write, not when the driver collects its garbage."""
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    setting = lambda: spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    before, was = shuffles(), setting()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    assert Scratch(spark, "test").save(rows).count() == 7
    assert shuffles() <= before + 1 and setting() == was  # the count's own


def test_packed_entries(spark):
    """A word's number, unit and count come back from one long, at the ends of their ranges."""
    local, group = class_model.SLICE_TOKENS - 1, class_model.GROUPS - 1
    rows = spark.createDataFrame([(local, group, 2**23 - 1, None), (0, 0, 0, None), (5, 3, 1 << 40, 99_999)], "local int, group int, seen long, unit int")
    got = [r[0] for r in rows.select(class_model._packed(100_000)).collect()]
    bits, size = class_model.UNIT_BITS, class_model.SLICE_TOKENS
    found = [(x % size, x // size % (1 << bits), x // size >> bits) for x in got]
    assert found == [(local, 100_000 + group, 2**23 - 1), (0, 100_000, 0), (5, 99_999, 0)]


def test_contexts_in_rows_of_bounded_size(spark, monkeypatch):
    """However many contexts a part has, a row holds whole units and about ``BLOCK_ITEMS`` contexts; none is lost."""
    rng = np.random.default_rng(5)
    unit = np.sort(rng.integers(0, 40, 5000) ** 2 // 40)
    part, other, n = unit * 0 + 3, rng.integers(0, 80, 5000), rng.integers(1, 1 << 40, 5000)
    table = pa.table({"part": pa.array(part, pa.int32()), "unit": pa.array(unit, pa.int32()), "other": pa.array(other, pa.int32()), "n": n})
    rows = [b for b in class_model._blocks(300)(iter(table.to_batches(max_chunksize=70)))]
    largest, found, seen = np.bincount(unit).max(), [], []
    for b in rows:
        units, lengths, others, counts = (np.frombuffer(b.column(c)[0].as_py(), kind) for c, kind in class_model._BLOCK.items())
        assert b.column("part").to_pylist() == [3] and len(others) <= 300 + 70 + largest
        seen += units.tolist()
        found += zip(np.repeat(units, lengths).tolist(), others.tolist(), counts.tolist(), strict=True)
    assert len(rows) > 5 and seen == sorted(set(unit.tolist()))
    assert found == list(zip(unit.tolist(), other.tolist(), n.tolist(), strict=True))

    monkeypatch.setattr(class_model, "BLOCK_ITEMS", 50)
    kept, plain = {}, class_model.exchange
    size = "spark.sql.parquet.columnarReaderBatchSize"

    def exchange(contexts, sizes, end):
        kept["rows"], kept["read"] = [len(r.others) // 4 for r in contexts.collect()], spark.conf.get(size)
        return plain(contexts, sizes, end)

    monkeypatch.setattr(class_model, "exchange", exchange)
    before = spark.conf.get(size)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 40))) for i in range(200)]
    check_base(class_model.class_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert sum(kept["rows"]) > 4000 and max(kept["rows"]) < 50 + BATCH_ROWS + 2 * 51  # a batch, and a unit's own
    assert kept["read"] == str(class_model.BLOCKS_READ) and spark.conf.get(size) == before


def test_bigrams_of_slices_sum_up(monkeypatch):
    """Counts beside their units in one long, at the ends of their ranges, in batches of bounded rows."""
    monkeypatch.setattr(class_model, "OUT_ROWS", 2)
    units = 1 << class_model.UNIT_BITS
    words = class_model._Slice()
    words.words, words.parts = [b"a", b"b", b"a", b"b", b""], [(0, b"", 5, False, 0)]
    batch = class_model._batch(words.row() | {"units": [0, units - 1, 5]})
    out = list(class_model._pairs(units)(iter([batch, batch])))
    assert max(b.num_rows for b in out) <= 2
    found = dict(zip(*(pa.Table.from_batches(out).column(c).to_pylist() for c in ("pair", "n")), strict=True))
    a, b = units - 1, 5
    assert found == {a: 2, a * units + b: 4, b * units + a: 2, b * units: 2}
    assert (units * units - 1) << class_model.COUNT_BITS | class_model.SLICE_TOKENS < 1 << 63


def test_long_rows_are_saved_in_small_groups(spark):
    """A reader holds a row group's long rows at once, so these are few."""
    saved = Scratch(spark, "test").save(spark.range(40).coalesce(1).selectExpr("id", "repeat(uuid(), 6000) AS text"), 1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in saved.inputFiles()]
    assert saved.count() == 40 and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 10
