"""Contract queries against SQL, brute force, or round trips; and each operator's edge cases."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    exact_dedup,
    license_scan,
    mixing,
    near_dedup,
    quality,
    queries,
    sentence_pieces,
    shingles,
    text_features,
    token_counts,
    token_shards,
    top_k,
    url_filter,
    vector_shards,
)
from lectern.llm.scratch import Scratch
from lectern.llm.wavelet import WaveletMatrix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if pd.isna(v):
        return None
    return float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def table(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, "a b  c\td", "en", "s1", 7), (2, "a b c d", "en", None, 7), (2, "a b c d", "en", None, 7), (None, "a b c d", None, "s2", None),
        (None, None, None, None, None), (5, None, "en", "s1", 0), (6, "", "en", "s1", 0), (7, " \n ", "en", "s1", 3),
        (8, LONG, "en", "s2", len(LONG)), (9, LONG + "tail", "en", "s2", 1), (10, "x" * 200_000, "de", "s3", 1),
        (11, "Grüße ▁ an 𝄞 \U0001f600 <|endoftext|> it's we'll  ok", "de", "s3", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("id", "row", "node", "bucket", "size", "place", "keep_id", "votes", "part", "shard", "line_no"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup_edges(spark, odd, empty):
    out = exact_dedup.exact_dedup(odd).toPandas()
    assert len(out) == odd.count() and exact_dedup.exact_dedup(empty).count() == 0
    same = out[out.text_sha256 == hashlib.sha256(b"a b c d").hexdigest()]
    assert set(same.keep_id) == {1} and set(same.group_size) == {4} and same.kept.sum() == 1
    none = out[out.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert set(none.keep_id) == {5} and len(none) == 3
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == out.kept.sum()
    twice = spark.createDataFrame([(3, "q", "en", "s", 1), (3, "q", "en", "s", 1), (3, "r", "en", "s", 1)], DOCS)
    assert sorted(r.text for r in exact_dedup.keep_first(twice).collect()) == ["q", "r"]


def test_grace_partitioning_recurses(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40} " + "x" * 50) for i in range(200)], "doc_id long, text string")
    small, whole = (exact_dedup.exact_dedup(docs, bucket_bytes=b).toPandas() for b in (100, 1 << 26))
    kept = exact_dedup.keep_first(docs, bucket_bytes=100).toPandas()
    assert sorted(kept.doc_id) == sorted(small[small.kept].doc_id)
    assert table(small) == table(whole) and small.kept.sum() == 40


def test_normalise_blanks():
    for t in ("", " ", "a", " a\t\n b ", "\x0b\x0ca b\x1c c\r", "ß\x85 x"):
        assert exact_dedup.normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def near_truth(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_against_brute_force(spark):
    """A group of copies at all distances, some just beyond the threshold, with a passage that unrelated texts share."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 9)):
            w[at] = f"e{i}_{at}"
        texts[i] = " ".join(w)
    for i in range(150, 210):
        texts[i] = " ".join(f"u{i}_{k}" for k in range(rng.integers(5, 80))) + " " + passage
    texts |= {300: "Few words", 301: "few words", 302: None, 303: "", 304: "few  other", 305: " ".join(base[:80]), 306: " ".join(base[:90])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    truth = near_truth(texts)
    assert len({c for _, c in truth.values()}) > 40
    assert out == {i: (n, c, i == c) for i, (n, c) in truth.items()}


def test_near_dedup_edges(odd, empty):
    out = near_dedup.near_dedup(odd).toPandas()
    assert len(out) == odd.count() and near_dedup.near_dedup(empty).count() == 0
    by = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[2].component_id == 1 and by.loc[9].component_id == 9  # one shingle, and two
    assert by.loc[8].n_shingles == 1 and by.loc[9].n_shingles == 2
    assert all(by.loc[i].n_shingles == 0 and by.loc[i].kept for i in (5, 6, 7))
    assert out[out.doc_id.isna()].kept.all() and near_dedup.keep_one(odd).columns == odd.columns


def test_mix_reaches_targets_and_repeats(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan_mix(docs).toPandas()
    assert (plan.taken <= 3 * plan["size"]).all()
    per = plan.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), largest=("size", "max")).reset_index()
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1).all()
    assert abs(per.target.sum() - plan["size"].sum()) < 1e-3
    mixed = mixing.mix(docs)
    rows = mixed.select("doc_id", "mix_shard", mixing.word_count(F.col("text")).alias("n")).toPandas()
    taken = rows.groupby("doc_id").n.sum()
    assert dict(taken) == {i: t for i, t in zip(plan.doc_id, plan.taken, strict=True) if i in taken.index}
    assert plan[~plan.doc_id.isin(taken.index)].taken.sum() == 0
    assert table(mixing.mix(docs).select("doc_id", "mix_shard", "mix_order").toPandas()) == table(mixed.select("doc_id", "mix_shard", "mix_order").toPandas())
    assert len(mixing.plan_mix(odd).toPandas()) == odd.count()
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert set(odd.columns) < set(mixing.mix(odd).columns)


def test_quotas_are_exact():
    draws = np.array([100, 7, 0, 33])
    quotas = mixing.split_quotas(draws, 5, np.random.default_rng(1))
    assert quotas.shape == (5, 4) and (quotas.sum(0) == draws).all() and np.ptp(quotas.sum(1)) <= 3


def test_one_tree_over_groups_of_sources(spark, monkeypatch):
    """Groups of sources are split jointly: every shard has its number of draws, every source its own, whatever the groups."""
    counts = spark.createDataFrame([(None if i == 7 else f"s{i}", 1 + i % 9) for i in range(60)], "source string, count long")
    total = sum(1 + i % 9 for i in range(60))
    shares = []
    for sources in (10_000, 7):
        monkeypatch.setattr(mixing, "TREE_SOURCES", sources)
        for seed in range(12):
            rows = mixing._quotas(counts, 5, seed).collect()
            quotas = np.diff(np.array([r.ends for r in rows]), axis=1, prepend=0)
            assert sorted(quotas.sum(1)) == sorted(1 + i % 9 for i in range(60)) and (quotas >= 0).all()
            assert abs(quotas.sum(0) - total / 5).max() <= 2
            shares.append(quotas[:30].sum(0)[0] / quotas[:30].sum())
    assert 0.1 < np.mean(shares) < 0.3


def test_plan_counts_the_draws_of_the_tree(spark, monkeypatch):
    """Draws of a shard whose quotas are lost are not taken, by the plan as by the mix."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, split = mixing.plan_mix(docs).toPandas(), mixing.split_quotas

    def without_last(draws, shards, rng, *totals):
        quotas = split(draws, shards, rng, *totals)
        return np.concatenate([quotas[:-1], 0 * quotas[-1:]]) if shards == mixing.SHARDS else quotas

    monkeypatch.setattr(mixing, "split_quotas", without_last)
    part = mixing.plan_mix(docs).toPandas()
    rows = mixing.mix(docs).select("doc_id", mixing.word_count(F.col("text")).alias("n")).toPandas()
    assert len(part) == len(whole) and 0 < part.taken.sum() < whole.taken.sum()
    taken = rows.groupby("doc_id").n.sum()
    assert dict(zip(part.doc_id, part.taken, strict=True)) == {i: taken.get(i, 0) for i in part.doc_id}


@pytest.mark.parametrize("words", [mixing.PIECE_WORDS, 500])
def test_mix_is_sharded_and_shuffled(spark, monkeypatch, words):
    """Each partition has rows of one shard in their random order, and the partitions follow each other."""
    monkeypatch.setattr(mixing, "PIECE_WORDS", words)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "mix_shard", "mix_order", F.spark_partition_id().alias("part")).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.part].append((r.mix_shard, r.mix_order))
    assert all(len({s for s, _ in p}) == 1 for p in parts.values())
    placed = [x for k in sorted(parts) for x in parts[k]]
    assert placed == sorted(placed) and len({s for s, _ in placed}) == mixing.SHARDS
    assert (len(parts) > mixing.SHARDS) == (words == 500)
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)


def test_whole_licenses_are_found(spark):
    """Wrapped texts with a body line that begins with 'copyright', with titles and holders; and statements of all kinds."""
    isc = next(t for t in license_scan.KNOWN["ISC"] if t.startswith("Permission to use"))
    wrapped = isc.replace("above copyright notice", "above\ncopyright notice")
    mit = next(t for t in license_scan.KNOWN["MIT"] if t.startswith("Permission is"))
    with open("/usr/share/common-licenses/Apache-2.0") as f:
        apache = f.read()
    bsd = license_scan.TEXTS["BSD-2-Clause"][0]
    found = {
        1: ("ISC", f"Copyright (c) 2020 A. Holder\n\n{wrapped}"), 2: ("MIT", f"MIT License\n\nCopyright (c) 2021 Somebody\n\n{mit}"),
        3: ("MIT", f"Copyright Somebody\n{mit}"), 4: ("Apache-2.0", apache), 5: ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        6: ("BSD-2-Clause", f"BSD 2-Clause License\n\n{bsd}"), 7: ("MIT", f"© Нолдер\n(c) Some One, 2019\nCopyright Нолдер\n{mit}"),
    }
    docs = spark.createDataFrame([(i, t) for i, (_, t) in found.items()], "doc_id long, text string")
    out = license_scan.scan_licenses(docs).filter("line_no = 0").collect()
    assert {r.doc_id: r.license for r in out} == {i: n for i, (n, _) in found.items()}


def test_licenses_are_found_at_all_widths(spark):
    """Known whole texts, wrapped anew at every width, with a title and a notice of the holder."""
    import textwrap

    docs, want = [], {}
    for name in ("MIT", "ISC", "0BSD"):
        text = next(t for t in license_scan.KNOWN[name] if t.startswith("Permission"))
        for width in range(50, 101):
            wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
            want[len(docs)] = name
            docs.append((len(docs), f"{license_scan._TITLES[name][0]}\n\nCopyright (c) 2020 A. Holder\n\n{wrapped}\n"))
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"):  # notices of holders keep their lines
        for text in license_scan.TEXTS[name][:1]:
            for width in (50, 61, 72, 80, 100):
                parts = [p if "All rights reserved." in p else textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in text.split("\n\n")]
                wrapped = "\n\n".join(parts)
                want[len(docs)] = name
                docs.append((len(docs), wrapped))
    out = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).filter("line_no = 0").collect()
    assert {r.doc_id: r.license for r in out} == want


def test_known_licenses_from_a_table(spark, monkeypatch):
    """A table of known texts, joined without a broadcast and without the look at first words."""
    monkeypatch.setattr(license_scan, "BROADCAST_KNOWN", 0)
    monkeypatch.setattr(license_scan, "MAX_OPENINGS", 0)
    known = spark.createDataFrame([("own", "You may use this programme."), ("zzz", "you may use this program")], "license string, text string")
    rows = [(1, "YOU MAY; use this Program!"), (1, "YOU MAY; use this Program!"), (None, "no\nyou may use this program"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = license_scan.scan_licenses(docs, known=known).collect()
    found = Counter((r.doc_id, r.line_no, r.license) for r in out)
    assert found == {(1, 0, "own"): 2, (1, 1, "own"): 2, (None, 2, "own"): 1}


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for ids in (rng.zipf(1.3, 5000) % 49408, np.zeros(700, int), np.array([5]), np.zeros(0, int), np.arange(1025)):
        ids = ids.astype(np.uint32)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert (m.tokens() == ids).all() and (m.access(np.arange(len(ids))) == ids).all()
        for token in {int(x) for x in ids[:20]} | {77_777}:
            assert (m.occurrences(token) == np.flatnonzero(ids == token)).all()
            a, b = len(ids) // 3, len(ids) - len(ids) // 5
            assert m.count(token, a, b) == (ids[a:b] == token).sum()


def test_wavelet_access_unpacks_few_frames():
    ids = (np.random.default_rng(4).zipf(1.2, 600_000) % 40_000).astype(np.uint32)
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    at = np.array([5, 399_999])
    assert (m.access(at) == ids[at]).all()
    unpacked = [sum(isinstance(f, tuple) for f in p.frames) for p in m.planes]
    assert max(unpacked) <= 2 < min(len(p.frames) for p in m.planes)


def test_words_built_to_collide(spark):
    """Two words whose first quick hashes are equal: texts that differ in them alone share no shingle."""
    x, y = "abcdefghijklmnop", "hpprurao1|?x9zy>"
    raw = np.frombuffer((x + y).encode(), np.uint8)
    quick = shingles.span_hashes(raw, np.array([0, 16]), np.array([16, 32]))
    assert quick[0, 0] == quick[0, 1]
    text = lambda w: " ".join(w if i % 5 == 2 else f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text(x)), (2, text(y)), (3, x), (4, y)], "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()}
    assert out == {(1, 56, 1), (2, 56, 2), (3, 1, 3), (4, 1, 4)}


def test_ranks_tell_colliding_halves_apart():
    both = np.array([[5, 5, 1, 5, 1], [7, 8, 2, 7, 2]], np.uint64)
    assert shingles.ranks(both).tolist() == [1, 2, 0, 1, 0] and shingles.ranks(both[:, :0]).tolist() == []
    outside, members = [(1, 1, both[:, :1])], [(2, 2, both[:, 1:2]), (3, 3, both[:, 3:4])]
    assert near_dedup._tile_links(outside, members, 75) == [(1, 3)]


def thue_morse():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_weak_hashes_confuse(spark):
    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x"), (4, f"{b} x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()} == {(i, i, True) for i in (1, 2, 3, 4)}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    own = token_shards.WordEncoder(WORD_BPE).encode_all([a.encode(), b.encode(), f"{b} {a}".encode()])
    assert [x.tolist() for x in own] == [t.encode(x, add_special_tokens=False).ids for x in (a, b, f"{b} {a}")]


def whole_texts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in docs], add_special_tokens=False)]


def test_units_whose_hashes_agree_are_told_by_their_bytes(monkeypatch):
    from tokenizers import Tokenizer

    plain, t = token_shards.units, Tokenizer.from_file(WORD_BPE)
    texts = ["cat dog cat", "a bird 12345678 12345679", "", "x" * 70 + " " + "y" * 70]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for few in (1, 2):  # all units in one cell, or in two

        def alike(raw, lower, few=few):
            out = plain(raw, lower)
            return *out[:3], out[3] % np.uint64(few) + np.uint64(1)

        monkeypatch.setattr(token_shards, "units", alike)
        encoder = token_shards.WordEncoder(WORD_BPE)
        assert [x.tolist() for x in encoder.encode_all([x.encode() for x in texts[:3]])] == want[:3]
        assert [x.tolist() for x in encoder.encode_all([x.encode() for x in texts[:3]])] == want[:3]
    monkeypatch.setattr(token_shards, "units", plain)
    encoder = token_shards.WordEncoder(WORD_BPE)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_all([x.encode() for x in texts])] == want


def test_token_shards_against_whole_texts(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pandas().sort_values("doc_id")
    out = queries.op4_token_shards(spark, SF).toPandas().sort_values("doc_id")
    coded = whole_texts(docs.text)
    assert out.n_tokens.tolist() == list(map(len, coded))
    assert out.start.tolist() == (out.n_tokens.cumsum() - out.n_tokens).tolist()
    assert out.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in coded]


def test_token_shards_edges(spark, odd, empty):
    path = f"{Scratch(spark, 'test').root}/odd"
    token_shards.write_shards(odd, path, WORD_BPE)
    out = token_shards.read_documents(spark, path).toPandas()
    rows = odd.select("doc_id", "text").toPandas()
    want = Counter((None if pd.isna(i) else int(i), len(c)) for i, c in zip(rows.doc_id, whole_texts(rows.text), strict=True))
    assert Counter((None if pd.isna(i) else int(i), n) for i, n in zip(out.doc_id, out.n_tokens, strict=True)) == want
    end = out[out.doc_id.isna()].start
    assert (end > out[~out.doc_id.isna()].start.max()).all()
    marked = token_shards.occurrences(spark, path, 49407).toPandas()
    assert set(marked.doc_id) == {11}
    token_shards.write_shards(empty, path + "-none", WORD_BPE)
    assert token_shards.read_documents(spark, path + "-none").count() == 0


def unigram(path):
    """The library's own unigram decoder over the same pieces and scores."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_equal_the_library():
    """The library's lattice search over the same pieces; on lines of known characters its sums are exact."""
    library, encoder = unigram(PIECES), sentence_pieces.Encoder(sentence_pieces.PieceModel.load(PIECES))
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = [x[:100] for t in texts for x in t.split("\n")[:3]] + ["  a   b ", "日本語", "x" * 50, "Ünï cödé"]
    known = [x for x in lines if x and "  " not in x and not any(map(library.is_byte, library.encode(x)))]
    assert len(known) > 100
    same = 0
    for x, own in zip(known, encoder.encode_all(known), strict=True):
        best = library.nbest_encode_as_ids(x, nbest_size=2)[0]
        assert sum(map(library.get_score, own.tolist())) >= sum(map(library.get_score, best))
        same += own.tolist() == best
    assert same > 0.85 * len(known)  # ties, and sums that the library rounds
    odd = ["a\nb\tc", "𝄞☃ \u0000 z", "▁x", "é \U0001f9ff", "\r\n\r\n", "", " "]
    assert [encoder.model.decode(c) for c in encoder.encode_all(odd)] == [x.replace("▁", " ") for x in odd]
    assert [library.decode(c.tolist()) for c in encoder.encode_all(odd)] == [x.replace("▁", " ") for x in odd]


def test_viterbi_finds_the_best_sum():
    pieces = [("<unk>", 0.0, 2), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    pieces += [("▁", -2.0, 1), ("a", -1.5, 1), ("ab", -1.0, 1), ("b", -1.6, 1), ("▁a", -3.0, 1), ("bab", -2.2, 1), ("é", -4.0, 1)]
    model = sentence_pieces.PieceModel(pieces)
    score = {p: s for p, s, k in pieces if k == 1}

    def best(t):
        if not t:
            return 0.0
        return max((score[t[:n]] if t[:n] in score else model.unknown if n == 1 else -1e9) + best(t[n:]) for n in range(1, min(4, len(t)) + 1))

    for t in ("▁ababab", "▁bab", "▁aé?b", "▁▁aab"):
        ids = sentence_pieces.Encoder(model).encode_all([t[1:].replace("▁", " ")])[0]
        own = sum(pieces[i][1] for i in ids if pieces[i][2] == 1) + model.unknown * sum(pieces[i][2] == 6 for i in ids)
        assert own == pytest.approx(best(t))


def naive_pieces(path):
    """Ids of a text by plain dynamic programming over its characters; ties go to the longer last piece."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    score = {m.id_to_piece(i): (m.get_score(i), i) for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))}
    byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    longest, unknown = max(map(len, score)), min(s for s, _ in score.values()) - sentence_pieces.UNKNOWN_PENALTY
    done = {}

    def chunk(t):
        best, back = [0.0] + [-np.inf] * len(t), [0] * (len(t) + 1)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - longest), j):
                piece = t[i:j]
                s = score[piece][0] if piece in score else unknown if j - i == 1 else None
                if s is not None and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        ids, j = [], len(t)
        while j:
            piece = t[back[j] : j]
            ids[:0] = [score[piece][1]] if piece in score else [byte[b] for b in piece.encode()]
            j = back[j]
        return ids

    def encode(t):
        out = []
        for c in re.findall("▁+[^▁]*|[^▁]+", "▁" + t.replace(" ", "▁")) if t else []:
            if c not in done:
                done[c] = chunk(c)
            out += done[c]
        return out

    assert not any("▁" in p.lstrip("▁") for p in score)  # so texts may be cut before markers
    return encode


def test_op8_query_against_plain_viterbi(spark):
    encode = naive_pieces(PIECES)
    got = {r.doc_id: r for r in queries.op8_sentence_pieces(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = encode(d["text"] or ""), got[d["doc_id"]]
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_viterbi_tables_are_bounded(monkeypatch):
    """Chunks of all lengths in small tables give what large ones give."""
    model = sentence_pieces.PieceModel.load(PIECES)
    chunks = [("▁" + "abc de"[: k % 7] * (1 + k % 40)).encode() for k in range(200)]
    whole = [x.tolist() for x in model.segment(chunks)]
    monkeypatch.setattr(sentence_pieces, "CELLS", 50)
    assert [x.tolist() for x in model.segment(chunks)] == whole


def test_sentence_pieces_edges(odd, empty):
    out = sentence_pieces.digest(odd, PIECES).toPandas()
    assert len(out) == odd.count() and out.round_trip.all() and (out.n_pieces == 0).sum() == 3
    back = sentence_pieces.decode(sentence_pieces.encode(odd, PIECES), PIECES)
    assert set(odd.columns) < set(back.columns)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back.collect())
    assert sentence_pieces.encode_checked(odd, PIECES, ["doc_id", "row"]).columns == ["doc_id", "row", "piece_ids", "n_pieces", "round_trip"]
    assert sentence_pieces.digest(empty, PIECES).count() == 0


def test_quality_on_labels_that_no_fit_uses(spark):
    """No label enters the fit, and the model of one half of the documents (by hash) judges the other half."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "truth")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs.filter(half == 0))
    unseen = docs.filter(half == 1).select("doc_id", "text")
    kinds = "doc_id long, quality double, posterior double, votes string, keep boolean"
    out = unseen.mapInArrow(quality._score(model, 0.5), kinds).join(labels, "doc_id").toPandas()
    rejected = ~out.keep
    assert len(out) > 1500 and (out.truth == 0).sum() > 50
    assert (out[rejected].truth == 0).mean() > 0.95 and rejected[out.truth == 0].mean() > 0.95
    # The rows' columns by hand: votes of each labeller, the posterior by Bayes, the score by the dot product.
    labels_model, scorer = model
    texts = {r.doc_id: r.text for r in unseen.filter("doc_id % 50 = 0").collect()}
    for r in out[out.doc_id.isin(list(texts))].itertuples():
        alone = text_features.describe([(texts[r.doc_id] or "").encode()])
        z = scorer.bias + sum(scorer.weights[i] * v for i, v in zip(alone.indices.tolist(), alone.values.tolist(), strict=True))
        assert quality._pattern(alone.votes) == [r.votes] and abs(1 / (1 + np.exp(-z)) - r.quality) < 1e-6
        odds = []
        for kind, bad in zip(labels_model.kinds, labels_model.bad, strict=True):
            for vote, p in zip(r.votes, bad, strict=True):
                kind *= {"0": p, "1": 1 - p}.get(vote, 1)
            odds.append(kind)
        assert abs(odds[0] / sum(odds) - r.posterior) < 1e-9


def naive_em(patterns, counts, rounds):
    """The label model's updates, row by row."""
    n = len(patterns[0])
    kinds = [0.8] + [0.2 / n] * n
    bad = [[0.01] * n] + [[0.9 if j == k else 0.2 for j in range(n)] for k in range(n)]
    prior = [list(kinds), [list(x) for x in bad]]
    for _ in range(rounds):
        weight = []
        for p, c in zip(patterns, counts, strict=True):
            odds = []
            for z, b in zip(kinds, bad, strict=True):
                for v, x in zip(p, b, strict=True):
                    z *= x if v == 0 else 1 - x if v == 1 else 1
                odds.append(z)
            weight.append([c * o / sum(odds) for o in odds])
        m = quality.PRIOR_ROWS
        sums = [sum(w[z] for w in weight) + m * prior[0][z] for z in range(n + 1)]
        kinds = [x / sum(sums) for x in sums]
        for z in range(n + 1):
            for k in range(n):
                yes = sum(w[z] for w, p in zip(weight, patterns, strict=True) if p[k] == 0)
                no = sum(w[z] for w, p in zip(weight, patterns, strict=True) if p[k] == 1)
                bad[z][k] = (yes + m * prior[1][z][k]) / (yes + no + m)
    return kinds, bad


def test_label_model_recovers_accuracies():
    """Two kinds of junk, each seen by labellers that err; against brute force, and against the truth."""
    rng = np.random.default_rng(2)
    kind = rng.choice(3, 20_000, p=[0.7, 0.2, 0.1])
    says_bad = np.array([[0.02, 0.9, 0.1], [0.05, 0.8, 0.05], [0.01, 0.05, 0.9], [0.04, 0.1, 0.8], [0.1, 0.6, 0.6]])
    votes = (rng.random((20_000, 5)) >= says_bad[:, kind].T).astype(int)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    few = quality.fit_label_model(patterns, counts, rounds=3)
    kinds, bad = naive_em(patterns.tolist(), counts.tolist(), 3)
    assert np.allclose(few.kinds, kinds) and np.allclose(few.bad, bad)
    model = quality.fit_label_model(patterns, counts)
    assert abs(model.kinds[0] - 0.7) < 0.03 and np.abs(model.bad[0] - says_bad[:, 0]).max() < 0.03
    truth = quality.LabelModel(np.array([0.7, 0.2, 0.1]), says_bad.T)
    right = [((m.posterior(votes) > 0.5) == (kind == 0)).mean() for m in (model, truth)]
    assert right[0] > 0.9 and right[0] > right[1] - 0.015  # near what the true accuracies allow
    assert model.accuracies()[0].argmin() == 4


def test_features_don_t_depend_on_the_run():
    """Texts described alone and together, and a plain account of their shares."""
    texts = [b"", b" \n", b"Go go go !! A|b", "Été ÉTÉ x*** 12 Ñandú".encode(), b"one two\none two\nthree", b"w " * 70, b"ab" * 9000]
    both = text_features.describe(texts)
    for k, t in enumerate(texts):
        one = text_features.describe([t])
        assert (one.votes[0] == both.votes[k]).all()
        assert (one.indices == both.indices[both.rows == k]).all() and np.allclose(one.values, both.values[both.rows == k])
    name = {n: i for i, n in enumerate(text_features.LABELLERS)}
    assert (both.votes[:2] == 2).all() and not (both.rows < 2).any()
    assert both.votes[2, name["bangs"]] == 0 and both.votes[2, name["bars"]] == 0
    assert both.votes[3, name["symbol_runs"]] == 0 and both.votes[5, name["repeats"]] == 0 and both.votes[5, name["variety"]] == 0
    assert both.votes[4, name["lines"]] == 2  # a third of its lines repeat


def test_quality_edges(spark, odd, empty):
    out = quality.classify(odd).toPandas()
    assert len(out) == odd.count() and quality.classify(empty).count() == 0
    blank = out[out.doc_id.isin([5, 6, 7])]
    assert (blank.votes == "2" * len(quality.LABELLERS)).all() and blank.quality.nunique() == 1 and blank.posterior.nunique() == 1
    assert out[out.doc_id == 2].drop_duplicates().shape[0] == 1  # repeated rows
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == out.keep.sum() and quality.keep_good(empty).count() == 0
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted("None" if pd.isna(i) else str(int(i)) for i in out[out.keep].doc_id)


def test_edited_counts_equal_full_counts(spark):
    import random

    counter = token_counts.PieceCounter(BYTE_BPE)
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()[:25]
    rng = random.Random(4)
    for text in [*texts, "", "  \n ", "don't we'll  x \n\n y"]:
        tree = token_counts.TokenTree(text, counter)
        assert tree.tokens == whole(text)
        for _ in range(25):
            at, n = rng.randrange(len(text) + 1), rng.choice((0, 0, 1, 3, 40))
            put = rng.choice(("", " ", "\n\n", "'", "ll", "'s", "l", "e", " two words ", "1234", "!?", "é中"))
            tree.edit(at, n, put)
            text = text[:at] + put + text[at + n :]
            assert tree.text == text and tree.tokens == whole(text)


def test_kept_trees_are_edited_twice(spark):
    """Trees that are written, edited, written and edited again count as full encoding does; big insertions get new leaves."""
    counter = token_counts.PieceCounter(BYTE_BPE)
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    texts = {1: "some words stand here " * 40, 2: "", 3: "don't  we'll", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    trees = scratch.save(token_counts.build_trees(docs, BYTE_BPE))
    edits = [(1, 0, 5, 3, "new words "), (1, 1, 0, 0, "x" * 9), (2, 0, 0, 0, "many more words " * 300), (3, 0, 3, 1, "'"), (9, 0, 0, 0, "none")]
    edits = spark.createDataFrame(edits, "doc_id long, seq int, start int, length int, insert string")
    for _ in range(2):
        for i, rows in ((r.doc_id, r) for r in edits.orderBy("seq").collect()):
            if i in texts:
                t = texts[i] or ""
                texts[i] = t[: rows.start] + rows.insert + t[rows.start + rows.length :]
        trees = scratch.save(token_counts.apply_edits(token_counts.with_edits(trees, edits), BYTE_BPE))
        got = {r.doc_id: (r.text, r.n_chars, r.n_tokens) for r in trees.join(token_counts.counts(trees), "doc_id").collect()}
        assert got == {i: (t or "", len(t or ""), whole(t or "")) for i, t in texts.items()}
    leaves = {r.doc_id: len(r.chars) // 2 for r in trees.collect()}
    assert leaves[2] >= 1200 // (2 * token_counts.LEAF) and {r.doc_id: r.n_reencoded for r in trees.collect()}[4] == 0


def test_op5_query_against_full_encoding(spark):
    counter = token_counts.PieceCounter(BYTE_BPE)
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        t, r = d["text"] or "", got[d["doc_id"]]
        after = t[: len(t) // 3] + t[len(t) // 3 + 12 :]
        after = after[: len(t) // 2] + "'s [2 notes] " + after[len(t) // 2 :]
        after = after[: len(t)] + "\nThe end." + after[len(t) :]
        n = [len(counter.tokenizer.encode(x, add_special_tokens=False).ids) for x in (t, after)]
        assert (r.n_chars, r.n_tokens, r.n_chars_after, r.n_tokens_after, r.n_edits) == (len(t), n[0], len(after), n[1], 3)
    assert np.mean([r.n_reencoded <= 3 * 4 * token_counts.LEAF + 200 for r in got.values()]) > 0.9


def test_token_counts_edges(spark, odd, empty):
    counter = token_counts.PieceCounter(BYTE_BPE)
    edits = F.array(F.struct(F.lit(-5).alias("start"), F.lit(None).cast("int").alias("length"), F.lit("z").alias("insert")), F.lit(None))
    trees = token_counts.saved_trees(odd, BYTE_BPE)
    out = token_counts.count_edited(trees.withColumn("e", edits), BYTE_BPE, "e").collect()
    whole = lambda t: (len(t), len(counter.tokenizer.encode(t, add_special_tokens=False).ids))
    want = Counter((r.doc_id, *whole(r.text or ""), *whole("z" + (r.text or "")), 1) for r in odd.collect())
    assert Counter((r.doc_id, r.n_chars, r.n_tokens, r.n_chars_after, r.n_tokens_after, r.n_edits) for r in out) == want
    assert token_counts.build_trees(empty, BYTE_BPE).count() == 0


def test_license_edges(spark, odd, empty):
    docs = [
        (1, "(C) 2020 Someone\nReleased under the mit LICENCE!\n"), (2, "Intro.\nLicensed under CC-BY NC 4.0\nReleased under the MIT License"),
        (3, None), (4, "All rights reserved."), (5, "Released under the MIT License. And more."),
    ]
    out = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"))
    found = sorted((r.doc_id, r.line_no, r.license) for r in out.collect())
    assert found == [(1, 0, "MIT"), (1, 2, "MIT"), (2, 2, "CC-BY-NC-4.0"), (2, 3, "MIT")]
    full = license_scan.KNOWN["ISC"][0]
    noisy = "Copyright (c) 1999, The Owner\n\n" + full.replace("license", "licence").upper().replace(",", "")
    one = license_scan.scan_licenses(spark.createDataFrame([(1, noisy)], "doc_id long, text string"))
    assert [(r.line_no, r.license) for r in one.collect()] == [(0, "ISC")]
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0


def test_url_edges(spark):
    rules = [*queries.RULES, url_filter.Rule("b.example.com", "/", "block")]
    rows = [
        (1, "http://Example.COM/en/1"), (2, "http://x.example.com/en/70?q#f"), (3, "http://com/en/"), (4, "http://notexample.com"),
        (5, None), (6, ""), (7, "no-scheme/en/"), (8, "http://a.b.example.com/en/7"), (9, "ftp://u@h.net:80/de/8"), (None, "http://d.org#/es/"),
        (2, "http://x.example.com/en/70?q#f"), (12, "http://" + "a." * 50_000 + "net/de/x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    out = defaultdict(list)
    for r in url_filter.filter_urls(pages, rules).collect():
        out[r.page_id].append((r.rule, r.verdict))
    assert out[1] == [("com/en/", "block")] and out[2] == [("example.com/en/7", "allow")] * 2 and out[3] == [("com/en/", "block")]
    assert out[8] == [("example.com/en/7", "allow")] and out[12] == [("net/de/", "block")]
    assert all(out[i] == [(None, "allow")] for i in (4, 5, 6, 7, 9, None))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_of_the_contract(spark):
    """Each rule's word is the contract's."""
    rows = [(1, "http://com/en/1"), (2, "http://m.example.com/en/70"), (3, "http://a.net/de/1"), (4, "http://example.net/de/8x"), (5, "http://x.org/es/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()}
    assert got == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"),
    }


def test_many_rules_against_brute_force(spark):
    """Nested hosts of all depths, many rules of a host, a hot host; rules as a table."""
    rng = np.random.default_rng(9)
    labels = ["a", "b", "c", "d-e", "x", ""]
    host = lambda n: ".".join(labels[i] for i in rng.integers(0, 5, n))
    rules = [(host(rng.integers(1, 5)), "/" + "".join(rng.choice(list("pq/"), rng.integers(0, 4))), str(rng.choice(["block", "allow"]))) for _ in range(400)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host(rng.integers(1, 7))}/{''.join(rng.choice(list('pq/'), 4))}?z" for _ in range(1500)] + ["http://a.b.c/pq"] * 500 + ["http://a..b/p", "http://.a/", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        h, _, p = u[len("http://") :].split("?")[0].partition("/")
        p = "/" + p if _ else ""
        fits = [(len(x) + len(y), len(x), x + y, y, v) for x, y, v in rules if (h == x or h.endswith("." + x)) and p.startswith(y)]
        best = max(fits, default=(0, 0, None, None, "allow"))
        assert got[i] == (best[2], best[4]), u
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, []), (7, [None, 1.0]),
        (50, [-1.0]), (None, [9.0, 9.0]), (8, [0.001, -0.001]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = [tuple(r) for r in top_k.top_k(vectors, k=3).orderBy("query_id", "rank").collect()]
    size = 256 * 256 + 512 * 512
    assert out[:3] == [(0, 1, 1, size), (0, 2, 2, size), (0, 3, 8, -512)]
    assert out[3:] == [(50, 1, 8, 0), (50, 2, 0, -65536), (50, 3, 1, -65536)]
    assert top_k.top_k(vectors.limit(0)).count() == 0


def test_top_k_over_many_shards(spark, monkeypatch):
    """Small shards, a hot vector, repeated ids: against brute force; queries reach few shards."""
    for name, value in {"SHARD_ROWS": 60, "TASK_QUERIES": 7, "ROOTS": 3, "BUILD_TASKS": 4}.items():
        monkeypatch.setattr(vector_shards, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 2 + 8 * (i % 5)).tolist()) for i in range(900)] + [(2000 + i, [3.0, 1.0, 4.0, 1.0]) for i in range(400)]
    rows += [(100, rows[100][1]), (7, [50.0, 0.0, 0.0, 0.0])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    ints = [(i, np.floor(np.array(v) * 256)) for i, v in rows]
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        own = min(tuple(v) for i, v in ints if i == q)
        best = sorted(((-int(np.dot(own, v)), i) for i, v in ints if i != q))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == best


def test_large_scores_are_exact(spark):
    """Scores beyond what a double holds; one that fits no long is an error, unless nobody asks for it."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**19), 2**19, 64) + 0.5).tolist()) for i in range(120)]
    rows += [(500 + i, [(2.0**20) * (1 + i % 3)] * 8) for i in range(9)]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    for q in (0, 50, 100, 500):
        best = sorted((-score(q, i), i) for i in whole if i != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == best
    alone = top_k.top_k(spark.createDataFrame([(0, [1e9]), (1, [1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in alone.collect()] == [(0, 1, 1, 256 * 256 * 10**9)]
    with pytest.raises(Exception, match="fit 64 bits"):
        top_k.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>")).collect()


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(8)
    vectors = np.floor(rng.normal(size=(3000, 12)) * 20)
    vectors[100:140] = vectors[0]
    ids = rng.permutation(3000)
    asked = vectors[:60]
    scores = asked @ vectors.T
    want = {}
    for q in range(60):
        scores[q, q] = -np.inf
        order = np.lexsort((ids, -scores[q]))[:5]
        want[q] = [(int(ids[i]), int(scores[q, i])) for i in order]
    floor = np.array([want[q][-1][1] if q % 2 else vector_shards.LOW for q in range(60)])
    labels, same, high = np.zeros(3000, np.int64), np.ones(60, bool), np.full(60, vector_shards.HIGH)
    question = {"vector": asked, "own": ids[:60], "label": labels[:60], "same": same, "low": floor, "high": high}
    at, found, score = top_k.BallTree(vectors, ids, labels).search(question, 5, None)
    got = defaultdict(list)
    for q, i, s in zip(at, found, score, strict=True):
        got[q].append((int(i), int(s)))
    assert dict(got) == want
