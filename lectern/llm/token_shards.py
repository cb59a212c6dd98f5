"""Token-ID output: one compressed wavelet-matrix file per shard.

Documents are range-partitioned by id, sorted, encoded and written as shards: a Parquet row per part of a shard, with
the documents' ids and lengths and the part's wavelet matrix (``wavelet``), which gives token access, counts and
occurrences without unpacking the ids. Spark's writer commits the files, so lost executors and remote stores are
its business. Texts are encoded word by word: the tokenizer never joins what ASCII blanks part, so words are looked
up in a bounded table by two 64-bit hashes and only new ones are encoded (``_parts_at_blanks`` checks the tokenizer for that).
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.batches import slices, texts
from lectern.llm.shingles import KEEP, STEPPED_BYTES, eights, units
from lectern.llm.wavelet import WaveletMatrix

END_ID = 1
#: Tokens of one part; a longer document is a part of its own.
PART_TOKENS = 2_000_000
#: Units (about 40 bytes each) up to which the table grows before it starts anew.
TABLE_UNITS = 3_000_000
#: Bytes of text that are looked up at once.
RUN_BYTES = 1 << 20
#: Parts (three numbers each) up to which their starts are broadcast.
BROADCAST_PARTS = 1_000_000
_SHARD = "shard int, part int, doc_ids array<long>, n_tokens array<long>, tokens binary"


class UnitTable:
    """Token ids of units by two hashes: open addressing in arrays, so whole batches are looked up at once.

    Hashes are (2, n) tables: the first places a unit, and a cell is its own only if both agree. Units' bytes are kept, so
    ``same`` tells whether a unit that was found is the unit that was asked for.
    """

    def __init__(self, bits: int = 16) -> None:
        self.keys, self.checks = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.slots = np.zeros(1 << bits, np.int32)
        self.count = self.used = 0
        self.offsets, self.lengths = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.pool = np.zeros(4 << bits, np.uint32)
        self.text, self.text_used = np.zeros(16 << bits, np.uint8), 0
        self.text_at, self.text_size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each hash, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        keys, checks = hashes[0] | np.uint64(1), hashes[1]  # a key of 0 would mean an empty cell
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        at = (keys >> np.uint64(1)) & mask
        while len(left):
            there = self.keys[at]
            hit = (there == keys[left]) & (self.checks[at] == checks[left])
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return out

    def same(self, unit: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether spans of ``raw`` are the bytes of units, eight at a time; spans whose hash is a BLAKE2b digest are."""
        length, at = end - start, self.text_at[unit]
        out = (self.text_size[unit] == length) | (length > STEPPED_BYTES)
        live = np.flatnonzero(out & (length <= STEPPED_BYTES))
        left, one, other = length[live], start[live], at[live]
        mine, theirs = (eights(x) for x in (raw, self.text[: self.text_used]))
        while len(live):
            equal = ((mine[one] ^ theirs[other]) & KEEP[np.minimum(left, 8)]) == 0
            out[live[~equal]] = False
            on = equal & (left > 8)
            live, left, one, other = live[on], left[on] - 8, one[on] + 8, other[on] + 8
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes], texts: list[bytes]) -> None:
        """Distinct hashes that aren't there yet."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat_text = np.frombuffer(b"".join(texts), np.uint8)
        while self.text_used + len(flat_text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.count + len(texts) > len(self.text_at):
            self.text_at, self.text_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.text_at, self.text_size))
        new = slice(self.count, self.count + len(texts))
        self.text_at[new], self.text_size[new] = self.text_used + sizes.cumsum() - sizes, sizes
        self.text[self.text_used : self.text_used + len(flat_text)] = flat_text
        self.text_used += len(flat_text)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = hashes.shape[1]
        first = np.arange(self.count, self.count + n)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + n > len(self.lengths):
            self.offsets, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.lengths))
        self.pool[self.used : self.used + len(flat)] = flat
        self.offsets[first], self.lengths[first] = self.used + lengths.cumsum() - lengths, lengths
        self.used += len(flat)
        self.count += n
        if 2 * self.count > len(self.keys):
            full = self.keys != 0
            keys, checks, slots = self.keys[full], self.checks[full], self.slots[full]
            size = len(self.keys)
            while 2 * self.count > size:
                size *= 4
            self.keys, self.checks, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, checks, slots)
        self._place(hashes[0] | np.uint64(1), hashes[1], first)

    def _place(self, keys: np.ndarray, checks: np.ndarray, slots: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = (keys >> np.uint64(1)) & mask
        while len(keys):
            _, winner = np.unique(at, return_index=True)
            winner = winner[self.keys[at[winner]] == 0]
            cell = at[winner]
            self.keys[cell], self.checks[cell], self.slots[cell] = keys[winner], checks[winner], slots[winner]
            rest = np.ones(len(keys), bool)
            rest[winner] = False
            keys, checks, slots, at = keys[rest], checks[rest], slots[rest], (at[rest] + np.uint64(1)) & mask


class WordEncoder:
    """Encodes whole texts as the tokenizer does, unit by unit with a bounded table of known units."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _parts_at_blanks(path)
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.table = UnitTable()
        # A special token between units keeps them apart, so many units are encoded in one call.
        added = self.tokenizer.get_added_tokens_decoder()
        special = [(t.content, i) for i, t in added.items() if t.special]
        self.between, self.between_id = special[0] if special else (None, -1)
        self.added = [t.content.encode() for t in added.values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_ends = None
        if suffix and self.parts:
            vocabulary = self.tokenizer.get_vocab()
            self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.word_ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def _unit_ids(self, words: list[str]) -> list[bytes]:
        """The ids of units without blanks and added tokens.

        A unit of ASCII letters is one pre-token, whose last id alone ends a word: blanks keep such units apart.
        """
        if self.word_ends is None:
            return self._apart(words)
        plain = [w.isascii() and w.isalpha() for w in words]
        letters, others = ([w for w, x in zip(words, plain, strict=True) if x == y] for y in (True, False))
        known = []
        for raw in self._ids([" ".join(letters[i : i + 1000]) for i in range(0, len(letters), 1000)]):
            cuts = [0, *(np.flatnonzero(self.word_ends[np.frombuffer(raw, "<u4")]) + 1)]
            known += [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(known) != len(letters):
            return self._apart(words)
        sides = iter(known), iter(self._apart(others))
        return [next(sides[0] if x else sides[1]) for x in plain]

    def _apart(self, words: list[str]) -> list[bytes]:
        """With a special token between the units."""
        if self.between is None:
            return self._ids(words)
        runs = [self.between.join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        out = []
        for raw in self._ids(runs):
            ids = np.frombuffer(raw, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.between_id), len(ids)]
            out += [raw[4 * (a + 1) : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text. Texts with an added token's string go through the tokenizer whole."""
        texts = [t or b"" for t in texts]
        whole = [not self.parts or b"<|" in t or any(x in t for x in self.added) for t in texts]
        alone = iter(self._ids([t.decode("utf-8", "replace") for t, w in zip(texts, whole, strict=True) if w]))
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and not whole[end] and (end == at or size + len(texts[end]) < RUN_BYTES):
                size += len(texts[end])
                end += 1
            if end > at:
                out += self._run(texts[at:end])
            else:
                out.append(np.frombuffer(next(alone), "<u4"))
                end += 1
            at = end
        return out

    def _run(self, texts: list[bytes]) -> list[np.ndarray]:
        raw, start, end, hashes = units(b"\n".join(texts), self.lower)
        unit = self.table.find(hashes)
        if (unit < 0).any():
            if self.table.count > TABLE_UNITS:
                self.table = UnitTable()
                unit = np.full(hashes.shape[1], -1)
            spots = np.flatnonzero(unit < 0)
            new = hashes[:, spots]
            order = np.lexsort(new[::-1])
            new, spots = new[:, order], spots[order]
            first = np.concatenate([[True], (new[:, 1:] != new[:, :-1]).any(0)])
            new, spots = new[:, first], spots[first]
            whole = raw.tobytes()
            words = [whole[a:b] for a, b in zip(start[spots], end[spots], strict=True)]
            # The bytes of a long unit stand for themselves by its digest, and needn't be kept.
            kept = [w if len(w) <= STEPPED_BYTES else b"" for w in words]
            self.table.add(new, self._unit_ids([w.decode("utf-8", "replace") for w in words]), kept)
            unit[unit < 0] = self.table.find(hashes[:, unit < 0])
        if not self.table.same(unit, raw, start, end).all():  # units built to look alike: the tokenizer itself
            return [np.frombuffer(x, "<u4") for x in self._ids([t.decode("utf-8", "replace") for t in texts])]
        sizes = self.table.lengths[unit]
        before = sizes.cumsum() - sizes
        source = np.repeat(self.table.offsets[unit] - before, sizes) + np.arange(int(sizes.sum()))
        flat = self.table.pool[source]
        ends = np.cumsum([len(t) + 1 for t in texts])  # with the line end that joins
        cuts = np.searchsorted(start, ends)
        marks = np.concatenate([before, [len(flat)]])[np.concatenate([[0], cuts])]
        return [flat[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]


def _parts_at_blanks(path: str) -> bool:
    """Whether blanks are dropped between pre-tokens, so that words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    split = model["pre_tokenizer"]["pretokenizers"][0] if "pretokenizers" in (model["pre_tokenizer"] or {}) else {}
    dropped = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    return bool(dropped) and r"\s\p{L}" in split["pattern"].get("Regex", "") and not any(" " in t["content"] for t in model["added_tokens"])


@functools.lru_cache(2)
def _encoder(name: str) -> WordEncoder:
    return WordEncoder(SparkFiles.get(name))


def _write_parts(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, part = _encoder(name), TaskContext.get().partitionId(), 0
        ids, coded, size = [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal part
            matrix = WaveletMatrix.build(np.concatenate(coded))
            row = {
                "shard": pa.array([shard], pa.int32()),
                "part": pa.array([part], pa.int32()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([[len(c) + 1 for c in coded[::2]]], pa.list_(pa.int64())),
                "tokens": pa.array([matrix.to_bytes()], pa.binary()),
            }
            part += 1
            return pa.record_batch(row)

        for rows in slices(batches):
            for doc_id, c in zip(rows.column("id").to_pylist(), encoder.encode_all(texts(rows)), strict=True):
                if ids and size + len(c) + 1 > PART_TOKENS:
                    yield close()
                    ids, coded, size = [], [], 0
                ids.append(doc_id)
                coded += [c, end]
                size += len(c) + 1
        if ids:
            yield close()

    return run


def write_shards(
    documents: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shards: int | None = None,
) -> None:
    """Writes all documents' ids, each followed by ``end_id``, in ascending order of their document ids, nulls last.

    Null texts count as empty and give ``end_id`` alone. Documents of equal ids stand side by side, in the order of
    their texts. An empty table writes no rows; other columns of ``documents`` are ignored.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(tokenizer_path)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    # Texts' beginnings part rows of one id, or of none, among tasks; whole texts would make the ranges' bounds long.
    begins = F.substring("text", 1, 64).asc_nulls_first()
    ranged = docs.repartitionByRange(*([shards] if shards else []), order[0], begins)
    name = tokenizer_path.rsplit("/", 1)[-1]
    ranged.sortWithinPartitions(*order).mapInArrow(_write_parts(name, end_id), _SHARD).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row per part: shard, part, doc_ids, n_tokens, tokens (bytes of a ``WaveletMatrix``)."""
    return spark.read.schema(_SHARD).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, lengths = batch.column("doc_ids")[k].as_py(), np.array(batch.column("n_tokens")[k].as_py(), np.int64)
            tokens = WaveletMatrix.from_bytes(batch.column("tokens")[k].as_py()).tokens().astype("<u4")
            ends = lengths.cumsum()
            raw = memoryview(tokens.tobytes())
            starts = ends - lengths
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "start": pa.array(starts + batch.column("before")[k].as_py(), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()
                    ),
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, from the matrices."""
    parts = read_shards(spark, path)
    sizes = parts.select("shard", "part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    of_shard = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    of_shard = of_shard.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_before"))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("in_shard", F.coalesce(F.sum("n").over(within), F.lit(0))).join(of_shard, "shard")
    before = before.select("shard", "part", (F.col("in_shard") + F.col("shard_before")).alias("before"))
    if before.count() <= BROADCAST_PARTS:  # else the parts' bytes are shuffled to their counts
        before = F.broadcast(before)
    return parts.join(before, ["shard", "part"]).mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _lookup(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.array(batch.column("n_tokens")[k].as_py(), np.int64)
                found = WaveletMatrix.from_bytes(batch.column("tokens")[k].as_py()).occurrences(token)
                doc = np.searchsorted(lengths.cumsum(), found, "right")
                ids = batch.column("doc_ids")[k].as_py()
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([ids[d] for d in doc], pa.int64()),
                        "position": pa.array(found - (lengths.cumsum() - lengths)[doc], pa.int64()),
                    }
                )

    return run


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position in the document) of a token id, by select on each part's planes."""
    return read_shards(spark, path).mapInArrow(_lookup(token), "doc_id long, position long")
