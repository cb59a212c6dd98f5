"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file. A text is marked (a marker first, and for each space), cut
where no piece can reach across, and each distinct chunk is segmented once: the best sum of scores wins, ties go to
the longer last piece. Characters that no piece covers cost the least score less ``UNKNOWN_PENALTY`` and become
bytes. The Viterbi runs over many chunks at once: all chunks walk the trie in step, as array operations.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import slices
from lectern.llm.word_cache import WordCache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 150_000
#: Cells (chunks times the bytes of the longest) of a Viterbi table, 17 bytes each; a longer chunk is a table of its own.
CELLS = 800_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class DoubleArray:
    """A trie of byte strings: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for value, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = value
        size = 2 * len(children) + 1024
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        low, wide, todo = 257, 257, [(0, 0)]
        while todo:
            node, state = todo.pop()
            self.value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            # Lone children fill the first gaps; several children go where the last ones went, or further on.
            while not free[low]:
                low += 1
            start = low if len(codes) == 1 else max(low, wide)
            base = start - codes[0] - 1
            offsets = np.array(codes) + 1
            while not free[base + offsets].all():
                base += 1
                if base + 258 > len(free):
                    grow = len(free)
                    free = np.concatenate([free, np.ones(grow, bool)])
                    self.base, self.value, self.check = (
                        np.concatenate([x, np.full(grow, fill, np.int32)])
                        for x, fill in ((self.base, 0), (self.value, -1), (self.check, -1))
                    )
            if len(codes) > 1:
                wide = base
            self.base[state] = base
            free[base + offsets] = False
            self.check[base + offsets] = state
            todo += [(children[node][c], base + c + 1) for c in codes]
        used = int(np.flatnonzero(~free)[-1]) + 260
        self.base, self.check, self.value = (
            np.concatenate([x, np.full(max(0, used - len(x)), -1, np.int32)])[:used] for x in (self.base, self.check, self.value)
        )


class PieceModel:
    """Pieces, scores and the trie; picklable, a few MB."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.texts = [b""] * len(pieces)
        self.byte_ids = np.full(256, -1, np.int64)
        keys, ids = [], []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind in (_NORMAL, _USER):
                keys.append(piece.encode())
                ids.append(i)
                self.texts[i] = piece.replace(MARK, " ").encode()
            elif kind == _BYTE:
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.texts[i] = bytes([value])
            elif kind == _UNKNOWN:
                self.texts[i] = " ⁇ ".encode()
        self.trie = DoubleArray(keys)
        self.ids = np.array(ids, np.int32)
        scores = np.array([pieces[i][1] for i in ids], np.float64)
        self.scores = scores
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        self.longest = max(map(len, keys))
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (_NORMAL, _USER))
        known = "".join(sorted({c for p, _, kind in pieces if kind in (_NORMAL, _USER) for c in p if len(p) > 1}))
        # Cuts: before a run of markers (unless a piece has a marker inside), and around characters of no longer piece.
        alone = f"[^{re.escape(known)}]"
        self.cut = re.compile(f"{alone}|[{re.escape(known)}]+" if inner else f"{alone}|{MARK}+[{re.escape(known.replace(MARK, ''))}]*|[{re.escape(known.replace(MARK, ''))}]+")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = (
            lambda i: _UNKNOWN if m.is_unknown(i) else _CONTROL if m.is_control(i) else _UNUSED if m.is_unused(i) else _BYTE if m.is_byte(i) else _NORMAL
        )
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def segment(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk (UTF-8), by Viterbi over all chunks in step."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        at = 0
        while at < len(order):
            end = at + 1
            width = len(chunks[order[at]])
            widest = max(24, width + width // 2)
            while end < len(order) and (end - at + 1) * widest <= CELLS and len(chunks[order[end]]) <= widest:
                end += 1
            group = order[at:end]
            for i, ids in zip(group, self._viterbi([chunks[i] for i in group]), strict=True):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, chunks: list[bytes]) -> list[np.ndarray]:
        n = len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, n)
        width = int(lengths.max(initial=0))
        text = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        text[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(lengths.cumsum() - lengths, lengths)] = flat
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((lengths > i) & ((text[:, i] & 0xC0) != 0x80))
            if not len(rows):
                continue
            first = text[rows, i]
            step = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            step = np.minimum(step, lengths[rows] - i)
            here = best[rows, i]
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + self.longest)):
                target = base[state] + text[rows[live], j] + 1
                ok = (check[target] == state) & (lengths[rows[live]] > j)
                live, state = live[ok], target[ok]
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    who, v = live[hit], v[hit]
                    single[who] |= step[who] == j + 1 - i
                    score = here[who] + self.scores[v]
                    better = score > best[rows[who], j + 1]
                    who, v, score = who[better], v[better], score[better]
                    best[rows[who], j + 1] = score
                    back[rows[who], j + 1] = i
                    piece[rows[who], j + 1] = v
            lone = np.flatnonzero(~single)
            ends = i + step[lone]
            score = here[lone] + self.unknown
            better = score > best[rows[lone], ends]
            lone, ends, score = lone[better], ends[better], score[better]
            best[rows[lone], ends] = score
            back[rows[lone], ends] = i
            piece[rows[lone], ends] = -1
        return self._paths(chunks, lengths, back, piece)

    def _paths(self, chunks: list[bytes], lengths: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        """Walks back from the ends, all chunks in step."""
        n = len(chunks)
        at, live, steps = lengths.copy(), np.flatnonzero(lengths > 0), []
        while len(live):
            p = piece[live, at[live]]
            start = back[live, at[live]]
            steps.append((live, start, at[live], p))
            at[live] = start
            live = live[start > 0]
        if not steps:
            return [np.zeros(0, np.int32)] * n
        rows, starts, ends, pieces = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((starts, rows))
        rows, starts, ends, pieces = rows[order], starts[order], ends[order], pieces[order]
        ids = np.where(pieces >= 0, self.ids[np.maximum(pieces, 0)], -1)
        cuts = np.searchsorted(rows, np.arange(n + 1))
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for r in np.unique(rows[pieces < 0]):
            parts = []
            for k in range(cuts[r], cuts[r + 1]):
                if pieces[k] >= 0:
                    parts.append(ids[k : k + 1])
                else:
                    raw = self.byte_ids[np.frombuffer(chunks[r][starts[k] : ends[k]], np.uint8)]
                    parts.append(raw if (raw >= 0).all() else np.array([self.unknown_id]))
            out[r] = np.concatenate(parts)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, markers as spaces, the leading one dropped; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Encoder:
    """Encodes texts with a bounded cache of segmented chunks."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.cache = WordCache(self._segmented, CACHE_CHUNKS)

    def _segmented(self, chunks: list[str]) -> list[bytes]:
        return [ids.astype(np.int32).tobytes() for ids in self.model.segment([c.encode("utf-8", "replace") for c in chunks])]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        find = self.model.cut.findall
        cut = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids = self.cache.all_of(itertools.chain.from_iterable(cut))
        return [np.frombuffer(b"".join(map(ids, chunks)), np.int32) for chunks in cut]


@functools.lru_cache(2)
def _encoder(name: str) -> Encoder:
    return Encoder(PieceModel.load(SparkFiles.get(name)))


#: Rows and bytes of a batch that are encoded at once; the rest waits in Arrow form.
_ROWS, _BYTES = 256, 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for rows in slices(batches, size=_BYTES, rows=_ROWS):
        yield rows, [t or "" for t in rows.column("text").to_pylist()]


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for rows, texts in _slices(batches):
            ids = pa.array(encoder.encode_all(texts), pa.list_(pa.int32()))
            yield pa.record_batch({"row": rows.column("row"), "ids": ids})

    return run


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(name).model
        for batch in batches:
            decoded = [model.decode(x.values.to_numpy()) for x in batch.column("ids")]
            yield pa.record_batch({"row": batch.column("row"), "decoded": pa.array(decoded, pa.string())})

    return run


def _ship(df: DataFrame, path: str) -> str:
    """Sends the model file to the executors once; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(documents: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """The input with ``out_col``, an array of ids. Null and empty texts get an empty array; rows and other columns stay."""
    name, own = _ship(documents, model_path), [c for c in documents.columns if c != out_col]
    kept = documents.select(F.struct(*own).alias("row"), F.col(text_col).cast("string").alias("text"))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    done = kept.mapInArrow(_encode(name), T.StructType([kept.schema["row"], ids]))
    return done.select(*[F.col("row")[c].alias(c) for c in own], F.col("ids").alias(out_col))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """The input with ``out_col``, the text of an array of ids (null as empty)."""
    name, own = _ship(encoded, model_path), [c for c in encoded.columns if c != out_col]
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    kept = encoded.select(F.struct(*own).alias("row"), ids.alias("ids"))
    text = T.StructField("decoded", T.StringType())
    done = kept.mapInArrow(_decode(name), T.StructType([kept.schema["row"], text]))
    return done.select(*[F.col("row")[c].alias(c) for c in own], F.col("decoded").alias(out_col))


def _transcode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for rows, texts in _slices(batches):
            coded = encoder.encode_all(texts)
            same = [encoder.model.decode(c) == t.replace(MARK, " ") for c, t in zip(coded, texts, strict=True)]
            ids = pa.array(coded, pa.list_(pa.int32()))
            yield pa.record_batch({"row": rows.column("row"), "ids": ids, "same": pa.array(same, pa.bool_())})

    return run


def encode_checked(documents: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``piece_ids``, ``n_pieces`` and ``round_trip``, in one pass over the texts.

    ``round_trip`` tells whether decoding gives the text back. Null and empty texts get an empty array and true.
    """
    name = _ship(documents, model_path)
    kept = documents.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]
    done = kept.mapInArrow(_transcode(name), T.StructType([kept.schema["row"], *fields]))
    return done.select(
        *[F.col("row")[c].alias(c) for c in keep],
        F.col("ids").alias("piece_ids"),
        F.size("ids").alias("n_pieces"),
        F.col("same").alias("round_trip"),
    )


def _digest(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for rows, texts in _slices(batches):
            coded = encoder.encode_all(texts)
            same = [encoder.model.decode(c) == t.replace(MARK, " ") for c, t in zip(coded, texts, strict=True)]
            crcs = [zlib.crc32(c.astype("<u4").tobytes()) for c in coded]
            sizes = [len(c) for c in coded]
            columns = [pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.record_batch([rows.column("doc_id"), *columns], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def digest(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32 (of the ids as unsigned 32-bit), round_trip.

    ``round_trip`` tells whether decoding the ids gives the text back (a marker in the text reads as a space). Null and
    empty texts have no pieces. Ids may be null or repeated; an empty table gives no rows; other columns are ignored.
    """
    name = _ship(documents, model_path)
    kept = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_digest(name), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
