"""Brown class-based bigrams: exchange clustering assigns words to classes; transitions between classes and emissions of
words from them score texts.

* *Slices.* Documents become slices of about ``SLICE_BYTES`` of text: the slice's distinct words, and its tokens as numbers
  of these. Longer documents are several slices. A word has one row a slice, so no key of the shuffles below can be hot.
* *Counts.* A word's training count is summed over its slices by one window, which also names the word by its first
  place. Counts meet their slices again by slice; no task and no broadcast ever holds the vocabulary.
* *Units.* What is clustered are units: each word that makes up ``FREQUENT`` of the training tokens or more (there are at most
  1 / ``FREQUENT``) and occurs ``LEAST`` times, and for all rarer words, unseen ones included, ``GROUPS`` groups by their
  last letters. Units are so few that their classes can be broadcast, whatever the corpus; counts of words stay exact.
* *Exchange.* A unit's contexts (the units before and after it, with counts over the whole training corpus) lie together,
  in rows of about ``BLOCK_ITEMS`` contexts, so that neither side of a task ever holds a part. In each round every unit moves to the class whose choice raises the log likelihood of the class bigrams most. Units of
  a part (``PART_UNITS``) move one after another and see each other's moves; parts meet after the round. A round that
  lowers the likelihood is taken back, and from then on half as many units move in a round. Only classes of units and
  tables of classes reach the driver.
* *Model.* P(w | v) = (1 - m) P(class of w | class of v) P(unit | class) P(w | unit) + m P_base(w), m = ``BASE_SHARE``.
  Transitions are smoothed towards the classes' frequencies by their number of kinds (Witten and Bell); a group keeps as
  much for unseen words as it has words seen once. The end of a text is a token of a class of its own, and what precedes
  the first word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import Scratch, setting

SLICE_BYTES = 4 << 20
#: Tokens of a slice, at most (a word has a byte and a blank); a document adds its end.
SLICE_TOKENS = 1 << 23
FREQUENT, GROUPS = 1e-5, 512
#: Occurrences below which a word has too few contexts for a class of its own choice, however small the corpus.
LEAST = 10
CLASSES, ROUNDS = 64, 12
#: Units that exchange one after another, seeing each other's moves; and the relative gain at which rounds end.
PART_UNITS, LITTLE = 2048, 1e-4
BASE_SHARE = 0.05
#: Bits of a unit's number: 1 / ``FREQUENT`` words, the end of text and ``GROUPS``.
UNIT_BITS = 17
#: Bigrams that a task sums up before it hands them over, in batches of ``OUT_ROWS``.
HELD_PAIRS, OUT_ROWS = 1_000_000, 1 << 16
#: Of a bigram's count in a slice (``SLICE_TOKENS`` at most), beside its two units in one long.
COUNT_BITS = 24
#: Contexts of a row, about; a unit's own (2 << UNIT_BITS at most) are never cut. Rows that the reader holds at once.
BLOCK_ITEMS, BLOCKS_READ = 1 << 17, 4
#: Bytes of the batches and of the Parquet row groups that slices come in; a longer slice is one of its own.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 8 << 20
#: Of the row groups of contexts, so large that a part's file is one task's; and tokens that are scored at once.
PART_BYTES, SCORED = 128 << 20, 1 << 16
END = b""
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANKS = b" \t\n\x0b\x0c\r"


def group_of(word: Column) -> Column:
    """The group of a rare word: a hash of its last three bytes."""
    return F.crc32(F.substring(word, -3, 3)) % GROUPS


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at blanks."""
    at = 0
    while len(text) - at > size:
        to = at + size
        while to < len(text) and text[to] not in _BLANKS:
            to += 1
        yield text[at:to]
        at = to
    if at < len(text) or not text:
        yield text[at:]


def _planes(tokens: np.ndarray) -> list[bytes]:
    """The three low bytes of the numbers, each by itself; they compress better so."""
    return [np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(3)]


def _numbers(planes: list[bytes]) -> np.ndarray:
    low, middle, high = (np.frombuffer(p, np.uint8).astype(np.int32) for p in planes)
    return low | (middle << 8) | (high << 16)


class _Slice:
    """Parts of documents on their way to a row: words, and of each part the document, its length, whether it ends."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.parts: list[tuple] = []
        self.bytes = 0

    def row(self) -> dict:
        """Words are numbered as they come, the end of text first; what precedes a part has a number too."""
        known = {END: 0} | dict.fromkeys(self.words) | dict.fromkeys(p[1] for p in self.parts)
        number = {w: i for i, w in enumerate(known)}
        tokens = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        lengths = np.array([p[2] for p in self.parts], np.int64)
        learned = np.repeat(np.array([not p[3] for p in self.parts], bool), lengths)
        return {
            "row": [p[0] for p in self.parts], "before": [number[p[1]] for p in self.parts], "length": lengths,
            "held": [p[3] for p in self.parts], "doc_id": [p[4] for p in self.parts], "planes": _planes(tokens), "words": list(number),
            "counts": np.bincount(tokens[learned], minlength=len(number)),
        }


_PARTS = "row array<long>, before array<int>, length array<int>, held array<boolean>, doc_id array<long>, planes array<binary>"
_PART_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
_SLICES = f"{_PARTS}, words array<binary>, counts array<int>"
_KINDS = {
    "slice": pa.int64(), "row": pa.list_(pa.int64()), "before": pa.list_(pa.int32()), "length": pa.list_(pa.int32()), "held": pa.list_(pa.bool_()),
    "doc_id": pa.list_(pa.int64()), "planes": pa.list_(pa.binary()), "words": pa.list_(pa.binary()),
    "counts": pa.list_(pa.int32()), "units": pa.list_(pa.int32()),
    "seen": pa.list_(pa.int64()),
}


def _batch(row: dict) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([row[c]], kind) for c, kind in _KINDS.items() if c in row})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of slices, numbers as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            plain = {c: row[c].as_py() for c in ("slice", "planes", "doc_id") if c in row}
            yield plain | {c: v.values.to_numpy(zero_copy_only=False) for c, v in row.items() if c not in plain}


def _encode(size: int):
    """Slices of the documents, each a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Slice()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("row", "held", "doc_id"))
            for row, held, doc_id, raw in zip(*columns, batch.column("text"), strict=True):
                text = (raw.as_buffer() if raw.is_valid else pa.py_buffer(b"")).to_pybytes()
                before, left = END, len(text)
                for piece in pieces(text, size):
                    left -= len(piece)
                    words = piece.translate(_LOWER).split()
                    if not left:
                        words.append(END)
                    if now.parts and now.bytes + len(piece) > size:
                        yield _batch(now.row())
                        now = _Slice()
                    now.words += words
                    now.parts.append((row, before, len(words), held, doc_id))
                    now.bytes += len(piece) + 1
                    before = words[-1] if words else before
        if now.parts:
            yield _batch(now.row())
        pa.default_memory_pool().release_unused()

    return run


def _packed(frequent: int) -> Column:
    """A word's number in its slice, its unit, and for a rare word its count, in one long."""
    rare = F.col("unit").isNull()
    unit = F.coalesce(F.col("unit"), F.col("group") + frequent).cast("long")
    high = F.when(rare, F.col("seen")).otherwise(F.lit(0)).cast("long") * (1 << UNIT_BITS) + unit
    return high * SLICE_TOKENS + F.col("local")


def _coded(counts):
    """Slices with each word's unit and training count; frequent words' counts are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for batch in batches:
            for i in range(batch.num_rows):
                packed = batch.column("entries")[i].values.to_numpy()
                local, high = packed % SLICE_TOKENS, packed // SLICE_TOKENS
                unit, seen = high & ((1 << UNIT_BITS) - 1), high >> UNIT_BITS
                of_unit = unit < len(known)
                seen[of_unit] = known[unit[of_unit]]
                ordered = np.empty((2, len(local)), np.int64)
                ordered[:, local] = unit, seen
                row = next(_read([batch.slice(i, 1).select(["slice", *_PART_NAMES])]))
                yield _batch(row | {"units": ordered[0], "seen": ordered[1]})

    return run


def _chained(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, what precedes each, starts of parts) of a slice, as its words' numbers."""
    tokens = _numbers(row["planes"])
    lengths = row["length"].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([tokens[:1], tokens[:-1]])
    full = lengths > 0
    before[starts[full]] = row["before"][full]
    return tokens, before, starts


def _pairs(units: int):
    """Counts of training bigrams of units, v * units + w, summed over slices while they are few."""

    def summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        each = np.concatenate(held)
        each.sort()
        key, n = each >> COUNT_BITS, each & ((1 << COUNT_BITS) - 1)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        return key[starts], np.add.reduceat(n, starts) if len(starts) else n

    def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), OUT_ROWS):
            yield pa.record_batch({"pair": pa.array(key[at : at + OUT_ROWS]), "n": pa.array(n[at : at + OUT_ROWS])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = [np.zeros(0, np.int64)], 0
        for row in _read(batches):
            tokens, before, _ = _chained(row)
            own = row["units"].astype(np.int64)
            learned = np.repeat(~row["held"].astype(bool), row["length"])
            key, n = np.unique(own[before[learned]] * units + own[tokens[learned]], return_counts=True)
            held.append((key << COUNT_BITS) | n)
            items += len(key)
            if items > HELD_PAIRS:
                yield from rows(*summed(held))
                held, items = held[:1], 0
        yield from rows(*summed(held))
        pa.default_memory_pool().release_unused()

    return run


_BLOCK = {"units": np.int32, "lengths": np.int32, "others": np.int32, "counts": np.int64}
_BLOCKS = "part int, " + ", ".join(f"{c} binary" for c in _BLOCK)


def _blocks(size: int):
    """Contexts (part, unit, other * 2 + side, n), in order of part and unit, as rows of whole units of a part."""

    def rows(part: np.ndarray, unit: np.ndarray, other: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for at, to in zip(starts, [*starts, len(part)][1:], strict=True):
            units, lengths = np.unique(unit[at:to], return_counts=True)
            columns = zip(_BLOCK.items(), (units, lengths, other[at:to], n[at:to]), strict=True)
            packed = {c: pa.array([x.astype(kind).tobytes()], pa.binary()) for (c, kind), x in columns}
            yield pa.record_batch({"part": pa.array(part[at : at + 1], pa.int32())} | packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("part", "unit", "other", "n")])
            items += batch.num_rows
            if items >= size:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                unit = whole[1]
                cut = items - int((unit[::-1] != unit[-1]).argmax()) if unit[0] != unit[-1] else 0  # the last unit may go on
                yield from rows(*(x[:cut] for x in whole))
                held, items = [[x[cut:].copy() for x in whole]], items - cut
        if items:
            yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _sides(batch: pa.RecordBatch, i: int, classes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(units, counts of classes before, counts of classes after, own successions) of a row of contexts."""
    unit, lengths, other, n = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in _BLOCK.items())
    owner = np.repeat(np.arange(len(unit)), lengths)
    side, other = other & 1, other >> 1
    out = []
    for s in range(2):
        at = side == s
        cell = owner[at] * k + classes[other[at]]
        out.append(np.bincount(cell, n[at], len(unit) * k).reshape(len(unit), k))
    itself = (side == 0) & (other == unit[owner])
    return unit, *out, np.bincount(owner[itself], n[itself], len(unit))


def _tables(shared, k: int):
    """Counts of class bigrams, summed over a task's units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, np.zeros((k, k))
        for batch in batches:
            for i in range(batch.num_rows):
                unit, left, _, _ = _sides(batch, i, classes, k)
                np.add.at(total.T, classes[unit], left)
        yield pa.record_batch({"cell": pa.array(np.arange(k * k), pa.int32()), "n": pa.array(total.reshape(-1).astype(np.int64))})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(base: np.ndarray, left: np.ndarray, right: np.ndarray, itself: float) -> np.ndarray:
    """What each class would gain in log likelihood by a unit that isn't counted in the table ``base``.

    left, right: counts of classes before and after the unit, without its successions of itself.
    """
    before, after = base.sum(1) + left, base.sum(0) + right  # whatever the class, others have the unit beside them
    column, row, cell = np.flatnonzero(left), np.flatnonzero(right), base.diagonal()
    gain = (_xlogx(base[column] + left[column, None]) - _xlogx(base[column])).sum(0)
    gain += (_xlogx(base[:, row] + right[row]) - _xlogx(base[:, row])).sum(1)
    # A class's cell with itself gets both contexts and the unit's own successions.
    gain += _xlogx(cell + left + right + itself) - _xlogx(cell + left) - _xlogx(cell + right) + _xlogx(cell)
    gain -= _xlogx(before + right.sum() + itself) - _xlogx(before)
    return gain - (_xlogx(after + left.sum() + itself) - _xlogx(after))


def _put(table: np.ndarray, c: int, left: np.ndarray, right: np.ndarray, itself: float) -> None:
    """Counts a unit's contexts in class ``c``."""
    table[:, c] += left
    table[c, :] += right
    table[c, c] += itself


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, without the part that no choice of classes changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def _moves(shared, k: int):
    """The exchange within each part, one unit after another; class 0 is the end of text's alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table, fixed, turn, share = shared.value
        now, part = None, None
        for batch in batches:
            for block, p in enumerate(batch.column("part").to_pylist()):
                unit, lefts, rights, selves = _sides(batch, block, classes, k)
                best = classes[unit]
                if p != part:
                    now, part = table.copy(), p
                for i, u in enumerate(unit.tolist()):
                    if u == fixed or u % share != turn % share:
                        continue
                    own, left, right, itself = best[i], lefts[i], rights[i], selves[i]
                    left[own] -= itself
                    right[own] -= itself
                    _put(now, own, -left, -right, -itself)
                    gain = gains(now, left, right, itself)
                    gain[0] = -np.inf
                    if gain.max() > gain[own] + 1e-6:
                        best[i] = gain.argmax()
                    _put(now, best[i], left, right, itself)
                yield pa.record_batch({"unit": pa.array(unit, pa.int32()), "best": pa.array(best, pa.int32())})

    return run


def exchange(contexts: DataFrame, sizes: np.ndarray, end: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class bigrams). contexts: rows of ``_blocks``; sizes: the units' counts."""
    spark = contexts.sparkSession
    classes = np.empty(len(sizes), np.int64)
    classes[np.argsort(-sizes, kind="stable")] = 1 + np.arange(len(sizes)) % (k - 1)
    classes[end] = 0

    def table_of(own: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(own)
        cells = contexts.mapInArrow(_tables(shared, k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        out = np.zeros(k * k)
        for r in cells.collect():  # a row for each two classes
            out[r["cell"]] = r["n"]
        return out.reshape(k, k)

    table, share = table_of(classes), 1
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((classes, table, end, turn, share))
        found = contexts.mapInArrow(_moves(shared, k), "unit int, best int").toArrow()  # a row a unit
        moved = classes.copy()
        moved[found["unit"].to_numpy()] = found["best"].to_numpy()
        then = table_of(moved)
        gained = likelihood(then) - likelihood(table)
        if gained > 0:
            classes, table = moved, then
        share = share if gained > 0 else 2 * share
        if 0 <= gained < LITTLE * abs(likelihood(table)):
            break
    return classes, table


class Model:
    """Log10 probabilities of tokens from their units, counts and predecessors' units."""

    def __init__(
        self, classes: np.ndarray, table: np.ndarray, sizes: np.ndarray, groups: np.ndarray, total: int, kinds: int, share: float = BASE_SHARE
    ) -> None:
        """sizes: the units' training counts, groups last; groups: each group's words seen once; total, kinds: of training tokens."""
        self.classes, self.share, self.total, self.kinds = classes, share, total, kinds
        self.frequent, k = len(sizes) - len(groups), len(table)
        after = table.sum(0)
        plain = (after + 1) / (after.sum() + k)
        distinct = np.maximum((table > 0).sum(1, keepdims=True), 1)
        self.transition = (table + distinct * plain) / (table.sum(1, keepdims=True) + distinct)
        by_class = np.bincount(classes, sizes, k)
        self.unit = sizes / np.maximum(by_class[classes], 1)
        self.once, self.room = groups, sizes[self.frequent :] + groups

    def log10(self, unit: np.ndarray, seen: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of tokens of ``unit`` with the training count ``seen`` after units ``before``."""
        group = np.maximum(unit - self.frequent, 0)
        rare = np.where(seen > 0, seen, self.once[group]) / np.maximum(self.room[group], 1)
        inside = np.where(unit < self.frequent, 1.0, rare)
        known = self.transition[self.classes[before], self.classes[unit]] * self.unit[unit] * inside
        return np.log10((1 - self.share) * known + self.share * 10 ** self.base(seen))

    def base(self, seen: np.ndarray) -> np.ndarray:
        return np.log10((seen + 1) / (self.total + self.kinds + 1))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _read(batches):
            tokens, before, starts = _chained(row)
            units, lengths = row["units"].astype(np.int64), row["length"].astype(np.int64)
            full = lengths > 0
            known, base, score = np.empty(len(tokens), np.int64), np.empty(len(tokens)), np.empty(len(tokens))
            for at in range(0, len(tokens), SCORED):
                run = slice(at, at + SCORED)
                count = row["seen"][tokens[run]]
                known[run], base[run] = count > 0, model.base(count)
                score[run] = model.log10(units[tokens[run]], count, units[before[run]])

            def sums(each: np.ndarray, starts=starts, full=full) -> pa.Array:
                out = np.zeros(len(full), each.dtype)
                out[full] = np.add.reduceat(each, starts[full]) if full.any() else 0
                return pa.array(out)

            yield pa.record_batch(
                {
                    "row": pa.array(row["row"]),
                    "doc_id": pa.array(row["doc_id"], pa.int64()),
                    "held_out": pa.array(row["held"].astype(bool)),
                    "n_tokens": pa.array(lengths),
                    "n_known": sums(known),
                    "base_score": sums(base),
                    "score": sums(score),
                }
            )

    return run


def _slices(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: doc_id, text (binary), held."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    place = F.monotonically_increasing_id()
    slices = rows.mapInArrow(_encode(SLICE_BYTES), _SLICES).withColumn("place", place)
    number = F.shiftleft(F.shiftright("place", 33), 16) + F.col("place").bitwiseAND((1 << 33) - 1)
    return scratch.save(slices.withColumn("slice", number).drop("place"), GROUP_BYTES)


def _entries(slices: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Each word of each slice with its training count; words of ``least`` or more, and the end of text, have a name.

    The text stands at the name's first place only.
    """
    if least >> (63 - UNIT_BITS - SLICE_TOKENS.bit_length() + 1):
        raise ValueError(f"counts of rare words, below {least}, don't fit beside their units")
    each = slices.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x"))
    # A place stands for slice and number, so a row of the shuffle is a word and two numbers.
    each = each.select("x.words", "x.counts", (F.col("slice") * SLICE_TOKENS + F.col("local")).alias("place"))
    by_word = Window.partitionBy("words")
    each = each.withColumn("seen", F.sum("counts").over(by_word)).withColumn("first", F.min("place").over(by_word))
    named = (F.col("seen") >= least) | (F.length("words") == 0)
    return scratch.save(
        each.select(
            F.expr(f"place div {SLICE_TOKENS}").alias("slice"), (F.col("place") % SLICE_TOKENS).cast("int").alias("local"),
            group_of(F.col("words")).cast("int").alias("group"), "seen", (F.col("first") == F.col("place")).alias("is_first"),
            F.when(named, F.col("first")).otherwise(F.lit(-1)).alias("word"), F.when(named & (F.col("first") == F.col("place")), F.col("words")).alias("text"),
        )
    )


def class_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from documents whose crc32 of the id as text leaves another remainder by ``folds`` than ``fold``. Tokens are
    the words of the lower-cased (A-Z) text between the six ASCII blanks, then one end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) with the training counts c of the tokens, N of all and V of kinds; ``n_known`` counts c > 0.
    Null counts as an empty text (its end alone), a null id as an empty one, so it learns. Rows that repeat an id are
    scored each by its own text. Where nothing is learned from, scores come from the base alone. An empty table gives no
    rows; other columns of ``documents`` are ignored.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "class-model", BATCH_BYTES)
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        (F.crc32(named.cast("binary")) % folds == fold).alias("held"),
    )
    slices = _slices(docs, scratch)
    total = slices.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    entries = _entries(slices, max(LEAST, int(np.ceil(FREQUENT * total))), scratch)
    first = entries.filter("is_first")
    frequent = first.filter("word >= 0").select("word", "seen", "text").toArrow()  # 1 / FREQUENT rows at most
    frequent = frequent.sort_by([("seen", "descending"), ("text", "ascending")])  # units don't depend on the slices
    ids, sizes = (frequent[c].to_numpy() for c in ("word", "seen"))
    groups, once = np.zeros(GROUPS), np.zeros(GROUPS)
    kinds = int((sizes > 0).sum())
    rare = first.filter("word < 0 and seen > 0").groupBy("group")
    for r in rare.agg(F.sum("seen").alias("n"), F.sum((F.col("seen") == 1).cast("int")).alias("once"), F.count("*").alias("kinds")).collect():
        groups[r["group"]], once[r["group"]] = r["n"], r["once"]
        kinds += r["kinds"]
    sizes, end = np.concatenate([sizes, groups]), frequent["text"].to_pylist().index(END) if len(ids) else 0
    names = pa.table({"word": ids, "unit": pa.array(np.arange(len(ids)), pa.int32())})
    placed = entries.join(F.broadcast(spark.createDataFrame(names)), "word", "left")
    own = placed.groupBy("slice").agg(F.collect_list(_packed(len(ids))).alias("entries"))
    met = slices.select("slice", *_PART_NAMES).join(own, "slice")
    coded = met.mapInArrow(_coded(spark.sparkContext.broadcast(sizes[: len(ids)].astype(np.int64))), f"slice long, {_PARTS}, units array<int>, seen array<long>")
    coded = scratch.save(coded, GROUP_BYTES)
    scratch.drop(slices, entries)
    pairs = coded.mapInArrow(_pairs(len(sizes)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    v, w = F.expr(f"cast(pair div {len(sizes)} as int)").alias("v"), F.expr(f"cast(pair % {len(sizes)} as int)").alias("w")
    pairs = scratch.save(pairs.select(v, w, "n"))
    parts = -(-len(sizes) // PART_UNITS)
    sides = [
        pairs.select((F.col(own) % parts).alias("part"), F.col(own).alias("unit"), (F.col(other) * 2 + s).alias("other"), "n")
        for s, (own, other) in enumerate((("w", "v"), ("v", "w")))
    ]
    contexts = sides[0].union(sides[1]).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "unit")
    contexts = scratch.save(contexts.mapInArrow(_blocks(BLOCK_ITEMS), _BLOCKS), PART_BYTES)
    scratch.drop(pairs)
    with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", BLOCKS_READ):
        classes, table = exchange(contexts, sizes, end)
    model = Model(classes, table, sizes, once, total, kinds, BASE_SHARE if total else 1.0)
    kinds_ = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    parts = coded.mapInArrow(_score(spark.sparkContext.broadcast(model)), kinds_)
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias(id_col), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    return whole.select(
        id_col, "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
