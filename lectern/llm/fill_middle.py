"""Fill-in-the-middle transformation: a parallel automaton scan counts lines and finds reserved marks.

* *Scan.* Bytes are cut into lanes of equal width, whatever the documents' lengths. All lanes step through two automata
  at once, from every start state: one begins a unit (a line) at the first byte after a line end, the other knows how
  much of a reserved mark it has read. A lane yields its state-transition function and its count of units for each
  start state.
* *Composition.* Functions compose associatively, so entry states and the units before each lane follow from a fold
  over lanes. Short documents are folded in their task, many at a time.
* *Giant documents.* Texts beyond ``GIANT_BYTES`` are dealt to all tasks in chunks. A chunk's lanes are folded for every
  start state, and only these functions (a few numbers) meet again by document, in the order of chunks.
* *Selection.* A cut after k units is where unit k + 1 begins. Counts tell the chunk and the lane that hold it; only
  that lane is stepped through again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import slices, texts
from lectern.llm.scratch import Scratch

MARKS = ("<P>", "<S>", "<M>")
LANE_BYTES = 256
#: Texts of more bytes are scanned in chunks of ``CHUNK_BYTES`` by several tasks.
GIANT_BYTES, CHUNK_BYTES = 1 << 16, 1 << 14
#: Giant documents up to which their cuts (about 100 bytes each) are broadcast to meet their texts.
BROADCAST_ROWS = 200_000


class Automaton:
    """A table of transitions over byte classes; the class ``pad`` leaves every state and counts nothing."""

    def __init__(self, after: np.ndarray, emit: np.ndarray, classes: np.ndarray) -> None:
        """after, emit: (states, 256) next states and counts; classes: of each byte, so that equal columns share one."""
        kinds = int(classes.max()) + 1
        first = np.array([np.flatnonzero(classes == c)[0] for c in range(kinds)])
        self.states, self.pad = len(after), kinds
        own = np.arange(self.states)[:, None]
        self.after = np.concatenate([after[:, first], own], 1).astype(np.int16).reshape(-1)
        self.emit = np.concatenate([emit[:, first], 0 * own], 1).astype(np.int32).reshape(-1)
        self.classes = classes.astype(np.int16)

    def scan(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, count) of each lane (row of classes) and start state."""
        state = np.tile(np.arange(self.states, dtype=np.int16), (len(lanes), 1))
        count = np.zeros(state.shape, np.int32)
        counts = self.emit.any()
        for column in np.ascontiguousarray(lanes.T):
            cell = state * np.int16(self.pad + 1) + column[:, None]
            if counts:
                count += self.emit[cell]
            state = self.after[cell]
        return state, count

    def select(self, lanes: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place in each lane, entered in its state, at which the count goes from ``rank`` to ``rank`` + 1."""
        at, seen = np.full(len(lanes), -1), np.zeros(len(lanes), np.int64)
        for k, column in enumerate(np.ascontiguousarray(lanes.T)):
            cell = state * np.int16(self.pad + 1) + column
            step = self.emit[cell]
            at[(seen == rank) & (step > 0) & (at < 0)] = k
            seen += step
            state = self.after[cell]
        return at


def line_automaton() -> Automaton:
    """State 0: the next byte begins a unit; state 1: inside one. Each unit counts at its first byte."""
    after = np.ones((2, 256), int)
    after[:, 10] = 0
    emit = np.zeros((2, 256), int)
    emit[0] = 1
    return Automaton(after, emit, np.arange(256) == 10)


def mark_automaton(marks: Sequence[bytes]) -> Automaton:
    """States are the marks' prefixes, from none; the last state is reached once a mark has been read, and never left."""
    prefixes = sorted({m[:k] for m in marks for k in range(len(m))}, key=lambda p: (len(p), p))
    place, found = {p: i for i, p in enumerate(prefixes)}, len(prefixes)
    after = np.zeros((found + 1, 256), int)
    after[found] = found
    for p, i in place.items():
        for b in range(256):
            read = p + bytes([b])
            if any(read.endswith(m) for m in marks):
                after[i, b] = found
            else:
                after[i, b] = next(place[read[k:]] for k in range(len(read) + 1) if read[k:] in place)
    _, classes = np.unique(after, axis=1, return_inverse=True)
    return Automaton(after, np.zeros_like(after), classes.reshape(-1))


def fold(
    after: np.ndarray, count: np.ndarray, sizes: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composes the functions of consecutive lanes, ``sizes`` of them a group, from some start states a group.

    Returns each lane's entry states and the counts before it, and each group's end states and counts.
    """
    first = np.cumsum(sizes) - sizes
    entry, before = (np.zeros((len(after), start.shape[1]), np.int64) for _ in range(2))
    state, total = start.astype(np.int64), np.zeros(start.shape, np.int64)
    for k in range(int(sizes.max(initial=0))):
        group = np.flatnonzero(sizes > k)
        lane, s = first[group] + k, state[group]
        entry[lane], before[lane] = s, total[group]
        total[group] += np.take_along_axis(count[lane], s, 1)
        state[group] = np.take_along_axis(after[lane], s, 1)
    return entry, before, state, total


class _Scan:
    """The lanes of some byte strings, scanned by both automata."""

    def __init__(self, own: Sequence[bytes], marks: Sequence[bytes]) -> None:
        lengths = np.array([len(t) for t in own], np.int64)
        self.sizes = -(-lengths // LANE_BYTES)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.lines, self.marks = line_automaton(), mark_automaton(marks)
        raw = np.zeros(int(self.sizes.sum()) * LANE_BYTES, np.uint8)
        filled = np.zeros(len(raw), bool)
        for t, at in zip(own, (self.first * LANE_BYTES).tolist(), strict=True):
            raw[at : at + len(t)] = np.frombuffer(t, np.uint8)
            filled[at : at + len(t)] = True
        self.chars = (filled & ((raw & 0xC0) != 0x80)).reshape(-1, LANE_BYTES)
        self.line_lanes = np.where(filled, self.lines.classes[raw], self.lines.pad).astype(np.int16).reshape(-1, LANE_BYTES)
        self.line_functions = self.lines.scan(self.line_lanes)
        mark_lanes = np.where(filled, self.marks.classes[raw], self.marks.pad).astype(np.int16).reshape(-1, LANE_BYTES)
        self.mark_functions = self.marks.scan(mark_lanes)

    def cuts(self, text: np.ndarray, rank: np.ndarray, entry: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point offsets at which unit ``rank`` + 1 of byte strings ``text`` begins.

        entry, before: of each lane, as ``fold`` gives them for the string's own start state.
        """
        lane = np.zeros(len(text), np.int64)
        for i, (t, r) in enumerate(zip(text.tolist(), rank.tolist(), strict=True)):
            own = before[self.first[t] : self.first[t] + self.sizes[t]]
            lane[i] = self.first[t] + np.searchsorted(own, r, "right") - 1
        inside = self.lines.select(self.line_lanes[lane], entry[lane].astype(np.int16), rank - before[lane])
        chars = np.concatenate([[0], np.cumsum(self.chars.sum(1))])
        partial = np.array([int(self.chars[x, :k].sum()) for x, k in zip(lane, inside, strict=True)], np.int64)
        return (lane - self.first[text]) * LANE_BYTES + inside, chars[lane] - chars[self.first[text]] + partial


def _output(text: bytes, form: str, a: int, b: int, marks: Sequence[bytes]) -> bytes:
    if form == "plain":
        return text
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def _forms(n, plain, draws, rate: int, spm: int):
    """The form, and after how many units each cut comes; numpy arrays of the documents."""
    form = np.where(plain | (draws[2] % 100 >= rate), "plain", np.where(draws[3] % 100 < spm, "spm", "psm"))
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    return form, np.minimum(one, two), np.maximum(one, two)


_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _rows(batch: pa.RecordBatch, n, form, chars, outputs) -> pa.RecordBatch:
    cut = form != "plain"
    low, high = chars
    columns = {
        "id": batch.column("id"),
        "n": pa.array(n, pa.int64()),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(low, pa.int64(), mask=~cut),
        "middle_chars": pa.array(high - low, pa.int64(), mask=~cut),
        "output": pa.array(outputs, pa.binary()).cast(pa.string()),
    }
    return pa.record_batch(columns)


def _short(marks: Sequence[bytes], rate: int, spm: int):
    """Whole documents: scan, fold, select and assemble, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [t or b"" for t in texts(batch)]
            scan = _Scan(own, marks)
            start = np.zeros((len(own), 1), np.int64)
            entry, before, _, n = fold(*scan.line_functions, scan.sizes, start)
            found = fold(*scan.mark_functions, scan.sizes, start)[2][:, 0] == scan.marks.states - 1
            n = n[:, 0]
            draws = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            form, *cuts = _forms(n, found | (n == 0), draws, rate, spm)
            whole_chars = np.array([int(scan.chars[a : a + k].sum()) for a, k in zip(scan.first, scan.sizes, strict=True)], np.int64)
            at, chars = [], []
            for cut in cuts:
                place, point = np.array([len(t) for t in own], np.int64), whole_chars.copy()
                inner = np.flatnonzero(cut < n)
                place[inner], point[inner] = scan.cuts(inner, cut[inner], entry[:, 0], before[:, 0])
                at.append(place.tolist())
                chars.append(point)
            outputs = [_output(*x, marks) for x in zip(own, form.tolist(), *at, strict=True)]
            yield _rows(batch, n, form, chars, outputs)

    return run


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                raw = memoryview(text.as_buffer())
                for at in range(0, len(raw), 64 * size):
                    pieces = [bytes(raw[x : x + size]) for x in range(at, min(at + 64 * size, len(raw)), size)]
                    places = pa.array(range(at // size, at // size + len(pieces)), pa.int32())
                    yield pa.record_batch(
                        {"row": pa.array([row] * len(pieces), pa.int64()), "chunk": places, "text": pa.array(pieces, pa.binary())}
                    )

    return run


def _functions(marks: Sequence[bytes]):
    """Each chunk's composed functions and counts for every start state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scan = _Scan(texts(batch), marks)
            every = lambda a: np.tile(np.arange(a.states), (batch.num_rows, 1))
            _, _, after, count = fold(*scan.line_functions, scan.sizes, every(scan.lines))
            _, _, mark, _ = fold(*scan.mark_functions, scan.sizes, every(scan.marks))
            chars = [int(scan.chars[a : a + k].sum()) for a, k in zip(scan.first, scan.sizes, strict=True)]
            yield pa.record_batch(
                {
                    "row": batch.column("row"),
                    "chunk": batch.column("chunk"),
                    "after": pa.array(after.tolist(), pa.list_(pa.int32())),
                    "units": pa.array(count.tolist(), pa.list_(pa.int64())),
                    "mark": pa.array(mark.tolist(), pa.list_(pa.int32())),
                    "chars": pa.array(chars, pa.int64()),
                }
            )

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry states and counts of chunks, which come by document and in order; a document carries two states and two sums."""
    row, state, mark, units, chars = None, 0, 0, 0, 0
    for batch in batches:
        out = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "after", "units", "mark", "chars")), strict=True):
            if r[0] != row:
                row, state, mark, units, chars = r[0], 0, 0, 0, 0
            here = r[3][state]
            mark = r[4][mark]
            out.append((row, r[1], state, units, here, chars, r[5], mark))
            state, units, chars = r[2][state], units + here, chars + r[5]
        names = ("row", "chunk", "entry", "before", "here", "chars_before", "chars", "mark")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)


def _giant(marks: Sequence[bytes], size: int):
    """Whole texts with the chunks of their cuts: select in those chunks, and assemble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, rows = texts(batch), batch.select([c for c in batch.schema.names if c != "text"]).to_pylist()
            outputs, chars = [], ([], [])
            for text, r in zip(own, rows, strict=True):
                at = []
                for cut, points in zip((r["low"], r["high"]), chars, strict=True):
                    if cut is None:
                        at.append(len(text))
                        points.append(r["chars"])
                        continue
                    start = cut["chunk"] * size
                    scan = _Scan([text[start : start + size]], marks)
                    entry, before, _, _ = fold(*scan.line_functions, scan.sizes, np.array([[cut["entry"]]]))
                    place, point = scan.cuts(np.zeros(1, np.int64), np.array([cut["rank"]]), entry[:, 0], before[:, 0])
                    at.append(start + int(place[0]))
                    points.append(cut["chars_before"] + int(point[0]))
                outputs.append(_output(text, r["form"], *at, marks))
            form = np.array([r["form"] for r in rows])
            yield _rows(batch, [r["n"] for r in rows], form, [np.array(x, np.int64) for x in chars], outputs)

    return run


def _giants(docs: DataFrame, scratch: Scratch, marks: Sequence[bytes], rate: int, spm: int) -> DataFrame:
    size = CHUNK_BYTES
    kept = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()))
    chunks = kept.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(_chunks(size), "row long, chunk int, text binary")
    functions = chunks.repartition("row", "chunk").mapInArrow(
        _functions(marks), "row long, chunk int, after array<int>, units array<long>, mark array<int>, chars long"
    )
    ordered = functions.repartition("row").sortWithinPartitions("row", "chunk")
    kinds = "row long, chunk int, entry int, before long, here long, chars_before long, chars long, mark int"
    resolved = scratch.save(ordered.mapInArrow(_resolve, kinds))
    found = mark_automaton(marks).states - 1
    whole = resolved.groupBy("row").agg(F.sum("here").alias("n"), F.sum("chars").alias("chars"), (F.max("mark") == found).alias("found"))
    one, two = (F.pmod(F.col(f"h{k}"), F.col("n") + 1) for k in (1, 2))
    form = F.when(F.col("found") | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    plan = kept.select("row", "h1", "h2", "h3", "h4").join(whole, "row")
    plan = plan.select("row", "n", "chars", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    cuts = resolved.drop("chars", "mark").join(plan, "row")
    held = {
        name: F.max(
            F.when(
                (F.col("before") <= F.col(cut)) & (F.col(cut) < F.col("before") + F.col("here")),
                F.struct("chunk", "entry", (F.col(cut) - F.col("before")).alias("rank"), "chars_before"),
            )
        ).alias(name)
        for name, cut in (("low", "a"), ("high", "b"))
    }
    cuts = scratch.save(cuts.groupBy("row", "n", "chars", "form").agg(*held.values()))
    met = kept.select("row", "id", "text").join(F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts, "row")
    return met.drop("row").mapInArrow(_giant(marks, size), f"id long, {_OUT}")


def fill_middle(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per input row: id_col, n (lines), form, prefix_chars, middle_chars, output (the transformed text).

    Lines end after their line feed; the last one may lack it. The hex SHA-256 of ``seed:id`` gives four 32-bit draws:
    two for the cuts, one against ``rate`` (percent of texts that are cut), one against ``spm`` (percent of these whose suffix
    comes first). Texts that are empty (null too) or hold a mark stay plain, without character counts. Rows that
    repeat an id are cut by the same draws; a null id draws as an empty one. An empty table gives no rows; other columns
    of ``documents`` are ignored. ``restored`` gives the text back.
    """
    scratch, raw = Scratch(documents.sparkSession, "fill-middle"), [m.encode() for m in marks]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    docs = documents.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws
    )
    giant = F.octet_length("text") > GIANT_BYTES
    short = docs.filter(~giant).mapInArrow(_short(raw, rate, spm), f"id long, {_OUT}")
    return short.unionByName(_giants(docs.filter(giant), scratch, raw, rate, spm)).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", marks: Sequence[str] = MARKS) -> Column:
    """The text that ``fill_middle`` transformed, from its output and form. No part of a cut text holds a mark."""
    out = F.col(output)

    def parted(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.length(head) + 1 + len(mark))

    p, s, m = marks
    prefix, rest = parted(F.substr(out, F.lit(1 + len(p))), s)
    suffix, middle = parted(rest, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = parted(F.substr(out, F.lit(1 + len(s))), p)
    prefix, middle = parted(rest, m)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", F.concat(prefix, middle, suffix)).otherwise(out)


def digest(documents: DataFrame, **options) -> DataFrame:
    """``fill_middle`` with digests of output and restored text in place of the texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_middle(documents, **options)
    marks = options.get("marks", MARKS)
    out = out.withColumn("output_sha256", sha(F.col("output"))).withColumn("restored_sha256", sha(restored(marks=marks)))
    return out.drop("output")
