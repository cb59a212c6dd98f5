"""Edit-aware token counts: a segment tree of pre-tokens per document.

A leaf is a run of ``LEAF`` pre-tokens with its characters and tokens; inner nodes hold sums. An edit re-encodes the
leaves that it touches, from a boundary that the edit can't move (two characters of context on the left, what the
pattern looks ahead) up to the first old leaf boundary that is a pre-token boundary again, and then updates the sums on
the paths to the root. The rest of the document isn't encoded again.

Trees are kept: ``build_trees`` encodes documents once and gives a table of them, ``apply_edits`` takes rows of that table
with edits and gives the edited rows, which are written and edited again later on. A row holds the document's text and
the sums of all nodes in heap order (node 1 is the root), so counts are read from the table without any encoding.

Texts that spell a special token are counted as plain text (the tokenizer's ``encode_special_tokens``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import slices
from lectern.llm.scratch import Scratch

LEAF = 32
CACHE_PIECES = 500_000
#: How far beyond a pre-token's end the pattern may look.
_LOOKAHEAD = 2


class PieceCounter:
    """Tokens of pre-tokens, with a bounded cache."""

    def __init__(self, path: str) -> None:
        import os

        import public_tokenizers
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.cache: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        try:
            return list(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > CACHE_PIECES:
            cache.clear()
        missing = list(set(pieces).difference(cache))
        coded = self.tokenizer.encode_batch(missing, add_special_tokens=False)
        cache.update((p, len(e.ids)) for p, e in zip(missing, coded, strict=True))
        return list(map(cache.__getitem__, pieces))


class TokenTree:
    """Leaves of pre-tokens with sums of characters and tokens; node 1 is the root, leaf i is node size + i."""

    def __init__(self, text: str, counter: PieceCounter) -> None:
        pieces = counter.pieces(text)
        counts = counter.counts(pieces)
        leaves = ["".join(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        starts = np.arange(0, max(1, len(counts)), LEAF)
        self._plant(counter, leaves, np.add.reduceat(counts, starts) if counts else np.zeros(0, np.int64))
        self.encoded = 0

    @classmethod
    def kept(cls, text: str, chars: np.ndarray, tokens: np.ndarray, counter: PieceCounter) -> TokenTree:
        """A tree from its kept sums; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded, tree.size = counter, 0, len(chars) // 2
        tree.sums = np.stack([chars, tokens], 1).astype(np.int64)
        ends = tree.sums[tree.size :, 0].cumsum()
        n = max(1, int(np.searchsorted(ends, ends[-1])) + 1)  # empty leaves at the end are no loss
        bounds = [0, *ends[:n].tolist()]
        tree.texts = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return tree

    def _plant(self, counter: PieceCounter, leaves: list[str], tokens: np.ndarray) -> None:
        self.counter, self.texts = counter, leaves or [""]
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(self.texts), 0] = [len(t) for t in self.texts]
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        at = self.size
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(-1, 2, 2).sum(1)
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        leaf = min(node - self.size, len(self.texts) - 1)
        return leaf, before if leaf == node - self.size else int(self.sums[1, 0]) - len(self.texts[leaf])

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replaces ``length`` characters from ``start`` on; positions are clipped to the text."""
        total = int(self.sums[1, 0])
        start = min(max(start, 0), total)
        length = min(max(length, 0), total - start)
        first, before = self._leaf_at(max(0, start - _LOOKAHEAD))
        while first and len(self.texts[first]) == 0:  # leaves may have become empty
            first -= 1
            before -= len(self.texts[first])
        if first and start - before < _LOOKAHEAD:
            first -= 1
            before -= len(self.texts[first])
        last, _ = self._leaf_at(max(start, start + length - 1))
        last = max(first, last)
        while True:
            old = "".join(self.texts[first : last + 1])
            own = old[: start - before] + insert + old[start - before + length :]
            beyond, ahead = last + 1, ""
            while beyond < len(self.texts) and len(ahead) < 4 * _LOOKAHEAD:
                ahead += self.texts[beyond]
                beyond += 1
            pieces, at, kept = self.counter.pieces(own + ahead), 0, 0
            while kept < len(pieces) and at < len(own):
                at += len(pieces[kept])
                kept += 1
            if at == len(own) or not ahead:
                break
            last += 1
        pieces = pieces[:kept]
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        leaves = last - first + 1
        share = -(-len(pieces) // leaves) or 1
        if share > 2 * LEAF:  # more text than the leaves should hold: the tree gets new ones, without encoding
            cuts = range(0, len(pieces), LEAF)
            own = self.sums[self.size : self.size + len(self.texts), 1]
            new = ["".join(pieces[i : i + LEAF]) for i in cuts]
            sums = [sum(counts[i : i + LEAF]) for i in cuts]
            self._plant(
                self.counter, [*self.texts[:first], *new, *self.texts[last + 1 :]], np.concatenate([own[:first], sums, own[last + 1 :]])
            )
            return
        for k in range(leaves):
            span = slice(k * share, (k + 1) * share)
            self._set(first + k, "".join(pieces[span]), sum(counts[span]))


@functools.lru_cache(2)
def _counter(name: str) -> PieceCounter:
    return PieceCounter(SparkFiles.get(name))


_TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


def _build(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in slices(batches):
            trees = [TokenTree(t or "", counter) for t in batch.column("text").to_pylist()]
            yield _rows(batch, trees)

    return run


def _rows(batch: pa.RecordBatch, trees: list[TokenTree], *more: tuple[str, list[int]]) -> pa.RecordBatch:
    columns = {
        "doc_id": batch.column("doc_id"),
        "text": pa.array([t.text for t in trees], pa.string()),
        "chars": pa.array([t.sums[:, 0].astype(np.int32) for t in trees], pa.list_(pa.int32())),
        "tokens": pa.array([t.sums[:, 1].astype(np.int32) for t in trees], pa.list_(pa.int32())),
    }
    return pa.record_batch(columns | {name: pa.array(x, pa.int64()) for name, x in more})


def build_trees(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree per row: doc_id, text (null as empty), chars and tokens (sums of all nodes; element 1 is the root).

    To be written by the caller: ``apply_edits`` and ``counts`` work on what is read back. Repeated rows and null ids give
    trees of their own; an empty table gives no rows; other columns are ignored.
    """
    name = _ship(documents, tokenizer_path)
    kept = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_build(name), _TREE)


def counts(trees: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_tokens, from the trees' roots."""
    return trees.select("doc_id", _root("chars").alias("n_chars"), _root("tokens").alias("n_tokens"))


def _root(sums: str) -> Column:
    return F.get(F.col(sums), F.lit(1)).cast("long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with ``edits``, for an edit table of doc_id, seq, start, length, insert; null for documents without any."""
    edit = F.struct("seq", F.struct("start", "length", "insert").alias("e"))
    per = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(edit)), lambda x: x["e"]).alias("edits"))
    return trees.join(per, "doc_id", "left")


_EDITS = "array<struct<start:int,length:int,insert:string>>"


def _edit(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in slices(batches):
            trees, done = [], []
            columns = (batch.column(c) for c in ("text", "chars", "tokens", "edits"))
            for text, chars, tokens, edits in zip(*columns, strict=True):
                tree = TokenTree.kept(text.as_py(), chars.values.to_numpy(), tokens.values.to_numpy(), counter)
                own = [e for e in edits.as_py() or () if e is not None]
                for e in own:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                trees.append(tree)
                done.append(len(own))
            yield _rows(batch, trees, ("n_edits", done), ("n_reencoded", [t.encoded for t in trees]))

    return run


def apply_edits(trees: DataFrame, tokenizer_path: str, edits_col: str = "edits") -> DataFrame:
    """The trees after their edits, with ``n_edits`` and ``n_reencoded`` (pre-tokens that the edits encoded anew).

    ``edits_col``: array of (start, length, insert) in code points, applied in order; each sees the text that the last one
    left. Positions are clipped, nulls count as 0 or empty, null edits are skipped.
    """
    name = _ship(trees, tokenizer_path)
    edits = F.col(edits_col).cast(_EDITS)
    return trees.select("doc_id", "text", "chars", "tokens", edits.alias("edits")).mapInArrow(
        _edit(name), f"{_TREE}, n_edits long, n_reencoded long"
    )


def _ship(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _edit_counts(name: str):
    """As ``_edit``, for counts alone: the edited trees stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def before(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in given:
                seen.append(batch.select(["n_chars", "n_tokens"]))
                yield batch

        seen: list[pa.RecordBatch] = []
        for edited in _edit(name)(before(slices(batches))):
            was = seen.pop(0)
            roots = {c: pa.array([x.values[1].as_py() for x in edited.column(c)], pa.int64()) for c in ("chars", "tokens")}
            own = {c: edited.column(c) for c in ("doc_id", "n_edits", "n_reencoded")}
            after = {"n_chars_after": roots["chars"], "n_tokens_after": roots["tokens"]}
            yield pa.record_batch(own | {c: was.column(c) for c in ("n_chars", "n_tokens")} | after)

    return run


def count_edited(trees: DataFrame, tokenizer_path: str, edits_col: str = "edits") -> DataFrame:
    """Counts before and after each row's edits: doc_id, n_edits, n_reencoded, n_chars, n_tokens, n_chars_after,
    n_tokens_after. Edits are as in ``apply_edits``."""
    name = _ship(trees, tokenizer_path)
    own = trees.select(
        "doc_id", "text", "chars", "tokens", F.col(edits_col).cast(_EDITS).alias("edits"), _root("chars").alias("n_chars"),
        _root("tokens").alias("n_tokens"),
    )
    schema = "doc_id long, n_edits long, n_reencoded long, n_chars long, n_tokens long, n_chars_after long, n_tokens_after long"
    return own.mapInArrow(_edit_counts(name), schema)


def saved_trees(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees of all documents, written to the shared folder and read back."""
    return Scratch(documents.sparkSession, "token-trees").save(build_trees(documents, tokenizer_path, id_col, text_col))
