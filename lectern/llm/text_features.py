"""Votes of heuristic labellers and hashed features of whole texts, computed over runs of many texts at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from lectern.llm.shingles import _LOWER, mix, span_hashes, word_spans

WORD_CELLS, SHAPE_CELLS, RANK_CELLS = 1 << 14, 1 << 13, 16
#: Cells of words, of word shapes, of how often a word has come before, and of words that repeat the one before.
DIMENSIONS = WORD_CELLS + SHAPE_CELLS + RANK_CELLS + 1

# Classes of bytes: lower and other letters, capitals, digits, symbols, other marks, blanks, bytes within a character.
_SMALL, _CAPITAL, _DIGIT, _SYMBOL, _MARK, _SPACE, _INNER = range(7)
_CLASS = np.full(256, _SMALL, np.uint8)
_CLASS[:128] = _MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _SMALL
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in "*$&%#@^~=_+"]] = _SYMBOL
_CLASS[0x80:0xC0] = _INNER
_CLASS[0xE2] = _MARK  # general punctuation
#: After 0xC3: the accented capitals of Latin-1.
_LATIN_CAPITAL = np.zeros(256, bool)
_LATIN_CAPITAL[0x80:0x9F] = True
_LATIN_CAPITAL[0x97] = False
_SHAPE_OF = np.frombuffer(b"aA0", np.uint8)

LABELLERS = (
    "symbol_runs", "symbols", "bangs", "bars", "marks", "repeats", "variety", "commonest", "capitals", "case", "word_length", "lines",
)


class Measures(NamedTuple):
    """Shares of a text's words (or lines, or letters) that the labellers judge, one array of documents each."""

    words: np.ndarray
    symbol_runs: np.ndarray
    symbols: np.ndarray
    bangs: np.ndarray
    bars: np.ndarray
    marks: np.ndarray
    repeats: np.ndarray
    variety: np.ndarray
    commonest: np.ndarray
    capitals: np.ndarray
    case: np.ndarray
    word_length: np.ndarray
    lines: np.ndarray


class Described(NamedTuple):
    """Votes (documents x labellers: 0 bad, 1 good, 2 abstains), and features as (row, index, value)."""

    votes: np.ndarray
    rows: np.ndarray
    indices: np.ndarray
    values: np.ndarray


def _votes(m: Measures) -> np.ndarray:
    """Each labeller's votes. A labeller abstains between its bounds and on texts too short for its measure."""
    n = m.words
    #: (measure, words it needs, bad from, good up to)
    rules = (
        (m.symbol_runs, 3, 0.10, 0.005), (m.symbols, 3, 0.03, 0.004), (m.bangs, 3, 0.10, 0.005), (m.bars, 3, 0.10, 0.005),
        (m.marks, 6, 0.12, 0.06), (m.repeats, 6, 0.25, 0.04), (1 - m.variety, 60, 0.85, 0.70), (m.commonest, 20, 0.30, 0.15),
        (m.capitals, 6, 0.30, 0.10), (m.case, 6, 0.35, 0.15), (np.abs(m.word_length - 8.25), 10, 6.75, 5.0), (m.lines, 1, 0.60, 0.20),
    )
    out = np.full((len(n), len(LABELLERS)), 2, np.int8)
    for k, (x, least, bad, good) in enumerate(rules):
        out[:, k] = np.where(n < least, 2, np.where(x >= bad, 0, np.where(x <= good, 1, 2)))
    return out


def describe(texts: Sequence[bytes], features: bool = True) -> Described:
    """Votes of each text and, if asked for, its features (square roots of shares of its words).

    A text without words gets no votes and no features.
    """
    docs = len(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_spans(raw)
    n_words = len(start)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    words = np.bincount(doc, minlength=docs)
    none = np.zeros(0, np.int64)
    if not n_words:
        return Described(np.full((docs, len(LABELLERS)), 2, np.int8), none, none, none.astype(float))
    kind = _CLASS[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & _LATIN_CAPITAL[raw[1:]])
    kind[latin] = _CAPITAL

    def within(flag: np.ndarray) -> np.ndarray:
        """How many bytes of each word have the flag."""
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return total[end] - total[start]

    def share(x: np.ndarray, of: np.ndarray = words) -> np.ndarray:
        return np.bincount(doc, x, docs) / np.maximum(of, 1)

    capitals, small, symbols = within(kind == _CAPITAL), within(kind == _SMALL), within(kind == _SYMBOL)
    letters, marks, chars = capitals + small, within(kind == _MARK) + symbols, within(kind != _INNER)
    symbol = kind == _SYMBOL
    back = [np.maximum(end - k, 0) for k in (1, 2, 3)]
    run = (end - start >= 3) & symbol[back[0]] & symbol[back[1]] & symbol[back[2]]
    bang = np.concatenate([(raw[:-1] == 33) & (raw[1:] == 33), [False]])
    hashes = span_hashes(_LOWER[raw], start, end)[0]
    together = np.concatenate([[False], doc[1:] == doc[:-1]])
    repeat = together & np.concatenate([[False], hashes[1:] == hashes[:-1]])
    # Occurrences: equal words of a document stand side by side after a stable sort.
    key = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.flatnonzero(first)
    sizes = np.diff(np.append(group, n_words))
    rank = np.empty(n_words, np.int64)
    rank[order] = np.arange(n_words) - np.repeat(group, sizes)
    distinct = np.bincount(doc[order[group]], minlength=docs)
    commonest = np.zeros(docs, np.int64)
    np.maximum.at(commonest, doc[order[group]], sizes)
    # Lines with words: a hash over their words in order.
    line = np.cumsum(raw == 10, dtype=np.int64)[start]
    begins = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | ~together[1:]]))
    place = np.arange(n_words) - np.repeat(begins, np.diff(np.append(begins, n_words)))
    of_line = np.add.reduceat(mix(hashes + mix(place.astype(np.uint64))), begins)
    line_doc = doc[begins]
    line_key = np.unique(mix(of_line) ^ mix(line_doc.astype(np.uint64) + np.uint64(7)), return_index=True)[1]
    lines = np.bincount(line_doc, minlength=docs)
    size = np.bincount(doc, chars, docs)
    votes = _votes(
        Measures(
            words=words,
            symbol_runs=share(run),
            symbols=share(symbols, size),
            bangs=share(within(bang) > 0),
            bars=share(within(raw == ord("|")) > 0),
            marks=share(marks, size),
            repeats=share(repeat),
            variety=distinct / np.maximum(words, 1),
            commonest=commonest / np.maximum(words, 1),
            capitals=share((letters > 1) & (capitals == letters)),
            case=share(capitals, np.bincount(doc, letters, docs)),
            word_length=share(letters),
            lines=1 - np.bincount(line_doc[line_key], minlength=docs) / np.maximum(lines, 1),
        )
    )
    if not features:
        return Described(votes, none, none, none.astype(float))
    # Shapes: letters and digits in a row count once, other characters stand for themselves.
    letter = kind <= _DIGIT
    whole = np.flatnonzero((kind != _INNER) & (kind != _SPACE))
    k, own = kind[whole], np.searchsorted(start, whole, "right")
    same = np.concatenate([[False], letter[whole[1:]] & (k[1:] == k[:-1]) & (own[1:] == own[:-1])])
    kept = whole[~same]
    shape = np.where(letter[kept], _SHAPE_OF[np.minimum(kind[kept], 2)], raw[kept])
    cuts = np.searchsorted(kept, np.append(start, len(raw)))
    shapes = span_hashes(shape, cuts[:-1], cuts[1:])[0]
    tail = WORD_CELLS + SHAPE_CELLS
    cells = np.concatenate(
        [
            (hashes % np.uint64(WORD_CELLS)).astype(np.int64),
            (shapes % np.uint64(SHAPE_CELLS)).astype(np.int64) + WORD_CELLS,
            np.minimum(np.frexp(rank + 1.0)[1] - 1, RANK_CELLS - 1) + tail,
            np.full(int(repeat.sum()), tail + RANK_CELLS),
        ]
    )
    rows = np.concatenate([doc, doc, doc, doc[repeat]])
    pairs, counts = np.unique(rows * DIMENSIONS + cells, return_counts=True)
    rows = pairs // DIMENSIONS
    return Described(votes, rows, pairs % DIMENSIONS, np.sqrt(counts / words[rows]))
