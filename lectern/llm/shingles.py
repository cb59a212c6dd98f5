"""Hashed words and word shingles of whole texts, computed over byte arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

from lectern.llm.word_cache import WordCache

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Spans up to so many bytes are hashed in step, eight bytes at a time; longer ones are rare and go through BLAKE2b.
_STEPS = 8
_SEED = tuple(np.random.default_rng(20240501).integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_KEYS = np.random.default_rng(20240502).integers(0, 1 << 63, (2, _STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(20240503).integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


STEPPED_BYTES = 8 * _STEPS


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; beyond the end stand zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each span of bytes, as a (2, spans) table.

    Each eight bytes are keyed by their place and mixed into the state by a bijection; spans of one length up to eight
    bytes never collide. Longer spans can be built to collide, so what must tell all words apart uses ``WordDigests``.
    """
    out = np.empty((2, len(start)), np.uint64)
    if not len(start):
        return out
    eight = eights(raw)
    length = end - start
    short = np.flatnonzero(length <= STEPPED_BYTES)
    at, left = start[short], length[short]
    state = [mix(left.astype(np.uint64) + seed) for seed in _SEED]
    live = slice(None)
    for k in range(_STEPS):
        chunk = eight[at] & KEEP[np.minimum(left, 8)]
        for s, keys in zip(state, _KEYS, strict=True):
            s[live] = mix(s[live] ^ mix(chunk + keys[k]))
        on = left > 8
        if not on.any():
            break
        live = np.flatnonzero(on) if k == 0 else live[on]
        at, left = at[on] + 8, left[on] - 8
    out[0, short], out[1, short] = state
    if len(short) < len(start):
        whole = raw.tobytes()
        for i in np.flatnonzero(length > STEPPED_BYTES):
            digest = hashlib.blake2b(whole[start[i] : end[i]], digest_size=16).digest()
            out[:, i] = np.frombuffer(digest, "<u8")
    return out


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than the six ASCII blanks."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


_FINAL = np.zeros(256, bool)
_FINAL[[ord(c) for c in ".,;:!?"]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = True


def units(text: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes) of words, with one final mark after an ASCII letter as a unit of its own."""
    raw = np.frombuffer(text, np.uint8)
    small = _LOWER[raw]
    raw = small if lower else raw
    n = len(raw)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = _BLANK[raw]
    edge = blank[1:] != blank[:-1]
    if n > 1:
        mark = _FINAL[raw[1:]] & _ASCII_LETTER[small[:-1]] & blank[3:]
        cut = np.flatnonzero(mark) + 1
        at = np.concatenate([np.flatnonzero(edge), cut, cut])  # a cut ends one unit and starts the next
        at.sort(kind="stable")
    else:
        at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    return raw, start, end, span_hashes(raw, start, end)


#: Bytes of text whose words are hashed at once.
RUN_BYTES = 1 << 20


def runs(texts: Sequence[bytes | None], size: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, null as empty, in runs of about ``size`` bytes; a longer text is a run of its own."""
    run, filled = [], 0
    for t in texts:
        t = t or b""
        if run and filled + len(t) > size:
            yield run
            run, filled = [], 0
        run.append(t)
        filled += len(t)
    if run:
        yield run


_LOWER_TABLE = _LOWER.tobytes()
#: Words whose digests a task keeps, in each of two generations; longer words are digested each time.
CACHE_WORDS, CACHED_BYTES = 100_000, 64


class WordDigests:
    """BLAKE2b digests of words: 128 bits, with which nobody can build two words that look alike."""

    def __init__(self) -> None:
        self.cache = WordCache(lambda words: [hashlib.blake2b(w, digest_size=16).digest() for w in words], CACHE_WORDS)

    def all_of(self, words: list[bytes]) -> np.ndarray:
        """A (2, words) table of 64-bit numbers."""
        if max(map(len, words), default=0) > CACHED_BYTES:  # by a digest after a blank, which no word holds
            words = [w if len(w) <= CACHED_BYTES else b" " + hashlib.blake2b(w, digest_size=32).digest() for w in words]
        raw = b"".join(map(self.cache.all_of(words), words))
        return np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, 2).T)


def ranks(both: np.ndarray) -> np.ndarray:
    """Of the columns of a (2, n) table a number each, equal for equal columns alone, in their order."""
    order = np.argsort(both[0], kind="stable")
    ordered = both[:, order]
    fresh, other = (x[1:] != x[:-1] for x in ordered)
    if (other & ~fresh).any():  # first numbers collide: columns of one first number need their order too
        order = np.lexsort(both[::-1])
        fresh, other = (x[1:] != x[:-1] for x in both[:, order])
    out = np.empty(both.shape[1], np.int64)
    out[order] = np.concatenate([[0], np.cumsum(fresh | other)])[: both.shape[1]]
    return out


def _distinct(both: np.ndarray) -> np.ndarray:
    """The distinct columns of a (2, n) table, sorted."""
    both = both[:, np.argsort(both[0], kind="stable")]
    fresh = both[0, 1:] != both[0, :-1]
    if fresh.all():
        return both
    other = both[1, 1:] != both[1, :-1]
    if (other & ~fresh).any():
        both = both[:, np.lexsort(both[::-1])]
        fresh, other = (x[1:] != x[:-1] for x in both)
    return both[:, np.concatenate([[True], fresh | other])]


def shingle_sets(texts: Sequence[bytes | None], digests: WordDigests, words: int = 5) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """For each text the distinct digests of its runs of ``words`` words, as a sorted (2, n) table, and the set's digest.

    A text of fewer words gives its whole sequence as one shingle; no words or null give none, and no digest. A shingle's
    128 bits mix those of its words in their order, so sets are equal, and shingles common, only if their words are.
    """
    for run in runs(texts):
        own = [t.translate(_LOWER_TABLE).split() for t in run]
        w = digests.all_of([x for t in own for x in t])
        whole = max(0, w.shape[1] - words + 1)
        every = np.zeros((2, whole), np.uint64)
        for j in range(words if whole else 0):
            every = mix(every ^ (w[:, j : j + whole] + _PLACE[:, j : j + 1]))
        at = 0
        for n in map(len, own):
            to = at + n
            if not n:
                yield np.zeros((2, 0), np.uint64), None
                continue
            if n < words:
                both = np.zeros((2, 1), np.uint64)
                for j in range(n):
                    both = mix(both ^ (w[:, at + j : at + j + 1] + _PLACE[:, j : j + 1]))
                both = mix(both + np.uint64(n))
            else:
                both = _distinct(every[:, at : to - words + 1])
            at = to
            yield both, hashlib.blake2b(both.tobytes(), digest_size=16).digest()
