"""A wavelet matrix over token ids: succinct bit planes with rank and select, unpacked frame by frame."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WVM2"
_BLOCK = 512  # bits between the stored ranks
_WORDS = _BLOCK // 64
_FRAME = 256  # blocks of a compressed frame: 16 KB of bits and 1 KB of ranks
_HEAD = "<4sQIII"


class BitPlane:
    """Packed bits with the number of ones before each block of 512, in frames that are unpacked when they are asked for."""

    def __init__(self, frames: list, n: int) -> None:
        self.frames, self.n = frames, n  # a frame is compressed bytes, or its words and ranks

    @classmethod
    def pack(cls, bits: np.ndarray) -> BitPlane:
        n = len(bits)
        blocks = n // _BLOCK + 1
        raw = np.zeros(blocks * _BLOCK // 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        words = raw.view("<u8")
        ones = np.bitwise_count(words).reshape(blocks, _WORDS).sum(1, dtype=np.int64)
        ranks = (ones.cumsum() - ones).astype("<u4")
        cuts = range(0, blocks, _FRAME)
        return cls([(words[a * _WORDS : (a + _FRAME) * _WORDS], ranks[a : a + _FRAME]) for a in cuts], n)

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        f = self.frames[k]
        if not isinstance(f, tuple):
            raw = zstandard.ZstdDecompressor().decompress(f)
            blocks = len(raw) // (8 * _WORDS + 4)
            f = np.frombuffer(raw, "<u8", blocks * _WORDS), np.frombuffer(raw, "<u4", blocks, 8 * _WORDS * blocks)
            self.frames[k] = f
        return f

    def packed(self) -> list[bytes]:
        return [
            zstandard.ZstdCompressor(level=1).compress(f[0].tobytes() + f[1].tobytes()) if isinstance(f, tuple) else bytes(f)
            for f in self.frames
        ]

    def bits(self) -> np.ndarray:
        words = np.concatenate([self.frame(k)[0] for k in range(len(self.frames))])
        return np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def _by_frame(self, at: np.ndarray):
        """(which, words, ranks, places in the frame) for each frame that the positions touch."""
        frame = at // (_BLOCK * _FRAME)
        for k in np.unique(frame):
            which = np.flatnonzero(frame == k)
            yield which, *self.frame(int(k)), at[which] - k * _BLOCK * _FRAME

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for which, words, _, x in self._by_frame(at):
            out[which] = (words[x >> 6] >> (x & 63).astype(np.uint64)).astype(np.int64) & 1
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0..n)."""
        out = np.zeros(len(at), np.int64)
        for which, words, ranks, x in self._by_frame(at):
            block, word = x // _BLOCK, x >> 6
            ones = ranks[block].astype(np.int64)
            first = block * _WORDS
            for k in range(_WORDS - 1):  # the whole words between the block's start and the position
                ones += np.where(first + k < word, np.bitwise_count(words[first + k]), 0)
            left = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
            out[which] = ones + np.bitwise_count(words[word] & left)
        return out

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The position of the k-th (from 0) one or zero, by binary search on ranks."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            ones = self.rank(mid + 1)
            enough = (ones if bit else mid + 1 - ones) > k
            high, low = np.where(enough & (low < high), mid, high), np.where(~enough & (low < high), mid + 1, low)
        return low


class WaveletMatrix:
    """Access, counting and lookup of tokens; ids are coded by their rank among the distinct ids."""

    def __init__(self, alphabet: np.ndarray, planes: list[BitPlane], zeros: list[int], n: int) -> None:
        self.alphabet, self.planes, self.zeros, self.n = alphabet, planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        code_of = np.cumsum(present).astype(np.int64) - 1
        codes = code_of[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes, zeros = [], []
        for level in reversed(range(max(0, (len(alphabet) - 1).bit_length()))):
            bits = (codes >> level & 1).astype(bool)
            planes.append(BitPlane.pack(bits))
            low = codes[~bits]
            zeros.append(len(low))
            codes = np.concatenate([low, codes[bits]])
        return cls(alphabet, planes, zeros, len(ids))

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes' stable partitions undone from the last plane to the first."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits, back = plane.bits(), np.empty_like(codes)
            back[~bits] = codes[:zeros]
            back[bits] = codes[zeros:] | codes.dtype.type(1 << level)
            codes = back
        return self.alphabet[codes] if self.n else np.zeros(0, np.uint32)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, code = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(at), plane.rank(at)
            code = code << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return self.alphabet[code]

    def _code(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def _range(self, code: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences in [start, end) stand after the last plane."""
        span = np.array([start, end], np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(span)
            span = zeros + ones if code >> (len(self.planes) - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        code = self._code(token)
        if code is None:
            return 0
        low, high = self._range(code, start, self.n if end is None else end)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, by select through the planes."""
        code = self._code(token)
        if code is None:
            return np.zeros(0, np.int64)
        low, high = self._range(code, 0, self.n)
        at = np.arange(low, high)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = code >> level & 1
            at = plane.select(at - zeros if bit else at, bit)
        return np.sort(at)

    def to_bytes(self) -> bytes:
        """Header, alphabet steps and zeros, the frames' sizes, then the frames, each compressed on its own."""
        frames = [f for p in self.planes for f in p.packed()]
        steps = np.diff(self.alphabet, prepend=np.uint32(0)).astype("<u4").tobytes()
        alphabet = zstandard.ZstdCompressor(level=1).compress(steps)
        head = struct.pack(_HEAD, _MAGIC, self.n, len(self.alphabet), len(self.planes), len(alphabet))
        sizes = np.array([len(f) for f in frames], "<u4").tobytes()
        return b"".join([head, alphabet, np.array(self.zeros, "<u8").tobytes(), sizes, *frames])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """A matrix over the file's bytes; access, counts and lookups unpack only the frames that they pass through."""
        magic, n, symbols, levels, size = struct.unpack_from(_HEAD, raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize(_HEAD)
        steps = zstandard.ZstdDecompressor().decompress(raw[at : at + size]) if symbols else b""
        alphabet = np.frombuffer(steps, "<u4").cumsum(dtype=np.uint32)
        at += size
        zeros = np.frombuffer(raw, "<u8", levels, at).astype(np.int64).tolist()
        at += 8 * levels
        per = -(-(n // _BLOCK + 1) // _FRAME)
        sizes = np.frombuffer(raw, "<u4", levels * per, at).astype(np.int64)
        ends = at + 4 * levels * per + sizes.cumsum()
        view = memoryview(raw)
        frames = [view[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        planes = [BitPlane(frames[k * per : (k + 1) * per], n) for k in range(levels)]
        return cls(alphabet, planes, zeros, n)
