"""Elias-Fano n-gram trie: monotone sequences in compact levels over one buffer.

Words are numbers below a universe W. Level 1 holds the first words, level 2 the
bigrams as (rank of the first word) * W + word, level 3 the trigrams as (rank of
the bigram) * W + word: each one a monotone sequence, whose high part is the
pointer to the parent, so a child is found by a successor search inside its
context. Elias-Fano packs the low bits and writes the high bits in unary, with a
small directory of zeros every 16 bytes; nothing is unpacked when a trie is
opened. Probabilities are quantised to 16 bits. The buffer may be a file's map
or an anonymous one.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Steps of one log10 unit in a quantised value.
STEP = 4096
#: The value of an n-gram that the trie doesn't hold.
UNSEEN = 65535
_BLOCK = 16
_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th zero of a byte.
_ZERO_AT = np.array([([i for i in range(8) if not b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def quantise(log10: np.ndarray) -> np.ndarray:
    """Negative log10 values, in 1/STEP."""
    return np.clip(np.rint(-log10 * STEP), 0, UNSEEN - 1).astype("<u2")


def restore(values: np.ndarray) -> np.ndarray:
    """The numbers themselves; 0 for what is unseen."""
    return np.where(values == UNSEEN, 0.0, 10.0 ** (values.astype(np.float64) / -STEP))


class EliasFano:
    """A monotone sequence of n different values below ``universe``."""

    def __init__(self, buffer, at: int):
        self.n, self.universe, self.width, blocks, self.end = np.frombuffer(buffer, "<i8", 5, at).tolist()
        at += 40
        size = (self.n * self.width + 7) // 8 + 8
        self.low = np.frombuffer(buffer, np.uint8, size, at)
        self.high = np.frombuffer(buffer, np.uint8, blocks * _BLOCK, at + size).reshape(blocks, _BLOCK)
        self.before = np.frombuffer(buffer, "<u4", blocks, at + size + blocks * _BLOCK)

    @staticmethod
    def code(values: np.ndarray, universe: int, at: int) -> bytes:
        """Bytes to be placed at offset ``at`` of the buffer."""
        n = len(values)
        values = np.asarray(values, np.int64)
        low = max(0, min(48, int(universe // max(1, n)).bit_length() - 1))
        packed = np.zeros((n * low + 7) // 8 + 8, np.uint8)
        for a in range(0, n, 1 << 17) if low else ():
            part = values[a : a + (1 << 17)]
            got = np.packbits(((part[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel(), bitorder="little")
            packed[a * low // 8 : a * low // 8 + len(got)] = got
        unary = np.zeros(-(-(n + (universe >> low) + 1) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
        unary[(values >> low) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").reshape(-1, _BLOCK)
        zeros = _ZEROS[high].sum(1, dtype=np.int64)
        before = (np.cumsum(zeros) - zeros).astype("<u4")
        body = packed.tobytes() + high.tobytes() + before.tobytes()
        pad = -len(body) % 8
        return np.array([n, universe, low, len(high), at + 40 + len(body) + pad], "<i8").tobytes() + body + bytes(pad)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.width + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _ones(self, k: np.ndarray) -> np.ndarray:
        """Values whose high part is at most k: the ones before the k-th zero (none for k = -1)."""
        out = np.zeros(len(k), np.int64)
        for a in range(0, len(k), 1 << 18):
            q = np.maximum(k[a : a + (1 << 18)], 0)
            block = np.searchsorted(self.before, q.astype(self.before.dtype), "right") - 1
            left = q - self.before[block]
            bits = self.high[block]
            upto = np.cumsum(_ZEROS[bits], axis=1, dtype=np.uint8)
            byte = (upto <= left[:, None].astype(np.uint8)).sum(1)
            rows = np.arange(len(q))
            left -= np.where(byte > 0, upto[rows, byte - 1], 0)
            out[a : a + len(q)] = np.where(k[a : a + len(q)] < 0, 0, block * (8 * _BLOCK) + byte * 8 + _ZERO_AT[bits[rows, byte], left] - q)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Successor search: the index of each x in the sequence, or -1 if its successor is another value."""
        if not self.n:
            return np.full(len(x), -1)
        inside = (x >= 0) & (x < self.universe)
        x = np.where(inside, x, 0)
        high = x >> self.width
        at, stop = self._ones(high - 1), self._ones(high)
        want, end = x & ((1 << self.width) - 1), stop.copy()
        while len(open_ := np.flatnonzero(at < end)):
            mid = (at[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            at[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        found = inside & (at < stop)
        found[found] = self._low(at[found]) == want[found]
        return np.where(found, at, -1)


class Trie:
    """Bigrams and trigrams with quantised probabilities. words: the universe of word numbers."""

    @staticmethod
    def pack(words: int, bi: tuple[np.ndarray, np.ndarray, np.ndarray], tri: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
        """bi: first word, last word and log10 probability of every bigram, in order (probability -inf: only a context). tri: rank of the bigram, last word and log10 probability of every trigram, in order."""
        first, rank = np.unique(bi[0], return_inverse=True)
        out = np.array([words, len(bi[0]), len(tri[0]), 0], "<i8").tobytes()
        for values, universe in ((first, words), (rank * words + bi[1], len(first) * words), (tri[0] * words + tri[1], len(bi[0]) * words)):
            out += EliasFano.code(values, max(1, universe), len(out))
        for level in (bi[2], tri[2]):
            q = quantise(np.where(np.isfinite(level), level, 0.0))
            q[~np.isfinite(level)] = UNSEEN
            out += q.tobytes()
        return out

    def __init__(self, buffer):
        self.words, bigrams, trigrams, _ = np.frombuffer(buffer, "<i8", 4).tolist()
        self.first = EliasFano(buffer, 32)
        self.second = EliasFano(buffer, self.first.end)
        self.third = EliasFano(buffer, self.second.end)
        self.p2 = np.frombuffer(buffer, "<u2", bigrams, self.third.end)
        self.p3 = np.frombuffer(buffer, "<u2", trigrams, self.third.end + 2 * bigrams)

    def context(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of bigrams, or -1."""
        rank = self.first.find(a)
        return self.second.find(np.where((rank >= 0) & (b >= 0) & (b < self.words), rank * self.words + b, -1))

    def bigrams(self, node: np.ndarray) -> np.ndarray:
        return _taken(self.p2, node)

    def trigrams(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Quantised probabilities of c after the contexts with these ranks."""
        return _taken(self.p3, self.third.find(np.where((node >= 0) & (c >= 0) & (c < self.words), node * self.words + c, -1)))


def _taken(level: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, level[np.maximum(at, 0)], UNSEEN).astype("<u2") if len(level) else np.full(len(at), UNSEEN, "<u2")


def mapped(blob: bytes) -> Trie:
    """A trie over an anonymous memory map: nothing stays on a local disk."""
    room = mmap.mmap(-1, max(1, len(blob)))
    room.write(blob)
    return Trie(memoryview(room))
