"""Bits over the bytes of Arrow batches: packed into words, with a directory of ones, for rank and select."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of 64 bits in a block of the directory.
BLOCK = 8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: _NTH[byte, k]: the place of the (k + 1)-th one of a byte.
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class Bits:
    """A packed bitvector with rank and select on arrays of positions."""

    def __init__(self, bits: np.ndarray):
        words = -(-max(len(bits), 1) // (64 * BLOCK)) * BLOCK
        packed = np.zeros(words * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK).astype(np.int64)
        self.inside = np.concatenate([np.zeros((len(counts), 1), np.int64), counts.cumsum(1)[:, :-1]], axis=1)
        self.before = np.concatenate([[0], counts.sum(1).cumsum()])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position (from 0 to the length)."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        whole = word < len(self.words)
        w = np.where(whole, word, 0)
        low = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        found = self.before[w // BLOCK] + self.inside[w // BLOCK, w % BLOCK] + np.bitwise_count(low)
        return np.where(whole, found, self.before[-1])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one, k from 1 to the number of ones."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        word = (self.inside[block] < left[:, None]).sum(1) - 1
        left = left - self.inside[block, word]
        word += block * BLOCK
        eight = self.words.view(np.uint8).reshape(-1, 8)[word]
        upto = np.bitwise_count(eight).cumsum(1, dtype=np.int64)
        byte = (upto < left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(byte > 0, upto[row, byte - 1], 0)
        return word * 64 + byte * 8 + _NTH[eight[row, byte], left - 1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array without nulls, side by side, and where each begins and the last one ends."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size, start = int(offsets[-1] - offsets[0]), int(offsets[0])
    return np.frombuffer(texts.buffers()[2], np.uint8, size, start) if size else np.zeros(0, np.uint8), offsets - start
