"""A wavelet matrix: token ids as bit planes with rank and select, in one block of bytes.

Layout (little-endian): magic, planes, tokens, documents; zeros of each plane; for each plane its bits (8 to a byte,
the first in the lowest bit) and the running count of ones before every 512th bit; the first token of each document
as steps; the documents' numbers with a mask of those that have one. Plane 0 holds the highest bit of each id; each
next plane holds the next bit of the ids in the order that puts those with a 0 before those with a 1, else as before.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x314D5754
BLOCK = 512


def _bits(blob: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(blob, count=n, bitorder="little").view(bool)


def build(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, known: np.ndarray) -> bytes:
    """The file of `ids`, the documents' token counts in order, their numbers and which of them are known."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, body = [], []
    for p in range(planes - 1, -1, -1):
        packed = np.packbits(one := (now >> p & 1).astype(bool), bitorder="little")
        padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
        padded[:len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        directory = np.cumsum(ones, dtype=np.uint32)
        body += [packed.tobytes(), np.concatenate([np.zeros(1, np.uint32), directory]).tobytes()]
        low = now[~one]
        zeros.append(len(low))
        now = np.concatenate([low, now[one]])
    head = np.array([MAGIC, planes, len(ids), len(lengths), *zeros], "<u8")
    return b"".join([head.tobytes(), *body, lengths.astype("<u4").tobytes(), docs.astype("<i8").tobytes(),
                     np.packbits(known, bitorder="little").tobytes()])


class WaveletMatrix:
    """Reads a file made by `build`; nothing but the touched places is unpacked, save in `decode`."""

    def __init__(self, blob: bytes):
        raw = np.frombuffer(blob, np.uint8)
        magic, self.planes, self.n, self.documents = (int(x) for x in np.frombuffer(blob, "<u8", 4))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.zeros = np.frombuffer(blob, "<u8", self.planes, 32).astype(np.int64)
        at, width, blocks = 32 + 8 * self.planes, -(-self.n // 8), -(-self.n // BLOCK) + 1
        self.bits, self.ranks = [], []
        for _ in range(self.planes):
            self.bits.append(raw[at:at + width])
            self.ranks.append(np.frombuffer(blob, "<u4", blocks, at + width))
            at += width + 4 * blocks
        self.lengths = np.frombuffer(blob, "<u4", self.documents, at).astype(np.int64)
        at += 4 * self.documents
        self.docs = np.frombuffer(blob, "<i8", self.documents, at)
        self.known = _bits(raw[at + 8 * self.documents:], self.documents)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        begin = block * BLOCK // 8
        part = self.bits[plane][begin:-(-i // 8)]
        count = int(np.bitwise_count(part).sum())
        if i % 8:
            count -= int(np.bitwise_count(part[-1:] >> np.uint8(i % 8)).sum())
        return int(self.ranks[plane][block]) + count

    def _select(self, plane: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) bit of that value in a plane."""
        before = self.ranks[plane].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        begin = block * BLOCK
        part = _bits(self.bits[plane][begin // 8:], min(BLOCK, self.n - begin))
        return begin + int(np.flatnonzero(part == bool(bit))[j - before[block]])

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            bit = int(self.bits[p][i // 8] >> (i % 8)) & 1
            value = value << 1 | bit
            ones = self._rank1(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self._rank1(p, begin), self._rank1(p, end)
            if token >> (self.planes - 1 - p) & 1:
                begin, end = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs among the places [begin, end)."""
        if token >> self.planes:
            return 0
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def find(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of a token."""
        if token >> self.planes or not 0 <= j < self.count(token):
            raise IndexError("no such occurrence")
        i = self._range(token, 0, 0)[0] + j
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = _bits(self.bits[p], self.n)
            above = np.empty_like(values)
            z = self.zeros[p]
            above[~one] = values[:z]
            above[one] = values[z:] | values.dtype.type(1 << (self.planes - 1 - p))
            values = above
        return values
