"""Counting quotient filters that lose nothing.

A key of a fixed number of bits is permuted invertibly, so that keys of any pattern spread evenly. Of the permuted key,
counted from the start of the filter's range, the high bits are the quotient, which is not stored but told by the place
in a unary bit vector, and all other bits are the remainder, which is stored whole. With the inverse permutation every
key comes back exactly, so the counters are exact too. Filters of one range merge in their sorted order.

Keys of up to 128 bits are two arrays of 64-bit values, high (or None up to 64 bits) and low. The permuted key is
ordered by its low part first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
_ROUNDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)  # odd factors
_HEAD = struct.Struct("<BBBQQQ")


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(factor)
    return x ^ (x >> U(32))


class Permutation:
    """An invertible map of keys of `bits` bits onto themselves."""

    def __init__(self, bits: int):
        self.bits, self.low_bits, self.high_bits = bits, min(bits, 64), max(0, bits - 64)

    def forward(self, high, low):
        if high is not None:
            for factor in _ROUNDS:
                high = high ^ (_mixed(low, factor) & _mask(self.high_bits))
                low = low ^ _mixed(high, factor ^ 0xFF00)
            return high, low
        shift, keep = U((self.bits + 1) // 2), _mask(self.bits)
        low = low.copy()
        for factor in _ROUNDS:
            low *= U(factor)
            low &= keep
            low ^= low >> shift
        return None, low

    def inverse(self, high, low):
        if high is not None:
            for factor in reversed(_ROUNDS):
                low = low ^ _mixed(high, factor ^ 0xFF00)
                high = high ^ (_mixed(low, factor) & _mask(self.high_bits))
            return high, low
        shift, keep = U((self.bits + 1) // 2), _mask(self.bits)
        for factor in reversed(_ROUNDS):
            low = low ^ (low >> shift)
            low = (low * U(pow(factor, -1, 1 << 64))) & keep
        return None, low


def pack_ids(ids: list[np.ndarray], id_bits: int):
    """(high, low) keys of ids laid one beside the other, the first in the highest bits; at most 128 bits."""
    bits = id_bits * len(ids)
    low = np.zeros(len(ids[0]), U)
    high = np.zeros(len(ids[0]), U) if bits > 64 else None
    for i in ids:
        if high is not None:
            high = (high << U(id_bits)) | (low >> U(64 - id_bits))
        low = (low << U(id_bits)) | i.astype(U)
    return high, low


def unpack_ids(high, low, id_bits: int, n: int) -> list[np.ndarray]:
    out = []
    for _ in range(n):
        out.append(low & _mask(id_bits))
        low = low >> U(id_bits)
        if high is not None:
            low = low | (high << U(64 - id_bits))
            high = high >> U(id_bits)
    return out[::-1]


def counted(high, low, counts=None):
    """(high, low, count) of the distinct keys in permuted order; the arrays given may be used up."""
    if not len(low):
        return high, low, np.zeros(0, np.int64)
    if high is None and counts is None:
        low.sort()  # the caller's own array
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return None, low[first], np.diff(np.append(first, len(low)))
    order = np.argsort(low, kind="stable") if high is None else np.lexsort((high, low))
    low = low[order]
    fresh = low[1:] != low[:-1]
    if high is not None:
        high = high[order]
        fresh |= high[1:] != high[:-1]
    first = np.flatnonzero(np.concatenate([[True], fresh]))
    total = np.diff(np.append(first, len(low))) if counts is None else np.add.reduceat(counts[order], first)
    return None if high is None else high[first], low[first], total


def ranges(low_bits: int, parts: int) -> list[int]:
    """Where each of `parts` equal ranges of permuted low parts begins, and the end of the last."""
    return [(k << low_bits) // parts for k in range(parts + 1)]


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of each value: whole bytes as byte planes, the others as bit planes."""
    whole = bits // 8
    body = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:whole].tobytes()
    return body + b"".join(np.packbits((values >> U(k)).astype(np.uint8) & 1).tobytes() for k in range(8 * whole, bits))


def _from_planes(blob: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    whole = bits // 8
    body = np.zeros((n, 8), np.uint8)
    if whole:
        body[:, :whole] = np.frombuffer(blob, np.uint8, whole * n).reshape(whole, n).T
    out = body.view("<u8").ravel().astype(U)
    at, size = whole * n, (n + 7) // 8
    for k in range(8 * whole, bits):
        out |= np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(U) << U(k)
        at += size
    return out, at


class CountingFilter:
    """Distinct permuted keys of one range of low parts with their counts, ascending."""

    def __init__(self, bits: int, begin: int, end: int, high, low: np.ndarray, counts: np.ndarray):
        self.bits, self.begin, self.end = bits, begin, end
        self.high, self.low, self.counts = high, low, counts

    def to_bytes(self) -> bytes:
        n, width = len(self.low), max(1, (self.end - self.begin - 1).bit_length())
        rest = max(0, width - max(1, n).bit_length())  # bits of the remainder
        place = self.low - U(self.begin)
        quotient = (place >> U(rest)).astype(np.int64)
        unary = np.zeros(n + ((self.end - 1 - self.begin) >> rest) + 1, np.uint8)
        unary[quotient + np.arange(n)] = 1
        many = np.flatnonzero(self.counts >= 255)
        body = [np.packbits(unary).tobytes(), _planes(place & _mask(rest), rest)]
        if self.high is not None:
            body.append(_planes(self.high, max(0, self.bits - 64)))
        tail = np.minimum(self.counts, 255).astype(np.uint8).tobytes() + self.counts[many].astype("<i8").tobytes()
        head = _HEAD.pack(self.bits, rest, int(self.high is not None), self.begin, self.end - 1, n)
        return head + b"".join(body) + zlib.compress(tail, 1)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingFilter:
        bits, rest, wide, begin, last, n = _HEAD.unpack_from(blob)
        view = memoryview(blob)[_HEAD.size:]
        places = n + ((last - begin) >> rest) + 1
        size = (places + 7) // 8
        at = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, size), count=places))
        low = (at - np.arange(n)).astype(U) << U(rest)
        view = view[size:]
        remainder, used = _from_planes(view, n, rest)
        low = (low | remainder) + U(begin)
        view, high = view[used:], None
        if wide:
            high, used = _from_planes(view, n, max(0, bits - 64))
            view = view[used:]
        tail = zlib.decompress(view)
        counts = np.frombuffer(tail, np.uint8, n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(tail, "<i8", offset=n)
        return cls(bits, begin, last + 1, high, low, counts)

    def keys(self):
        """(high, low) of the keys as they were before the permutation, in the filter's order."""
        return Permutation(self.bits).inverse(self.high, self.low)

    def count_of(self, high, low: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the filter doesn't have it."""
        high, low = Permutation(self.bits).forward(high, low)
        at, end = np.searchsorted(self.low, low), np.searchsorted(self.low, low, side="right")
        out = np.zeros(len(low), np.int64)
        for k in range(int((end - at).max(initial=0))):  # keys of one low part: mostly one
            here = np.flatnonzero(at + k < end)
            same = here if high is None else here[self.high[at[here] + k] == high[here]]
            out[same] = self.counts[at[same] + k]
        return out

    def split(self, edges: list[int]) -> list[tuple[int, CountingFilter]]:
        """(number, part) of each range between two edges in which the filter has keys."""
        cuts = [0, *np.searchsorted(self.low, np.array(edges[1:-1], U)).tolist(), len(self.low)]
        return [(k, CountingFilter(self.bits, edges[k], edges[k + 1], None if self.high is None else self.high[a:b],
                                   self.low[a:b], self.counts[a:b]))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]

    @classmethod
    def of(cls, bits: int, high, low: np.ndarray) -> CountingFilter:
        """All keys given, each as often as it is given."""
        permutation = Permutation(bits)
        return cls(bits, 0, 1 << permutation.low_bits, *counted(*permutation.forward(high, low)))

    @classmethod
    def merged(cls, filters: list[CountingFilter]) -> CountingFilter:
        """One filter with the summed counts; all are of one range."""
        first = filters[0]
        if len(filters) == 1:
            return first
        high = None if first.high is None else np.concatenate([f.high for f in filters])
        return cls(first.bits, first.begin, first.end, *counted(
            high, np.concatenate([f.low for f in filters]), np.concatenate([f.counts for f in filters])))
