"""Vectorised words, word hashes and word n-gram hashes of whole Arrow text columns.

A word is a maximal run of bytes that are not separators; separators and letter case are tables of 256
entries, so one pass of numpy over a batch gives the 64-bit hash of every word without a Python loop.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20  # bytes hashed at once: keeps the 8-byte work arrays small
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value over all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES:
        _TABLES["up"] = _powers(_ODD, PIECE + 1)
        _TABLES["down"] = _powers(pow(_ODD, -1, 1 << 64), PIECE + 1)
    return _TABLES["up"], _TABLES["down"]


class Alphabet:
    """Which bytes separate words, and what byte each byte counts as."""

    def __init__(self, separator: np.ndarray, folded: np.ndarray):
        self.separator, self.code = separator, _BYTE[folded]


def _lower() -> np.ndarray:
    low = np.arange(256)
    low[ord("A"):ord("Z") + 1] += 32
    return low


def blank_words() -> Alphabet:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    sep = np.zeros(256, bool)
    sep[[32, *range(9, 14)]] = True
    return Alphabet(sep, _lower())


def letter_words() -> Alphabet:
    """Runs of ASCII letters, digits and bytes of other scripts, A-Z lower-cased: punctuation separates."""
    sep = np.ones(256, bool)
    sep[128:] = False
    for a, b in ("az", "AZ", "09"):
        sep[ord(a):ord(b) + 1] = False
    return Alphabet(sep, _lower())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a text column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk is left, or none
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
    """(starts, ends, words per text): byte spans of all words; none crosses a text's end."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    inside = ~alphabet.separator[raw]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are ascending and apart."""
    up, down = _tables()
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        begin = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        if ends[upto - 1] - begin > PIECE:  # one word longer than a piece
            out[at] = _long(raw[begin:ends[at]], alphabet)
            at += 1
            continue
        piece = alphabet.code[raw[begin:ends[upto - 1]]]
        piece *= up[:len(piece)]
        total = np.empty(len(piece) + 1, U)
        total[0] = 0
        np.cumsum(piece, out=total[1:])
        a, b = starts[at:upto] - begin, ends[at:upto] - begin
        out[at:upto] = (total[b] - total[a]) * down[a] + U(_ODD) * (b - a).astype(U)
        at = upto
    return mix(out)


def _long(word: np.ndarray, alphabet: Alphabet) -> int:
    up, _ = _tables()
    total = 0
    for k in range(0, len(word), PIECE):
        part = alphabet.code[word[k:k + PIECE]]
        total += int((part * up[:len(part)]).sum(dtype=U)) * pow(_ODD, k, 1 << 64)
    return (total + _ODD * len(word)) % (1 << 64)


def words(column, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text)."""
    raw, offsets = utf8(column)
    starts, ends, counts = word_spans(raw, offsets, alphabet)
    return hash_spans(raw, starts, ends, alphabet), counts


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (n - 1 places fewer than words); texts are not kept apart."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U)
    factor = 1
    for k in range(n):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        out += h[k:k + m] * U(factor)
    return mix(out)


def gram_places(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the word array, text number) of the n-grams that lie within one text."""
    per = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    first = np.cumsum(counts) - counts
    inner = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return first[text] + inner, text


def release() -> None:
    """Give memory that is free back to the system: a worker lives on from task to task beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20):
    """The batches cut so that none holds over `most` bytes of text, one text at least in each."""
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(utf8(batch.column(column))[1]))
        a = 0
        while a < batch.num_rows:
            base = size[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
        del batch, size
    release()


def kept_columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as their first value and byte planes of the steps, planes of zeros left out."""
    if not len(a):
        return b""
    steps = np.diff(a)
    planes = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes]
    return bytes([planes]) + a[:1].astype("<u8").tobytes() + len(a).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    planes, n = blob[0], int.from_bytes(blob[9:17], "little")
    body = np.zeros((n, 8), np.uint8)
    if planes:
        body[1:, :planes] = np.frombuffer(blob, np.uint8, planes * (n - 1), 17).reshape(planes, n - 1).T
    out = body.view("<u8").ravel().astype(U)
    out[0] = np.frombuffer(blob, "<u8", 1, 1)[0]
    return np.cumsum(out, dtype=U)


def run_starts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])


def by_text(text: np.ndarray, texts: int) -> np.ndarray:
    """A stable order by text number: radix sort where the numbers fit 16 bits."""
    return np.argsort(text.astype(np.uint16) if texts <= 1 << 16 else text, kind="stable")


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of hash values begins in an ascending array (buckets + 1 places)."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U)
    inner = np.searchsorted(sorted_hashes, edges)
    return np.concatenate([[0], inner, [len(sorted_hashes)]])


def pack_small(a: np.ndarray) -> bytes:
    """Values under 2^32 as byte planes, planes of zeros left out."""
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([planes]) + a.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes].tobytes()


def unpack_small(blob: bytes) -> np.ndarray:
    planes = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 4), np.uint8)
    out[:, :planes] = body.T
    return out.view("<u4").ravel()


def pack_counts(a: np.ndarray) -> bytes:
    """Counts of any size, most of them small, in the fewest bytes that a quick entropy coder gives."""
    planes = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    body = a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes].tobytes()
    return zlib.compress(bytes([planes]) + body, 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    body = zlib.decompress(blob)
    planes = body[0]
    body = np.frombuffer(body, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 4 if planes <= 4 else 8), np.uint8)
    out[:, :planes] = body.T
    return out.view("<u4" if planes <= 4 else "<u8").ravel()


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, which of them each value is, how often each occurs)."""
    order = np.argsort(h)
    begin = run_starts(h[order])
    times = np.diff(np.append(begin, len(h)))
    which = np.empty(len(h), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), times)
    return h[order[begin]], which, times
