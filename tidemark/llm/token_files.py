"""Token ids of documents as files of wavelet matrices, and what can be read from them.

Documents go by ascending id (rows without an id first; rows that share an id by a hash of their text) to range
partitions. Each task encodes its texts and cuts them, between documents, into shards of about `SHARD` tokens; a
shard is one wavelet matrix, a binary field of one row of the written Parquet table, beside its partition and the
tokens of the partition before it. A null or empty text has the end id alone.

Encoding: white space never lies inside a token of the given tokenizer, nor does a change between a letter or digit
and other ASCII signs. So texts are cut there into pieces, each distinct piece is encoded once, and its ids are put
wherever the piece stands. Signs that may join what follows (the apostrophe, those of special tokens) cut nothing,
nor do other signs beyond ASCII. Pieces are told apart by 64-bit hashes with A-Z lower-cased (the tokenizer
lower-cases too), but those that hold `<|` as they are, for special tokens are found before lower-casing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import frames, words as W
from tidemark.llm.wavelet import WaveletMatrix, build

SHARD = 1 << 20
END = 1
KNOWN = 1 << 21  # pieces a worker remembers before it starts anew: some 70 MB
MARK = "\x01"  # a word of its own between words that are encoded in one call
_SHARDS = "part int, k int, before long, n_tokens long, n_docs long, shard binary"


_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_NO_LETTER = np.zeros(256, bool)  # second bytes of signs among the Latin letters that begin with 0xC3
_NO_LETTER[[0x97, 0xB7]] = True
_AS_IS = W.Alphabet(W.blank_words().separator, np.arange(256))


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words that begin at `starts` are cut into pieces: those places and the cuts within words."""
    if len(raw) < 2:
        return starts
    sign, latin = _SIGN[raw], raw == 0xC3
    ends_letter, begins_letter = _ALNUM[raw], _ALNUM[raw]
    second = latin[:-1] & (raw[1:] >= 0x80) & ~_NO_LETTER[raw[1:]]
    ends_letter[1:] |= second
    begins_letter[:-1] |= second
    head = np.zeros(len(raw), bool)
    head[1:] = (sign[1:] & ends_letter[:-1]) | (sign[:-1] & begins_letter[1:])
    head[starts] = True
    return np.flatnonzero(head)


class Encoder:
    """The ids of pieces, remembered by their hash while the worker lives."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        self.hashes = np.zeros(0, W.U)  # ascending
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode new words (hashes ascending) and keep their ids."""
        if len(self.hashes) + len(hashes) > max(KNOWN, 2 * len(hashes)):
            self.forget()
        mark = MARK.encode()
        odd = [k for k, w in enumerate(words) if mark in w] if mark in b"".join(words) else []
        plain = list(words)
        for k in odd:
            plain[k] = b""
        ids, cuts = [], []
        for a in range(0, len(plain), 1024):
            text = (b" " + mark + b" ").join(plain[a:a + 1024]).decode() + f" {MARK}"
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(got == self.mark[0])
            cuts.append(np.diff(ends, prepend=-1) - 1)
            ids.append(got[got != self.mark[0]])
        counts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        if len(counts) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        pool = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if odd:  # words with the mark inside are encoded alone
            pieces = np.split(pool, np.cumsum(counts)[:-1])
            for k in odd:
                pieces[k] = np.array(self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids, np.int64)
            counts, pool = np.array([len(x) for x in pieces]), np.concatenate(pieces)
        first = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, pool.astype(self.pool.dtype)])
        order = np.argsort(merged := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = merged[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text) without an end id."""
        raw, offsets = W.utf8(column)
        alphabet = W.blank_words()
        first, last, _ = W.word_spans(raw, offsets, alphabet)
        starts = piece_starts(raw, first)
        # a piece ends where the next begins, or where its word ends
        word = np.searchsorted(first, starts, side="right") - 1
        ends = last[word] if len(starts) else last
        inner = word[1:] == word[:-1]
        ends[:-1][inner] = starts[1:][inner]
        per = np.diff(np.searchsorted(starts, offsets))
        h = W.hash_spans(raw, starts, ends, alphabet)
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        if len(special):
            special = np.searchsorted(starts, special, side="right") - 1
            special = special[W.run_starts(special)]
            h[special] = W.hash_spans(raw, starts[special], ends[special], _AS_IS)
        order = np.argsort(h)
        begin = W.run_starts(h[order])
        distinct, example = h[order[begin]], order[begin]
        new = ~self.has(distinct)
        if new.any():
            if len(self.hashes) + int(new.sum()) > max(KNOWN, 2 * int(new.sum())):
                self.forget()
                new[:] = True
            view = raw.tobytes()
            self.learn(distinct[new], [view[a:b] for a, b in zip(starts[example[new]], ends[example[new]])])
        at = np.empty(len(h), np.int64)
        at[order] = np.repeat(np.searchsorted(self.hashes, distinct), np.diff(np.append(begin, len(h))))
        counts = self.count[at]
        step = np.ones(int(counts.sum()), np.int64)  # the pool places of all ids, as steps from one to the next
        full = np.flatnonzero(counts)
        if len(full):
            f, c = self.first[at[full]], counts[full]
            heads = np.cumsum(c) - c
            step[heads[0]] = f[0]
            step[heads[1:]] = f[1:] - (f[:-1] + c[:-1] - 1)
        total = np.concatenate([[0], np.cumsum(counts)])
        edge = np.concatenate([[0], np.cumsum(per)])
        return self.pool[np.cumsum(step)], np.diff(total[edge])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == hashes


def _write(path: str, end: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder, part = Encoder.at(path), TaskContext.get().partitionId()
        held, tokens, before, k = [], 0, 0, 0

        def flush():
            ids = np.concatenate([x[0] for x in held])
            lengths, docs, known = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([before]), pa.array([len(ids)]),
                pa.array([len(docs)]), pa.array([build(ids, lengths, docs, known)], pa.binary())],
                names=["part", "k", "before", "n_tokens", "n_docs", "shard"])

        for batch in W.text_batches(batches, "text", 4 << 20):
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            all_ids = np.insert(ids, ends, end)
            column = batch.column("doc_id")
            docs, known = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            lengths, a = counts + 1, 0
            total = np.concatenate([[0], np.cumsum(lengths)])
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(total, total[a] + shard - tokens, side="right")) - 1)
                b = min(b, len(docs))
                held.append((all_ids[total[a]:total[b]], lengths[a:b], docs[a:b], known[a:b]))
                tokens += int(total[b] - total[a])
                a = b
                if tokens >= shard or a < len(docs):
                    yield flush()
                    before, k, held, tokens = before + tokens, k + 1, [], 0
        if held:
            yield flush()
    return run


def write_shards(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END,
                 shard: int = SHARD) -> DataFrame:
    """The written table of shards: part, k, tokens of the part before, n_tokens, n_docs and the wavelet matrix."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    return frames.written(placed.mapInArrow(_write(tokenizer, end, shard), _SHARDS), "shards")


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids_crc32, read from the shards alone."""
    spark = shards.sparkSession
    # one number for each range partition written
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    total, ahead = 0, {}
    for row in sizes:
        ahead[row["part"]] = total
        total += row["n"]
    shared = spark.sparkContext.broadcast(ahead)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, before, blob in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(),
                                          batch.column("shard")):
                matrix = WaveletMatrix(blob.as_buffer())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(matrix.docs, mask=~matrix.known), pa.array(starts + before + shared.value[part]),
                    pa.array(matrix.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a few shards at once: a shard is a row of some megabytes
    return shards.select("part", "before", "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
