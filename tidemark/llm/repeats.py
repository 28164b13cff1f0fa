"""Removal of long repeats: enhanced suffix arrays, their common-prefix interval trees, maximal repeats.

A byte goes if it is covered by a string of `LENGTH` bytes that also starts in a document of a smaller id. No
match crosses documents, and all strings are judged on the input.

Every string of LENGTH bytes has an anchor: the place of the least hash among its `GRAM`-byte substrings, the
first of such. Equal strings have equal anchors, so a run of strings with one anchor, a *context* of at most 2 *
LENGTH - GRAM bytes, need only be compared with contexts of the same anchor. In order:

1. Documents are dealt to batches by a hash. A batch sends each distinct context once, as the anchor's hash, a
   64-bit hash of the context and the smallest id that has it, to the anchor's bucket.
2. The bucket answers, entry by entry: a smaller id has the whole context (all its strings repeat); or other
   contexts share its anchor, and the smallest id's batch sends its bytes and all its places in documents of that
   id; or neither, and nothing is left to do.
3. The bucket builds the enhanced suffix array of the contexts it got, over the places where strings of LENGTH
   bytes start. A stack scan of the common prefix lengths yields the intervals of at least LENGTH, the prefix tree's
   nodes; those whose left neighbours differ are maximal repeats, given with all occurrences. In each, occurrences
   in documents other than the smallest are spans to remove, at every place of their context.
4. Each batch cuts its documents by the spans.

A context that occurs everywhere is one entry per batch, so no anchor gathers copies; a bucket gets distinct
contexts alone. Rows without an id lose nothing and take nothing away; rows that share an id, repeated or not, take
nothing from each other. A null text is empty. Contexts are told apart by 64-bit hashes, anchors' hashes only group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import frames, words as W

LENGTH = 50
GRAM = 26
_BITS = 40  # of an anchor's hash
_CODE = W.mix(np.arange(7, 263, dtype=W.U) * W.U(0x9FB21C651E98DF25))


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the weighted bytes, and the factors that bring a difference of them back to place 0."""
    up, down = W._tables()
    if len(raw) > W.PIECE:
        up, down = W._powers(W._ODD, len(raw) + 1), W._powers(pow(W._ODD, -1, 1 << 64), len(raw) + 1)
    total = np.zeros(len(raw) + 1, W.U)
    np.cumsum(_CODE[raw] * up[:len(raw)], out=total[1:])
    return total, down


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first, last start of a context's strings, anchor hash, context hash): all contexts of the texts, in order."""
    empty = np.zeros(0, np.int64)
    starts = len(raw) - length + 1
    if starts <= 0:
        return empty, empty, empty.astype(W.U), empty.astype(W.U)
    total, down = _sums(raw)
    h = W.mix((total[gram:] - total[:-gram]) * down[:len(raw) - gram + 1])
    wide = length - gram + 1
    low, span = h, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:starts], low[wide - span:wide - span + starts])
    inside = np.arange(starts) + length <= np.repeat(offsets[1:], np.diff(offsets))[:starts]
    same = np.zeros(starts + 1, bool)
    same[1:-1] = (low[1:] == low[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~same[:-1])
    last = np.flatnonzero(inside & ~same[1:])
    anchor = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 15):
        part = first[k:k + (1 << 15)]
        anchor[k:k + (1 << 15)] = part + (h[part[:, None] + np.arange(wide)] == low[part][:, None]).argmax(axis=1)
    tied = np.flatnonzero(last > anchor)  # the least hash comes again: strings beyond its first place have the next
    if len(tied):
        more = []
        for k in tied:
            at = first[k] + np.flatnonzero(h[first[k]:last[k] + wide] == low[first[k]])
            begin = np.concatenate([[first[k]], at[:-1] + 1])
            end = np.minimum(at, last[k])
            some = begin <= end
            more.append(np.stack([begin[some], end[some], at[some]]))
        keep = np.ones(len(first), bool)
        keep[tied] = False
        first, last, anchor = np.concatenate([np.stack([first, last, anchor])[:, keep], *more], axis=1)
        order = np.argsort(first)
        first, last, anchor = first[order], last[order], anchor[order]
    group = W.mix(h[anchor] ^ W.U(0x2545F4914F6CDD1D)) >> W.U(64 - _BITS)
    body = (total[last + length] - total[first]) * down[first]
    body += (last - first).astype(W.U) * W.U(0x9E6C63D0876A9A99) + (anchor - first).astype(W.U) * W.U(
        0xC13FA9A902A6328F)
    return first, last, group, W.mix(body)


class Batch:
    """The documents of a group in one order, and their distinct contexts by (anchor, context)."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        table = table.sort_by([("doc_id", "ascending"), ("uid", "ascending")])  # null ids come last
        self.ids = table.column("doc_id")
        self.known = len(self.ids) - self.ids.null_count
        self.raw, self.offsets = W.utf8(table.column("text"))
        self.length = length
        numbers = self.ids.slice(0, self.known).to_numpy()
        upto = self.offsets[:self.known + 1]
        found = contexts(self.raw[:upto[-1]], upto, length, gram) if self.known else contexts(
            self.raw[:0], np.zeros(1, np.int64), length, gram)
        self.first, self.last, self.group, self.body = found
        self.owner = numbers[np.searchsorted(upto, self.first, side="right") - 1] if self.known else self.first
        order = np.lexsort((self.body, self.group))  # stable: ids ascend within a context
        new = np.ones(len(order), bool)
        new[1:] = self.body[order[1:]] != self.body[order[:-1]]
        begin = np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.example = order[begin]  # of each entry, in the smallest document that has it
        self.anchors = self.group[self.example]
        self.least = self.owner[self.example]

    def cuts(self, buckets: int) -> np.ndarray:
        edges = np.array([(b << _BITS) // buckets for b in range(1, buckets)], dtype=W.U)
        return np.concatenate([[0], np.searchsorted(self.anchors, edges), [len(self.anchors)]])


def _pack_ids(ids: np.ndarray) -> bytes:
    base = int(ids.min()) if len(ids) else 0
    x = (ids.view(W.U) - np.array(base, np.int64).view(W.U)).astype("<u8")
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([planes]) + base.to_bytes(8, "little", signed=True) + x.view(np.uint8).reshape(-1, 8).T[
        :planes].tobytes()


def _unpack_ids(blob: bytes) -> np.ndarray:
    planes, base = blob[0], int.from_bytes(blob[1:9], "little", signed=True)
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :planes] = body.T
    return out.view("<i8").ravel() + base


_BLOBS = ("a", "b", "c", "d", "e")
_SENT = "bucket int, batch long, kind tinyint, " + ", ".join(f"{x} binary" for x in _BLOBS)


def _rows(bucket, batch, kind, *blobs) -> pa.Table:
    n = len(bucket)
    columns = [pa.array(x, pa.binary()) for x in blobs] + [pa.nulls(n, pa.binary())] * (len(_BLOBS) - len(blobs))
    return pa.table([pa.array(bucket, pa.int32()), pa.array([batch] * n, pa.int64()),
                     pa.array([kind] * n, pa.int8()), *columns], names=["bucket", "batch", "kind", *_BLOBS])


def _send(length: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch = Batch(table, length, gram)
        cuts = batch.cuts(buckets)
        full = np.flatnonzero(np.diff(cuts))
        parts = [slice(cuts[k], cuts[k + 1]) for k in full]
        body = batch.body[batch.example]
        return _rows(full, table.column("batch")[0].as_py(), 0, [W.pack_sorted(batch.anchors[p]) for p in parts],
                     [body[p].tobytes() for p in parts], [_pack_ids(batch.least[p]) for p in parts])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: for each entry 1 where a smaller id has the context, 2 where its bytes are wanted, else 0."""
    anchors = [W.unpack_sorted(x.as_py()) for x in table.column("a")]
    body = np.concatenate([np.frombuffer(x.as_py(), W.U) for x in table.column("b")])
    ids = np.concatenate([_unpack_ids(x.as_py()) for x in table.column("c")])
    ends = np.cumsum([len(a) for a in anchors])
    group = np.concatenate(anchors)
    order = np.lexsort((body, group))
    begin = W.run_starts(body[order])
    sizes = np.diff(np.append(begin, len(order)))
    least = np.repeat(np.minimum.reduceat(ids[order], begin), sizes)
    heads = W.run_starts(group[order])
    kinds = np.diff(np.append(np.searchsorted(begin, heads), len(begin)))  # contexts of each anchor
    several = np.repeat(kinds > 1, np.diff(np.append(heads, len(order))))
    flag = np.where(ids[order] > least, 1, np.where(several, 2, 0)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = flag
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"),
                     "flags": pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())})


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans apart from each other."""
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(end)) - 1] if len(at) else end


def _wanted(length: int, gram: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], 0, 0)
        batch = Batch(table, length, gram)
        name = table.column("batch")[0].as_py()
        flags = np.frombuffer(b"".join(
            x.as_py() for x in answers.sort_by("bucket").column("flags")), np.uint8)
        gone = (flags[batch.entry] == 1) | (batch.owner > batch.least[batch.entry])
        begin, end = _merged(batch.first[gone], batch.last[gone] + length)
        spans = _rows([name % buckets], name, 1, [begin.astype("<i8").tobytes()], [end.astype("<i8").tobytes()])
        cuts = batch.cuts(buckets)
        # all places of the wanted contexts in documents of their smallest id, context by context
        spots = np.flatnonzero((flags[batch.entry] == 2) & ~gone)
        spots = spots[np.argsort(batch.entry[spots], kind="stable")]
        edges = np.searchsorted(batch.entry[spots], cuts)
        sent = []
        for k in np.flatnonzero(np.diff(edges)):
            spot = spots[edges[k]:edges[k + 1]]
            begin = W.run_starts(batch.entry[spot])
            at, many = spot[begin], np.diff(np.append(begin, len(spot)))
            sizes = batch.last[at] - batch.first[at] + length
            places = np.repeat(batch.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            sent.append((k, batch.raw[places].tobytes(), W.pack_small(sizes), _pack_ids(batch.owner[at]),
                         batch.first[spot].astype("<i8").tobytes(), W.pack_small(many)))
        if not sent:
            return spans
        bucket, *blobs = zip(*sent)
        return pa.concat_tables([spans, _rows(bucket, name, 0, *blobs)])
    return run


def suffix_array(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes [start, end) in order, common prefix with the one before): sorted by 8 bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(W.U)
    eight = np.zeros(len(raw) + 1, W.U)
    for k in range(8):
        eight |= padded[k:k + len(raw) + 1] << W.U(56 - 8 * k)
    keys = []
    longest = int((end - start).max()) if len(start) else 0
    for k in range(0, longest, 8):
        left = np.clip(end - start - k, 0, 8)
        value = eight[np.minimum(start + k, len(raw))]
        keys.append(np.where(left > 0, value & (~W.U(0) << ((8 - np.maximum(left, 1)) * 8).astype(W.U)), W.U(0)))
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(start))
    common = np.zeros(len(start), np.int64)
    going = np.ones(max(0, len(start) - 1), bool)
    for key in keys:
        x = key[order[1:]] ^ key[order[:-1]]
        same = np.full(len(x), 8)
        some = x > 0
        for b in range(8):  # bytes before the first difference
            same[some & (x >> W.U(56 - 8 * b) > 0) & (same == 8)] = b
        common[1:] += np.where(going, same, 0)
        going &= ~some
    size = (end - start)[order]
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def intervals(common: np.ndarray, least: int) -> np.ndarray:
    """Rows (from, to, length) of the prefix tree's nodes of at least `least`: a stack scan of the common prefixes.

    Suffixes from..to share their first `length` bytes, and no further suffix does.
    """
    deep = common >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]  # runs of deep values: suffixes begin - 1 .. end - 1
    pairs = end - begin == 1
    out = [np.stack([begin[pairs] - 1, begin[pairs], common[begin[pairs]]], axis=1)]
    rows = []
    for a, b in zip(begin[~pairs].tolist(), end[~pairs].tolist()):
        stack = []
        for i, value in enumerate([*common[a:b].tolist(), 0], a):
            left = i - 1
            while stack and stack[-1][0] > value:
                depth, left = stack.pop()
                rows.append((left, i - 1, depth))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))
    return np.concatenate([*out, np.array(rows, np.int64).reshape(-1, 3)])


def maximal_repeats(raw: np.ndarray, text_start: np.ndarray, text_end: np.ndarray, least: int):
    """(groups, text, place): maximal repeats of the texts of at least `least` bytes with all their occurrences.

    Rows of groups are (from, to, length); occurrences from..to of `text` and `place` (in `raw`) hold the repeat.
    The texts' beginnings count as differing from everything before a suffix.
    """
    many = np.maximum(text_end - text_start - least + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + text_start[text]
    order, common = suffix_array(raw, place, text_end[text])
    text, place = text[order], place[order]
    nodes = intervals(common, least)
    before = np.where(place > text_start[text], raw[np.maximum(place - 1, 0)].astype(np.int64), -1 - np.arange(len(place)))
    turns = np.zeros(len(place), np.int64)
    turns[1:] = np.cumsum(before[1:] != before[:-1])
    diverse = turns[nodes[:, 1]] > turns[nodes[:, 0]] if len(nodes) else np.zeros(0, bool)
    return nodes[diverse], text, place


def _repeated(length: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        spans = table.filter(pa.array(kinds == 1))
        out = [[spans.column("batch")], [spans.column("a")], [spans.column("b")]]
        rows = table.filter(pa.array(kinds == 0))
        if rows.num_rows:
            sizes = [W.unpack_small(x.as_py()).astype(np.int64) for x in rows.column("b")]
            ids = np.concatenate([_unpack_ids(x.as_py()) for x in rows.column("c")])
            at = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows.column("d")])
            places = np.concatenate([W.unpack_small(x.as_py()).astype(np.int64) for x in rows.column("e")])
            source = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
            size = np.concatenate(sizes)
            raw = np.frombuffer(b"".join(x.as_py() for x in rows.column("a")), np.uint8)
            end = np.cumsum(size)
            groups, text, place = maximal_repeats(raw, end - size, end, length)
            owner = ids[text]
            # of each group, the occurrences in documents beyond the smallest
            many = groups[:, 1] - groups[:, 0] + 1
            group = np.repeat(np.arange(len(groups)), many)
            place_of = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many) + groups[group, 0]
            if len(group):
                least = np.minimum.reduceat(owner[place_of], np.cumsum(many) - many)
                gone = owner[place_of] > least[group]
                group, place_of = group[gone], place_of[gone]
            # the spans of each context, kept apart from the next one's by a step of 1, then at all its places
            begin = place[place_of] + text[place_of]
            begin, stop = _merged(begin, begin + groups[group, 2])
            text = np.searchsorted(end + np.arange(len(end)), begin, side="right")
            inner, span = begin - text - (end - size)[text], stop - begin
            many = places[text]
            which = np.repeat(np.arange(len(text)), many)
            begin = at[np.arange(len(which)) + np.repeat((np.cumsum(places) - places)[text] - (np.cumsum(many) - many),
                                                         many)] + inner[which]
            stop = begin + span[which]
            source = source[text[which]]
            order = np.argsort(source, kind="stable")
            cuts = np.searchsorted(source[order], np.arange(len(sizes) + 1))
            names, a, b = rows.column("batch").to_pylist(), [], []
            for k in range(len(sizes)):
                part = order[cuts[k]:cuts[k + 1]]
                x, y = _merged(begin[part], stop[part])
                a.append(x.astype("<i8").tobytes()), b.append(y.astype("<i8").tobytes())
            for column, values in zip(out, (pa.array(names, pa.int64()), pa.array(a, pa.binary()),
                                            pa.array(b, pa.binary()))):
                column.append(values)
        return pa.table([pa.chunked_array([c for x in column for c in (x.chunks if isinstance(x, pa.ChunkedArray)
                                                                       else [x])], kind)
                         for column, kind in zip(out, (pa.int64(), pa.binary(), pa.binary()))],
                        names=["batch", "begin", "stop"])
    return run


def _cut(length: int, gram: int, keep_text: bool):
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("uid", "ascending")])
        raw, offsets = W.utf8(table.column("text"))
        begin = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), "<i8") for x in spans.column("begin"))])
        stop = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), "<i8") for x in spans.column("stop"))])
        begin, stop = _merged(begin, stop)
        doc = np.searchsorted(offsets, begin, side="right") - 1
        # spans of two documents may touch: the union is cut where a document ends
        pieces = [(begin, np.minimum(stop, offsets[doc + 1]), doc)]
        while len(begin):
            more = stop > offsets[doc + 1]
            begin, stop, doc = offsets[doc + 1][more], stop[more], doc[more] + 1
            pieces.append((begin, np.minimum(stop, offsets[doc + 1]), doc))
        begin, stop, doc = (np.concatenate([p[k] for p in pieces]) for k in range(3))
        some = stop > begin
        begin, stop, doc = begin[some], stop[some], doc[some]
        order = np.argsort(begin)
        begin, stop, doc = begin[order], stop[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(offsets)))
        view, digests, kept, lists = raw.tobytes(), [], [], []
        for k in range(len(offsets) - 1):
            a, b = begin[edge[k]:edge[k + 1]], stop[edge[k]:edge[k + 1]]
            left = np.concatenate([[offsets[k]], b])
            right = np.concatenate([a, [offsets[k + 1]]])
            rest = b"".join(view[x:y] for x, y in zip(left.tolist(), right.tolist()))
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest)
                lists.append([{"begin": int(x - offsets[k]), "stop": int(y - offsets[k])} for x, y in zip(a, b)])
        n = len(offsets) - 1
        columns = {"doc_id": table.column("doc_id"), "n_bytes": np.diff(offsets),
                   "n_removed": np.bincount(doc, weights=stop - begin, minlength=n).astype(np.int64),
                   "n_spans": np.bincount(doc, minlength=n), "kept_sha256": pa.array(digests, pa.string())}
        if keep_text:
            columns["kept"] = pa.array(kept, pa.binary())
            columns["spans"] = pa.array(lists, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))
        return pa.table(columns)
    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                    gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_text`, the bytes kept and the spans removed.

    Bytes are those of the text in UTF-8; a span may cut a character, so what is kept is binary.
    """
    buckets = frames.buckets_for(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("batch", F.pmod("uid", F.lit(buckets)).cast("long"))
    grouped = rows.groupBy("batch")
    sent = grouped.applyInArrow(_send(length, gram, buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answer, "batch long, bucket int, flags binary")
    wanted = grouped.cogroup(answers.groupBy("batch")).applyInArrow(_wanted(length, gram, buckets), _SENT)
    spans = wanted.groupBy("bucket").applyInArrow(_repeated(length), "batch long, begin binary, stop binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", kept binary, spans array<struct<begin: long, stop: long>>"
    return grouped.cogroup(spans.groupBy("batch")).applyInArrow(_cut(length, gram, keep_text), schema)
