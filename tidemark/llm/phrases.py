"""Phrase collocations: contiguous word phrases that occur more often than their parts let expect.

Texts are cut into pieces at punctuation and line ends and pieces into words, per language. Words that occur `least`
times get ids; a rarer word can't be part of a candidate, so it ends a run just as a piece's end does. The ids of each
n-gram are packed into one key and counted in counting quotient filters (`quotient`): a task fills filters over all key
ranges, ranges meet and merge, in two rounds where one would make too many small parts. The counts are exact. All that
is left, phrases of `least` occurrences, are rows: a phrase's score is floor(1000000 * a * a / (l * r)) for the cut into
two parts, of l and r occurrences, that scores lowest; it is dropped where it lies inside a longer candidate that has
at least `share` percent of its occurrences.

A null text is empty, a null language is `und`; empty texts and tables give nothing. Repeated rows count as often as
they occur; ids are not read. Ties: score and a descending, then the phrase in byte order. The cut: lowest floored
score, then the shorter first part. A batch holds whole texts, one text at least, so a very long text is one batch.
Up to 2^32 frequent words and a < 10^16 fit; beyond it the query stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import frames, words
from tidemark.llm.quotient import CountingFilter, pack_ids, ranges, unpack_ids

TEXT = 8 << 20  # bytes of text in a batch
ENTRIES = 1 << 20  # counted n-grams that meet in one merge, about
SENT = 1 << 21  # n-grams of a length that a task gathers before it sends filters on
FAN = 512  # parts that a filter is cut into at most

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BETWEEN = words.Alphabet(_APART, _LOWER)


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, whether a piece begins with it)."""
    raw, offsets = words.utf8(texts)
    starts, ends, per_text = words.word_spans(raw, offsets, _BETWEEN)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
    opens = np.concatenate([[True], piece[1:] != piece[:-1]])
    first = np.cumsum(per_text)[:-1]
    opens[first[first < len(starts)]] = True
    ends -= starts
    lengths = np.concatenate([[0], np.cumsum(ends)])
    del piece, starts, ends
    body = _LOWER[raw[~_APART[raw]]]
    found = pa.Array.from_buffers(pa.large_string(), len(opens), [None, pa.py_buffer(lengths), pa.py_buffer(body)])
    found = found.dictionary_encode()
    return found.dictionary.cast(pa.string()), found.indices.to_numpy(), opens


def _read(batches: Iterator[pa.RecordBatch]):
    """A row for each batch: its words' numbers with 0 between pieces, and its words with language and count."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        nonlocal number
        table = pa.Table.from_batches(held).sort_by([("lang", "ascending")])
        held.clear()
        langs, texts = table.column("lang").combine_chunks(), table.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks])
        runs = langs.dictionary_encode()
        runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
        code = runs.indices.to_numpy()
        cuts = np.append(words.run_starts(code), len(code))
        names, found, times, tokens, known = [], [], [], [], 1
        for a, b in zip(cuts, cuts[1:]):
            distinct, numbers, opens = word_codes(texts.slice(a, b - a))
            out = np.zeros(len(numbers) + int(opens.sum()), np.uint32)
            out[np.arange(len(numbers)) + np.cumsum(opens)] = numbers + known
            names += [runs.dictionary[int(code[a])].as_py()] * len(distinct)
            found.append(distinct), tokens.append(out), times.append(np.bincount(numbers, minlength=len(distinct)))
            known += len(distinct)
        number += 1
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number]), pa.array([words.pack_small(np.concatenate(tokens))], pa.binary()),
            pa.array([names], pa.list_(pa.string())),
            pa.ListArray.from_arrays([0, len(names)], pa.concat_arrays(found)),
            pa.array([np.concatenate(times)], pa.list_(pa.int64()))], names=["batch", "tokens", "lang", "word", "times"])

    for batch in words.text_batches(batches, "text", TEXT):
        more = len(words.utf8(batch.column("text"))[0])
        if held and size + more > TEXT:
            yield row()
            size = 0
        held.append(batch)
        size += more
    if held:
        yield row()


def _send(id_bits: int, lengths: range, parts: int):
    """Filters of the n-grams of whole batches, cut into `parts` ranges of keys.

    All filters of a task have one sender, so a task that runs again sends the same sums whatever the order it reads in.
    """
    def cut(n: int, held: list):
        bits = id_bits * n
        high = None if held[0][0] is None else np.concatenate([h for h, _ in held])
        low = np.concatenate([low for _, low in held])
        held.clear()
        whole = CountingFilter.of(bits, high, low)
        rows = [(part, f.to_bytes()) for part, f in whole.split(ranges(min(bits, 64), parts))]
        return pa.RecordBatch.from_arrays([
            pa.array([n] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()),
            pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()),
            pa.array([b for _, b in rows], pa.binary())], names=["n", "part", "sender", "filter"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {n: [] for n in lengths}
        for batch in batches:
            for k in range(batch.num_rows):
                blob, at, ids = (batch.column(c)[k] for c in range(3))
                token = words.unpack_small(blob.as_py())
                known = np.zeros(int(token.max(initial=0)) + 1, np.uint32)
                known[at.values.to_numpy()] = ids.values.to_numpy()
                token = known[token]
                for n in lengths:
                    grams = [token[i:len(token) - n + 1 + i] for i in range(n)]
                    whole = np.flatnonzero(np.minimum.reduce(grams)) if len(token) >= n else np.zeros(0, np.int64)
                    if len(whole):
                        held[n].append(pack_ids([g[whole] for g in grams], id_bits))
            for n in lengths:
                if sum(len(low) for _, low in held[n]) > SENT:
                    yield cut(n, held[n])
            words.release()
        for n in lengths:
            if held[n]:
                yield cut(n, held[n])
    return run


def _merge(parts: int | None, fan: int):
    """Merge a range's filters; with `parts`, cut the sum into the `fan` finer ranges that make `parts` of all."""
    def run(table: pa.Table) -> pa.Table:
        n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
        blobs = table.column("filter")
        level = [CountingFilter.from_bytes(b.as_py()) for b in blobs]
        while len(level) > 1:
            level = [CountingFilter.merged(level[k:k + 16]) for k in range(0, len(level), 16)]
        whole = level[0]
        if parts is None:
            rows = [(part, whole.to_bytes())]
        else:
            edges = ranges(min(whole.bits, 64), parts)[part * fan:(part + 1) * fan + 1]
            rows = [(part * fan + k, f.to_bytes()) for k, f in whole.split(edges)]
        return pa.table([pa.array([n] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()),
                         pa.array([0] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())],
                        names=["n", "part", "sender", "filter"])
    return run


_FILTERS = "n int, part int, sender long, filter binary"


class Counts:
    """The n-gram counts of a corpus.

    `known`: (id, lang, word, times) of words that occur `least` times; `totals`: (lang, n), n counting all words;
    `filters`: (n, part, filter), lossless counters of the n-grams of known words, one filter for a range of keys.
    """

    def __init__(self, known: DataFrame, totals: DataFrame, filters: DataFrame, id_bits: int):
        self.known, self.totals, self.filters, self.id_bits = known, totals, filters, id_bits

    def frequent(self, least: int) -> DataFrame:
        """(ids, a): n-grams that occur `least` times, as arrays of word ids."""
        id_bits = self.id_bits

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("filter")):
                    f = CountingFilter.from_bytes(blob.as_py())
                    high, low = f.keys()
                    some = np.flatnonzero(f.counts >= least)
                    ids = np.stack(unpack_ids(None if high is None else high[some], low[some], id_bits, n), 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * n, pa.int32()),
                                                     pa.array(ids.ravel().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(f.counts[some])], names=["ids", "a"])
        return self.filters.select("n", "filter").mapInArrow(run, "ids array<long>, a long")


def counts(docs: DataFrame, least: int, lengths: range, text: str = "text", lang: Column | None = None) -> Counts:
    """Count the n-grams of all texts, for n in `lengths`."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang") if lang is None else lang, F.lit("und")).cast("string")
    batches = frames.written(docs.select(lang.alias("lang"), F.col(text).alias("text")).mapInArrow(
        _read, "batch long, tokens binary, lang array<string>, word array<string>, times array<long>"), "pieces")
    entries = (batches.select("batch", F.posexplode(F.arrays_zip("lang", "word", "times")).alias("place", "x"))
               .select("batch", (F.col("place") + 1).alias("place"), "x.*"))
    totals = frames.written(entries.groupBy("lang").agg(F.sum("times").alias("n")), "totals")
    counted = frames.written(entries.groupBy("lang", "word").agg(F.sum("times").alias("times"))
                             .where(F.col("times") >= least).withColumn("number", F.monotonically_increasing_id()), "known")
    # the number is (partition, row of it); ids leave no room between partitions
    row, part = F.col("number").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("number", 33)
    parts = counted.agg(F.coalesce(F.max(part), F.lit(0))).first()[0] + 1
    known = counted.select((row * parts + part + 1).alias("id"), "lang", "word", "times")
    id_bits = max(1, int(known.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0]).bit_length())
    if id_bits > 32 or id_bits * lengths[-1] > 128:
        raise ValueError(f"ids of {id_bits} bits: phrases of {lengths[-1]} words don't fit")
    answers = (entries.select("batch", "place", "lang", "word").join(known.drop("times"), ["lang", "word"])
               .groupBy("batch").agg(F.collect_list(F.struct("place", "id")).alias("x"))
               .select("batch", F.col("x.place").alias("place"), F.col("x.id").alias("id")))
    met = batches.select("batch", "tokens").join(answers, "batch").select("tokens", "place", "id")

    total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * len(lengths)
    fine = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ENTRIES))
    coarse = -(-fine // FAN)
    if coarse == 1:
        sent = met.mapInArrow(_send(id_bits, lengths, fine), _FILTERS)
    else:
        fine = coarse * FAN
        groups = max(1, -(-total // (ENTRIES * coarse)))
        sent = (met.mapInArrow(_send(id_bits, lengths, coarse), _FILTERS)
                .withColumn("sender", F.pmod("sender", F.lit(groups)))
                .groupBy("n", "part", "sender").applyInArrow(_merge(fine, FAN), _FILTERS))
    filters = sent.groupBy("n", "part").applyInArrow(_merge(None, 1), _FILTERS).drop("sender")
    return Counts(known, totals, filters, id_bits)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, text: str = "text",
                 lang: Column | None = None) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first `top` phrases of 2 to `longest` words of each language."""
    found = counts(docs, least, range(2, longest + 1), text, lang)
    phrases = frames.written(found.frequent(least), "phrases")
    parts = phrases.unionByName(found.known.select(F.array("id").alias("ids"), F.col("times").alias("a")))

    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cuts = phrases.select("ids", "a", cut)
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    cuts = (cuts.join(parts.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first")
            .join(parts.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest"))
    wide = "cast({} as decimal(19,0))"
    score = F.expr(f"({wide.format('a')} * {wide.format('a')} * 1000000bd) div ({wide.format('l')} * {wide.format('r')})")
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))

    inner = phrases.where(F.size("ids") > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1),"
        " s -> slice(ids, s, m))))")).alias("ids"))
    covered = inner.groupBy("ids").agg(F.max("a").alias("longer"))
    kept = (scored.join(covered, "ids", "left").where(F.expr(f"longer is null or 100 * longer < {share} * a"))
            .select("ids", "a", "x.l", "x.r", "x.score"))

    langs = found.known.select(F.col("id").alias("first"), "lang")
    kept = kept.withColumn("first", F.col("ids")[0]).join(langs, "first").drop("first")
    best = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(64)))
    for by in (["lang", "lane"], ["lang"]):  # what can't be among the first of its lane can't be among the first
        kept = kept.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("place") <= top)
    spelled = (kept.select("ids", F.posexplode("ids").alias("place", "id")).join(found.known.select("id", "word"), "id")
               .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("x"))
               .select("ids", F.array_join(F.col("x.word"), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(*best, "phrase")
    return (kept.join(spelled, "ids").join(found.totals, "lang").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
