"""Benchmark decontamination by spaced-seed hashing.

An overlap is a stretch of one diagonal of `MIN_WORDS` words or more (the whole item, if shorter) that agrees in
`PERCENT` % of them. A mask such as 111000111 takes the words at its ones and ignores those at its zeros, so a window
still hashes alike when words at ignored places were substituted. Every window of every document and benchmark item
is hashed under all `MASKS`, items under `MIN_WORDS` words under those of their length. No overlap escapes them: it
holds one of less than twice `MIN_WORDS` words, and of that one's blocks of 3 words two are free of substitutions, at
most 5 blocks apart. The items' hashes make a bitmap of fixed size that each task tests its windows against; only
hits, and the words around them as far as an item can reach, leave the scan. Hits are joined to the items' hashes,
each (place, item, diagonal) once, and the aligned words are compared. The result shows the best run, a match counting
1 and a substitution -2, or where that is no overlap the one with most to spare over `PERCENT` %.

Words are runs of letters and digits, A-Z lower-cased: punctuation between words plays no part. A null or empty
text matches nothing. Rows without an id are compared like others. Repeated rows give one result; items that repeat
an id are compared each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import frames, words as W

MASKS = tuple("111" + "000" * k + "111" for k in range(5))
MIN_WORDS = 13
PERCENT = 80
BITS = 24  # of the bitmap: 2 MB, whatever the benchmark's size


def short_masks(n: int, percent: int = PERCENT) -> set[str]:
    """Masks of which a whole item of n words meets one, if `percent` % agree: pairs of two blocks more than may differ."""
    parts = n - (n * percent + 99) // 100 + 2
    if parts == 2 or not n:
        return {"1" * n} - {""}
    edges = [n * k // parts for k in range(parts + 1)]
    ones = ["0" * a + "1" * (b - a) + "0" * (n - b) for a, b in zip(edges, edges[1:])]
    return {"".join(map(max, x, y)).strip("0") for k, x in enumerate(ones) for y in ones[:k]}


def masks_for(lengths, min_words: int = MIN_WORDS, percent: int = PERCENT) -> dict[str, list[int]]:
    """The masks for items of these numbers of words, each with the lengths it serves; `min_words` stands for all above."""
    out: dict[str, list[int]] = {}
    for n in sorted({min(n, min_words) for n in lengths}):
        for mask in MASKS if n == min_words else sorted(short_masks(n, percent)):
            out.setdefault(mask, []).append(n)
    return out


def seeds(h: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in the word array, text) of every window of the mask's span."""
    places, text = W.gram_places(counts, len(mask))
    out = np.full(len(places), (int(mask, 2) + 1) * 0x9E3779B97F4A7C15 % (1 << 64), W.U)
    factor = 1
    for k, bit in enumerate(mask):
        if bit == "1":
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
            out += h[places + k] * W.U(factor)
    return W.mix(out), places, text


def _item_rows(min_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            h, counts = W.words(batch.column("text"), W.letter_words())
            first = np.cumsum(counts) - counts
            found = [[np.zeros(0, W.U)], [first[:0]], [first[:0]]]
            for mask, lengths in masks_for(counts.tolist(), min_words, percent).items():
                s, places, text = seeds(h, counts, mask)
                own = np.isin(np.minimum(counts, min_words), lengths)[text]
                s, places, text = s[own], places[own], text[own]
                found[0].append(s), found[1].append(places - first[text]), found[2].append(text)
            s, at, text = (np.concatenate(x) for x in found)
            order = W.by_text(text, len(counts))
            ends = np.cumsum(np.bincount(text, minlength=len(counts)))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), pa.array([h[a:a + n].tobytes() for a, n in zip(first, counts)], pa.binary()),
                pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(s[order].view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(at[order]))],
                names=["item_id", "words", "n", "seeds", "at"])
    return run


def _hit_rows(bitmap, masks: list[str], reach: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            h, counts = W.words(batch.column("text"), W.letter_words())
            found = [[np.zeros(0, W.U)], [counts[:0]], [counts[:0]]]
            for mask in masks:
                s, places, text = seeds(h, counts, mask)
                hit = bitmap.value.has(s)
                found[0].append(s[hit]), found[1].append(places[hit]), found[2].append(text[hit])
            s, place, text = (np.concatenate(x) for x in found)
            if not len(s):
                continue
            order = np.argsort(place, kind="stable")
            s, place, text = s[order], place[order], text[order]
            first = np.cumsum(counts) - counts
            low = np.maximum(place - reach, first[text])
            high = np.minimum(place + reach, first[text] + counts[text])
            apart = np.ones(len(s), bool)  # a region begins where the one before has ended
            apart[1:] = (low[1:] > high[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(apart)
            end = np.append(begin[1:], len(s))
            offsets = pa.array(np.append(begin, len(s)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(text[begin])), pa.array(low[begin] - first[text[begin]]),
                pa.array([h[a:b].tobytes() for a, b in zip(low[begin], high[end - 1])], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(place - np.repeat(low[begin], end - begin)))],
                names=["doc_id", "start", "words", "seeds", "at"])
    return run


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, equal words) of the run of greatest sum, a match 1 and a difference -2; the first of such."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return begin, end, int(equal[begin:end].sum())


def overlap(equal: np.ndarray, least: int, percent: int) -> tuple[int, int, int] | None:
    """(begin, end, equal words) of a stretch of at least `least` words with `percent` % equal, None if there is none."""
    begin, end, n = best_run(equal)
    if end - begin >= least and 100 * n >= percent * (end - begin):
        return begin, end, n
    if len(equal) < least:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    low = np.minimum.accumulate(total[:len(total) - least])
    spare = total[least:] - low
    end = int(np.argmax(spare))
    if spare[end] < 0:
        return None
    begin = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return begin, end + least, int(equal[begin:end + least].sum())


def _compare(min_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, at, item_at, n, same = [], [], [], [], []
            diagonal = batch.column("diagonal").to_numpy()
            for k, (x, y) in enumerate(zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist())):
                x, y = np.frombuffer(x, W.U), np.frombuffer(y, W.U)
                d = int(diagonal[k])
                a = max(0, d)
                found = overlap(x == y[a - d:a - d + len(x)], min(min_words, len(y)), percent)
                if found:
                    begin, end, equal = found
                    rows.append(k), at.append(a + begin), item_at.append(a + begin - d)
                    n.append(end - begin), same.append(equal)
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(picked) for c in ("doc_id", "start", "item_id")]
                + [pa.array(v, pa.int64()) for v in (at, item_at, n, same)],
                names=["doc_id", "start", "item_id", "at", "item_at", "n_words", "n_equal"])
    return run


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS,
             percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, word places of the overlap in both (from 0), its words and how many of them agree."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    id_type, item_type = (x.schema[0].dataType.simpleString() for x in (docs, items))
    items = frames.written(items.mapInArrow(
        _item_rows(min_words, percent), f"item_id {item_type}, words binary, n long, seeds array<long>, at array<long>"), "items")
    known = items.select("item_id", "words", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(
        F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at"), "item_id", F.xxhash64("words").alias("item"))
    bitmap = spark.sparkContext.broadcast(frames.Bitmap.of(known, "seed", BITS))
    longest, lengths = items.agg(F.max("n"), F.collect_set(F.least("n", F.lit(min_words)))).first()
    masks = list(masks_for(lengths, min_words, percent))
    found = docs.mapInArrow(_hit_rows(bitmap, masks, (longest or 0) + max(map(len, MASKS))),
                            f"doc_id {id_type}, start long, words binary, seeds array<long>, at array<long>")
    found = frames.written(found.withColumn("region", F.xxhash64("doc_id", "start", "words")), "regions")
    hits = found.select("region", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(
        "region", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at"))
    pairs = (hits.join(known, "seed")
             .select("region", "item_id", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    regions = found.select("region", "doc_id", "start", "words").dropDuplicates(["region"])
    texts = items.select(F.col("item_id").alias("id2"), F.xxhash64("words").alias("item"),
                         F.col("words").alias("item_words")).dropDuplicates(["id2", "item"])
    # of the region only the words beside the item go on
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    stop = F.least(F.length("words") / 8, F.col("diagonal") + F.length("item_words") / 8)
    beside = F.col("words").substr((8 * begin + 1).cast("int"), (8 * (stop - begin)).cast("int"))
    aligned = (pairs.join(regions, "region")
               .join(texts, (pairs["item"] == texts["item"]) & F.col("item_id").eqNullSafe(F.col("id2")))
               .select("doc_id", "start", beside.alias("words"), "item_id", "item_words", "diagonal"))
    checked = aligned.mapInArrow(_compare(min_words, percent), f"doc_id {id_type}, start long, item_id {item_type}, "
                                 "at long, item_at long, n_words long, n_equal long")
    return checked.select("doc_id", "item_id", (F.col("start") + F.col("at")).alias("doc_at"), "item_at",
                          "n_words", "n_equal").distinct()


def without_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with its columns, whose id is in no overlap; rows without an id are kept."""
    name = frames.free("_gone", docs)
    gone = overlaps(docs, items, doc_id, text).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti").select(*docs.columns)
