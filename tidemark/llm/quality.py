"""Quality by hierarchical empirical Bayes: evidence of the text on top of what its site and the paths below it are like.

Evidence: a text's words and shape. Over labelled rows of one half, at most `WORD_ROWS` of each label by hash order,
grouped counts give each word slot (of `SLOTS`, by hash) its log likelihood ratio; a text's mean over its distinct words, and its shape (symbols, capitals,
distinct words and lines, ...), fall into bins, and counts over labelled rows (for the words those of the other half,
which gave the slots nothing) give each bin's ratio. A text's evidence is the sum over its bins.

Prior: every text's probability under the global share of good labels is summed by level: host, then path prefixes of
any depth (`address_levels`), or whatever columns are given, each below the one before. A level's posterior is the
mean of its texts shrunk toward the posterior of the level above, the first toward the global mean, with the weight of
`k` texts; k follows from the variance between a level's groups beyond what their sizes explain (method of moments), so
a site of few texts says little. A text's score is its evidence with its deepest level's posterior as the prior. A
site's weight on a text is bounded by `PRIOR_LIMIT`, so that no site condemns a text by itself.

Sums are of millionths, exact in any order, and by the deepest level first, so a host of any size is spread. A null
level is a group like any other. A null or empty text has the bins of an empty one. Of several labels of one id
the largest counts; labels other than 0 and 1 are left out; without labels of both kinds evidence is 0 and the
score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import frames, words as W

FEATURES = ("symbols", "capitals", "exclamations", "distinct_words", "distinct_lines", "digits", "word_length",
            "length", "words")
BINS = 12
SLOTS = 1 << 16  # of distinct words, by hash
WORD_ROWS = 10_000
MICRO = 1_000_000
PRIOR_LIMIT = 2.0  # of the logit by which a site moves a text away from the global share


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _table("#$%&*|^~=<>{}[]_+@\\`/")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_BANG = _table("!")
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then doublings of the share from 1/1024 on."""
    share = part / np.maximum(whole, 1)
    return np.where(share <= 0, 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9)) + 11), 1, BINS - 1)).astype(int)


def _distinct_words(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct words of each text."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(h)
    order = order[W.by_text(text[order], len(counts))]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _distinct(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(_distinct_words(h, counts)[1], minlength=len(counts))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> W.U(48)).astype(np.int64)


def word_bins(h: np.ndarray, text: np.ndarray, texts: int, ratio: np.ndarray | None) -> np.ndarray:
    """The bin of each text's mean ratio over its distinct words; the middle one for texts without words or ratios."""
    if ratio is None:
        return np.full(texts, BINS // 2)
    n = np.bincount(text, minlength=texts)
    mean = np.bincount(text, ratio[_slots(h)], texts) / np.maximum(n, 1)
    return np.clip(np.floor(mean * 6) + BINS // 2, 0, BINS - 1).astype(int)


def shapes(column, ratio: np.ndarray | None = None) -> np.ndarray:
    """The bin of each feature of each text (texts x features); `ratio` holds that of each word slot."""
    raw, offsets = W.utf8(column)
    size = np.diff(offsets)

    def count(table):
        return np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets])

    blank = W.blank_words()
    starts, ends, n = W.word_spans(raw, offsets, blank)
    h, text = _distinct_words(W.hash_spans(raw, starts, ends, blank), n)
    words = np.bincount(text, minlength=len(n))
    letters = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[np.concatenate([[0], np.cumsum(n)])])
    lines = W.Alphabet(_LINES, np.arange(256))
    a, b, m = W.word_spans(raw, offsets, lines)
    distinct_lines = _distinct(W.hash_spans(raw, a, b, lines), m)
    linear = lambda part, whole: np.floor((BINS - 1) * part / np.maximum(whole, 1)).astype(int)
    return np.stack([
        _share_bin(count(_SYMBOL), size), _share_bin(count(_UPPER), size), _share_bin(count(_BANG), size),
        linear(words, n), linear(distinct_lines, m), _share_bin(count(_DIGIT), size),
        np.minimum(letters // np.maximum(n, 1), BINS - 1),
        np.minimum(np.floor(np.log2(n + 1.0)), BINS - 1).astype(int), word_bins(h, text, len(n), ratio)], axis=1)


def _bins(levels: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            got = shapes(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*W.kept_columns(batch, "doc_id", *levels),
                 *[pa.array(got[:, k].astype(np.int32)) for k in range(len(FEATURES))]],
                names=["doc_id", *levels, *FEATURES])
    return run


def _count_words(batches: Iterator[pa.RecordBatch]):
    """Of each batch, how many texts of either label have each word slot (once a text), and how many texts there are."""
    for batch in W.text_batches(batches, "text", 4 << 20):
        raw, offsets = W.utf8(batch.column("text"))
        blank = W.blank_words()
        starts, ends, n = W.word_spans(raw, offsets, blank)
        h, text = _distinct_words(W.hash_spans(raw, starts, ends, blank), n)
        y = batch.column("y").to_numpy()
        key, seen = np.unique(_slots(h) * 2 + y[text], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seen)], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1]), pa.array(np.bincount(y, minlength=2).astype(np.int64))],
                                         names=["key", "n"])


def word_ratios(rows: DataFrame) -> np.ndarray | None:
    """The log likelihood ratio of each word slot over the labelled rows (text, y); None without both labels."""
    counted = rows.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = counted.column("key").to_numpy(), counted.column("n").to_numpy()  # two a slot at most
    texts = [n[key == k - 2].sum() for k in range(2)]
    if not all(texts):
        return None
    seen = np.zeros(2 * SLOTS)
    seen[key[key >= 0]] = n[key >= 0]
    seen = seen.reshape(SLOTS, 2)
    ratio = np.log((seen[:, 1] + 0.5) / (texts[1] + 1)) - np.log((seen[:, 0] + 0.5) / (texts[0] + 1))
    return np.where(seen.sum(1) >= 3, np.clip(ratio, -4, 4), 0.0)


def evidence(shaped: DataFrame, labels: DataFrame) -> tuple[Column, float]:
    """(sum of the bins' log likelihood ratios, share of good labels), counted over all labelled rows.

    `labels`: doc_id, y, and `first` where the row gave the word slots their ratios; it doesn't count for their bins.
    """
    known = shaped.join(labels, "doc_id")
    entries = [F.struct(F.lit(k).alias("feature"), F.col(f).alias("bin")) for k, f in enumerate(FEATURES)]
    entries[-1] = F.when(~F.col("first"), entries[-1])
    stacked = known.select("y", F.explode(F.array_compact(F.array(*entries))).alias("b"))
    rows = stacked.groupBy("b.feature", "b.bin", "y").agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, len(FEATURES), BINS))
    for r in rows:  # at most features x bins x 2
        n[r["y"], r["feature"], r["bin"]] = r["n"]
    good, bad = n[1, 0].sum(), n[0, 0].sum()
    share = float(good / (good + bad)) if good + bad else 0.5
    if not good or not bad:
        return F.lit(0.0), share
    size = n.sum(2, keepdims=True)  # of the words' bins, half the rows
    ratio = (np.log((n[1] + 0.5) / (size[1] + 0.5 * BINS)) - np.log((n[0] + 0.5) / (size[0] + 0.5 * BINS)))
    total = F.lit(0.0)
    for k, f in enumerate(FEATURES):
        total = total + F.element_at(F.array(*[F.lit(float(x)) for x in ratio[k]]), F.col(f) + 1)
    return total, share


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, size: str, center: str) -> float:
    """How many texts the centre counts as, from the variance between groups (method of moments)."""
    row = groups.agg(F.sum(size).alias("n"), F.count("*").alias("g"), F.sum(F.col(size) * F.col(size)).alias("nn"),
                     F.sum(F.col(size) * F.pow(F.col(mean) - F.col(center), 2)).alias("v"),
                     F.sum(F.col(size) * F.col(center) * (1 - F.col(center))).alias("w")).first()
    if not row["n"] or row["g"] < 2:
        return 1.0
    within = row["w"] / row["n"]
    between = row["v"] / row["n"] - (row["g"] - 1) * within / row["n"]
    spread = 1 - float(row["nn"]) / float(row["n"]) ** 2
    if between <= 0 or spread <= 0 or within <= 0:
        return 1e6
    return float(min(max(within * spread / between - 1, 1.0), 1e6))


def address_levels(url: Column, depth: int = 2) -> list[Column]:
    """Host, and the host with the first 1..depth parts of the path (null where the path is shorter)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(host != "", host)
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    return [host, *[F.when(F.size(parts) >= k, F.concat_ws("/", host, F.slice(parts, 1, k))) for k in range(1, depth + 1)]]


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def posteriors(cells: DataFrame, levels: list[str], share: float) -> DataFrame:
    """`posteriors` (an array, first level first) of each cell; `cells` has a row (levels, s, n) of each deepest group,
    s the sum of its texts' probabilities in millionths. The levels' columns are renamed, with `_` behind."""
    whole = cells.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    center = whole["s"] / whole["n"] / MICRO if whole["n"] else share
    above = None
    for k in range(len(levels)):
        groups = cells.groupBy(*levels[:k + 1]).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        groups = groups.withColumn("mean", F.col("s") / F.col("n") / MICRO)
        if above is None:
            groups = groups.withColumn("center", F.lit(center)).withColumn("posteriors", F.array().cast("array<double>"))
        else:  # written apart, so that the many groups of a large site can be split
            groups = groups.join(above, _same(levels[:k], [f"{c}_" for c in levels[:k]])).withColumn(
                "center", F.element_at("posteriors", -1)).drop(*[f"{c}_" for c in levels[:k]])
        strength = _strength(groups, "mean", "n", "center")
        posterior = (F.col("mean") * F.col("n") + strength * F.col("center")) / (F.col("n") + strength)
        above = frames.written(groups.select(*[F.col(c).alias(f"{c}_") for c in levels[:k + 1]], F.concat(
            "posteriors", F.array(posterior)).alias("posteriors")), "sites")
    return above


def scored_by_levels(docs: DataFrame, labels: DataFrame, levels: Sequence[Column], doc_id: str = "doc_id",
                     text: str = "text", label: str = "quality", learn: Column | None = None,
                     keep_from: float = 0.5) -> DataFrame:
    """doc_id, evidence, posteriors (one for each level), score and keep for every row.

    Labels count where `learn` (of the labels' columns) holds.
    """
    names = [f"l{k}" for k in range(len(levels))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       *[c.cast("string").alias(n) for c, n in zip(levels, names)])
    kind = docs.schema[doc_id].dataType.simpleString()
    known = (labels.where(F.col(label).isin(0, 1) & (F.lit(True) if learn is None else learn))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
             .withColumn("first", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(2)) == 0))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = [known.where(F.col("first") & (F.col("y") == y)).orderBy(*order).limit(WORD_ROWS) for y in range(2)]
    sample = F.broadcast(some[0].unionByName(some[1]).select("doc_id", "y"))  # 2 * WORD_ROWS ids: no text is shuffled
    ratio = word_ratios(rows.select("doc_id", "text").join(sample, "doc_id").select("text", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # half a megabyte
    shaped = frames.written(rows.mapInArrow(
        _bins(names, shared), f"doc_id {kind}, " + "".join(f"{n} string, " for n in names)
        + ", ".join(f"{f} int" for f in FEATURES)), "shapes")
    total, share = evidence(shaped, known)
    prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    judged = shaped.withColumn("evidence", total).withColumn(
        "micro", F.round(MICRO / (1 + F.exp(-(F.col("evidence") + prior)))).cast("long"))
    cells = frames.written(judged.groupBy(*names).agg(F.sum("micro").alias("s"), F.count("*").alias("n")), "cells")
    found = posteriors(cells, names, share)
    moved = _logit(F.element_at("posteriors", -1)) - prior
    limited = F.least(F.greatest(moved, F.lit(-PRIOR_LIMIT)), F.lit(PRIOR_LIMIT))
    score = 1 / (1 + F.exp(-(F.col("evidence") + prior + limited)))
    out = judged.join(found, _same(names, [f"{n}_" for n in names]))
    return out.select("doc_id", "evidence", "posteriors", score.alias("score"), (score >= keep_from).alias("keep"))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and keep for every row."""
    out = scored_by_levels(docs, labels, [host, path], **options)
    return out.select("doc_id", "evidence", F.col("posteriors")[0].alias("host_posterior"),
                      F.col("posteriors")[1].alias("path_posterior"), "score", "keep")
