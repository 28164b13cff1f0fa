"""Stupid-backoff scores of documents under the n-gram counts of all other documents of the corpus.

Documents are dealt to batches by a hash. Each batch sends every distinct n-gram once, with its count, to the
n-gram's hash bucket: the count tables, partitioned by hash. A bucket adds the counts and answers each batch with the
corpus count of each n-gram it sent; the batch takes off what the document at hand holds itself, so a document never
vouches for its own n-grams. Words go first; a longer n-gram is sent only if other documents hold both n-grams of one
word less that it holds, for otherwise none holds it: nothing that counts is left out. Met by its answers, a batch
lays the counts along its words and sums each document's scores. A frequent n-gram is one entry per batch, however
often it stands there, so no key gathers more than the number of batches.

Score of a word: count(n-gram) / count(its context) of the longest n-gram ending there, at most `order` words and
within the document, that other documents hold, times `ALPHA` for each word the n-gram is shorter than it might be.
A single word counts over the words of all other documents; one that none of them has scores as 1 over these words,
one `ALPHA` further (1 over 1 where there are none). A document's score is the sum of the logarithms, each rounded to
a millionth, so that sums are exact.

Words: A-Z lower-cased runs of bytes other than blanks (32 and 9 to 13), told apart by 64-bit hashes. A document
without words, null or empty, has score 0. Rows without an id and rows that repeat are documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import frames, words as W

ORDER = 3
ALPHA = 0.4
MICRO = 1_000_000


class Batch:
    """The words of a group's documents in one order, and the counts of their n-grams in other documents so far."""

    def __init__(self, table: pa.Table, answers: pa.Table | None):
        table = table.sort_by([("doc_id", "ascending"), ("uid", "ascending")])
        self.ids = table.column("doc_id")
        self.h, self.counts = W.words(table.column("text"), W.blank_words())
        self.along, self.totals = {}, {}
        if answers is not None:
            rows = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
            ns, totals = rows.column("n").to_numpy(), rows.column("total")
            for n in sorted(set(ns.tolist())):
                got = [W.unpack_counts(totals[int(k)].as_py()) for k in np.flatnonzero(ns == n)]
                last, document, _, which, _ = self.grams(n)
                self.along[n] = np.zeros(len(self.h), np.int64)  # by the n-gram's last word
                self.totals[n] = np.concatenate(got)
                self.along[n][last] = self.totals[n][which].astype(np.int64) - own_counts(document, which)

    def grams(self, n: int):
        """(last words, documents, distinct n-grams ascending, which of them each is, how often each is here)."""
        places, document = W.gram_places(self.counts, n)
        if n > 1:  # other documents hold both n-grams of one word less
            shorter = self.along.get(n - 1, np.zeros(len(self.h), np.int64))
            known = (shorter[places + n - 1] > 0) & (shorter[places + n - 2] > 0)
            places, document = places[known], document[known]
        return (places + n - 1, document, *W.distinct(W.grams(self.h, n)[places]))


def own_counts(document: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each n-gram how often its own document has it; documents come in order."""
    if not len(which):
        return which
    key = document * (int(which.max()) + 1) + which
    order = np.argsort(key, kind="stable")
    begin = W.run_starts(key[order])
    times = np.diff(np.append(begin, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _send(n: int, buckets: int):
    def sent(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        batch = Batch(table, answers)
        name = table.column("batch")[0].as_py() if table.num_rows else 0
        _, _, grams, _, times = batch.grams(n)
        cuts = W.bucket_cuts(grams, buckets)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        known = list(batch.totals.items())  # what was answered before goes along with the batch
        rows = len(full) + len(known)
        return pa.table([
            pa.array([*full, *[name % buckets] * len(known)], pa.int32()),
            pa.array([n] * len(full) + [k for k, _ in known], pa.int32()), pa.array([name] * rows, pa.int64()),
            pa.array([W.pack_sorted(grams[cuts[b]:cuts[b + 1]]) for b in full] + [None] * len(known), pa.binary()),
            pa.array([W.pack_counts(times[cuts[b]:cuts[b + 1]]) for b in full] + [None] * len(known), pa.binary()),
            pa.array([None] * len(full) + [W.pack_counts(total) for _, total in known], pa.binary())],
            names=["bucket", "n", "batch", "grams", "times", "answer"])

    def first(table: pa.Table) -> pa.Table:
        return sent(table, None)

    def later(table: pa.Table, answers: pa.Table) -> pa.Table:
        return sent(table, answers)

    return first if n == 1 else later


def _count(table: pa.Table) -> pa.Table:
    """One bucket of the count table of n-grams of n words: the corpus counts of each batch's n-grams, in order.

    Rows that hold an answer already, to shorter n-grams, are groups of their own and pass through.
    """
    if not table.column("answer").null_count:
        return pa.table([table.column(c) for c in ("batch", "n", "bucket", "answer")],
                        names=["batch", "n", "bucket", "total"])
    grams = [W.unpack_sorted(x.as_py()) for x in table.column("grams")]
    times = np.concatenate([W.unpack_counts(x.as_py()) for x in table.column("times")]).astype(np.int64)
    ends = np.cumsum([len(g) for g in grams])
    _, which, _ = W.distinct(np.concatenate(grams))
    total = np.zeros(int(which.max()) + 1, np.int64)
    np.add.at(total, which, times)
    total = total[which]
    return pa.table({"batch": table.column("batch"), "n": table.column("n"), "bucket": table.column("bucket"),
                     "total": pa.array([W.pack_counts(x) for x in np.split(total, ends[:-1])], pa.binary())})


def _score(order: int, alpha: float, words: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, answers)
        h, counts, along = batch.h, batch.counts, batch.along
        inner = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        others = np.repeat(words - counts, counts)  # words of other documents
        reach = np.minimum(inner + 1, order)  # the longest n-gram that may end at a word
        ratio, used, left = 1 / np.maximum(others, 1), np.zeros(len(h), np.int64), np.ones(len(h), bool)
        for n in range(order, 0, -1):
            if n not in along:
                continue
            at = np.flatnonzero(left & (reach >= n) & (along[n] > 0))
            ratio[at] = along[n][at] / (along[n - 1][at - 1] if n > 1 else others[at])
            used[at] = n
            left[at] = False
        score = np.rint((np.log(ratio) + np.log(alpha) * (reach - used)) * MICRO)
        edge = np.concatenate([[0], np.cumsum(counts)])

        def sums(values):
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(values.astype(np.int64))])[edge]))

        return pa.table([batch.ids, pa.array(counts.astype(np.int64)), sums(score), sums(reach > used)],
                        names=["doc_id", "n_words", "micro", "backed_off"])
    return run


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
           alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_backed_off (words scored by a shorter n-gram than they might), score and mean_score."""
    buckets = frames.buckets_for(docs.sparkSession, 1)  # the larger a batch, the fewer n-grams are sent twice
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = total_words(rows)
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    grouped = rows.withColumn("batch", F.pmod("uid", F.lit(buckets)).cast("long")).groupBy("batch")
    schema = "bucket int, n int, batch long, grams binary, times binary, answer binary"

    def answered(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket", "n").applyInArrow(_count, "batch long, n int, bucket int, total binary")

    known = answered(grouped.applyInArrow(_send(1, buckets), schema))
    for n in range(2, order + 1):
        known = answered(grouped.cogroup(known.groupBy("batch")).applyInArrow(_send(n, buckets), schema))
    out = grouped.cogroup(known.groupBy("batch")).applyInArrow(
        _score(order, alpha, words), "doc_id long, n_words long, micro long, backed_off long")
    score = F.col("micro") / F.lit(float(MICRO))
    return out.select("doc_id", "n_words", F.col("backed_off").alias("n_backed_off"), score.alias("score"),
                      F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0).alias("mean_score"))


def total_words(rows: DataFrame) -> int:
    """All words of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            _, _, counts = W.word_spans(*W.utf8(batch.column("text")), W.blank_words())
            yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())])], names=["n"])
    return rows.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
