"""Hard negatives of anchors by angular triangle filtering.

Every vector is stored with its norm and its angles to a few reference directions. On the sphere the angle between an
anchor and a row lies between the largest difference and the smallest sum of their angles to a reference, so the
cosine lies in an interval; times both norms, and widened beyond what rounding can do, it bounds the integer score.
Positives: of the rows of an anchor's label those with the highest upper bounds are scored first, the rest only where
their upper bound reaches the least of the best so far. Negatives: each positive's score opens a window, and only rows
of other labels whose bounds overlap a window are scored. Scores are integer inner products; the bounds only decide
which are computed, so results are exact for any references.

Anchors and rows are dealt to blocks by a hash and each pair of blocks is one group, bounded by the two block sizes
whatever the labels' sizes. The references come from a bounded sample of rows (`SAMPLE`, by hash order).

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Repeated rows (id, label
and vector alike) count once; rows that share an id but differ are rows each, and no row is a partner of its own id.
Missing dimensions count 0, an empty vector scores 0 everywhere. Ties go to the smaller id. A positive with a negative
score opens no window. An anchor without positives or negatives gives no rows; empty tables give none. Scores must
fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import frames
from tidemark.llm.topk import weights

REFERENCES = 12
SAMPLE = 256
ANCHOR_BLOCK = 1024
ROW_BLOCK = 8192
_TURN = 1e-6  # radians by which stored angles are taken to be wrong, well over what rounding does
_EXACT = float(1 << 52)  # products of norms below it leave integer sums exact in doubles


def dense(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as an integer matrix, missing dimensions 0."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def directions(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other: the first, then always the one with the greatest least angle to those taken."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors[norm > 0] / norm[norm > 0, None]
    taken: list[int] = []
    nearest = np.full(len(unit), -2.0)
    while len(taken) < min(count, len(unit)):
        at = int(np.argmin(nearest)) if taken else 0
        if taken and nearest[at] > 1 - 1e-12:
            break
        taken.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[taken]


def angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm, angle to each reference) of each row; a null vector's angles don't matter, for its norm is 0."""
    x = vectors.astype(float)
    norm = np.linalg.norm(x, axis=1)
    cosine = x @ references.T / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


class Rows:
    """A block of rows, or those of one label, ready to be bounded and scored."""

    def __init__(self, ids, label, vectors, norm, turn):
        self.ids, self.label, self.vectors, self.norm, self.turn = ids, label, vectors, norm, turn  # turn: reference, row
        self.most = float(norm.max()) if len(norm) else 0.0
        self.plain = vectors.astype(float) if self.most < 2 ** 50 else None

    def only(self, keep: np.ndarray) -> Rows:
        return Rows(self.ids[keep], self.label[keep], self.vectors[keep], self.norm[keep],
                    np.ascontiguousarray(self.turn[:, keep]))

    def bounds(self, norm: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that each row can have with an anchor of that norm and those angles."""
        reach = self.norm * norm
        if not len(turn):
            return -np.ceil(reach) - 1, np.ceil(reach) + 1
        apart = np.abs(self.turn - turn[:, None]).max(0)
        around = self.turn + turn[:, None]
        at_most = np.minimum(around, 2 * np.pi - around).min(0)
        slack = 1e-9 * reach + 1e-6
        low = np.ceil(reach * np.cos(np.minimum(at_most + _TURN, np.pi)) - slack)
        high = np.floor(reach * np.cos(np.maximum(apart - _TURN, 0)) + slack)
        return low, high

    def scores(self, at: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
        if self.plain is not None and norm * self.most < _EXACT:
            return (self.plain[at] @ vector.astype(float)).astype(np.int64)
        return self.vectors[at] @ vector


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def best_of_label(rows: Rows, anchor_id: int, vector, norm: float, turn, k: int):
    """(places, scores, how many were scored) of the anchor's k best rows among `rows`, which have its label."""
    others = np.flatnonzero(rows.ids != anchor_id)
    if not len(others):
        return others, np.zeros(0, np.int64), 0
    high = rows.bounds(norm, turn)[1][others]
    start = min(len(others), 4 * k)
    split = np.argpartition(high, len(others) - start)
    first, rest = split[len(others) - start:], split[:len(others) - start]
    score = rows.scores(others[first], vector, norm)
    if len(rest):
        least = np.partition(score, len(score) - k)[len(score) - k]
        rest = rest[high[rest] >= least]
        score = np.concatenate([score, rows.scores(others[rest], vector, norm)])
        first = np.concatenate([first, rest])
    at = others[first]
    best = _first(score, rows.ids[at], k)
    return at[best], score[best], len(at)


def in_windows(rows: Rows, anchor_id: int, label: int, vector, norm: float, turn, goals: np.ndarray, k: int,
               low: int, high: int):
    """(window, place, score) arrays of the k best rows of other labels in each goal's window; how many were scored."""
    least, most = rows.bounds(norm, turn)
    open_ = goals >= 0
    near = np.zeros(len(least), bool)
    for goal in np.unique(goals[open_]):
        near |= (100 * most >= low * goal) & (100 * least <= high * goal)
    at = np.flatnonzero(near & (rows.label != label) & (rows.ids != anchor_id))
    score = rows.scores(at, vector, norm)
    slots, places, values = [], [], []
    for slot in np.flatnonzero(open_):
        inside = np.flatnonzero((100 * score >= low * goals[slot]) & (100 * score <= high * goals[slot]))
        best = inside[_first(score[inside], rows.ids[at[inside]], k)]
        slots.append(np.full(len(best), slot)), places.append(at[best]), values.append(score[best])
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, places, values)]
    return (*joined, len(at))


def _labels(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = pa.chunked_array([*a.column("label").chunks, *b.column("label").chunks], a.schema.field("label").type)
    codes = codes.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return codes[:a.num_rows], codes[a.num_rows:]


def _rows(table: pa.Table, label: np.ndarray, dims: int) -> Rows:
    turn = np.stack(table.column("turn").to_numpy()) if table.num_rows else np.zeros((0, 0))
    return Rows(table.column("vec_id").to_numpy(), label, dense(table.column("w"), dims),
                table.column("norm").to_numpy(), np.ascontiguousarray(turn.T))


def _positives(k: int, dims: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            mine, theirs = _labels(anchors, rows)
            a, block = _rows(anchors, mine, dims), _rows(rows, theirs, dims)
            mark = anchors.column("mark").to_numpy()
            for label in np.unique(mine):
                part = block.only(theirs == label)
                for i in np.flatnonzero(mine == label):
                    at, score, _ = best_of_label(part, a.ids[i], a.vectors[i], a.norm[i], a.turn[:, i], k)
                    for x, v in zip(out, (np.full(len(at), a.ids[i]), np.full(len(at), mark[i]), part.ids[at], score)):
                        x.append(v)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out],
                        names=["anchor_id", "mark", "positive_id", "positive_score"])
    return run


def _negatives(k: int, dims: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if anchors.num_rows and rows.num_rows:
            mine, theirs = _labels(anchors, rows)
            a, block = _rows(anchors, mine, dims), _rows(rows, theirs, dims)
            mark, goals = anchors.column("mark").to_numpy(), anchors.column("goals").to_pylist()
            for i in range(len(a.ids)):
                slot, at, score, _ = in_windows(block, a.ids[i], a.label[i], a.vectors[i], a.norm[i], a.turn[:, i],
                                                np.array(goals[i], np.int64), k, low, high)
                for x, v in zip(out, (np.full(len(at), a.ids[i]), np.full(len(at), mark[i]), slot, block.ids[at], score)):
                    x.append(v)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out],
                        names=["anchor_id", "mark", "slot", "negative_id", "negative_score"])
    return run


def stored(rows: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
           scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, w, anchor, mark, norm, turn) of all rows that take part, written; and the number of dimensions."""
    spark = rows.sparkSession
    known = (rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("string").alias("label"),
                         weights(F.col(vector), scale).alias("w"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
             .where("vec_id is not null and label is not null and w is not null").distinct()
             .withColumn("mark", F.xxhash64("vec_id", "label", "w")))
    sample = known.select("mark", "w").orderBy("mark").limit(SAMPLE).toArrow()
    dims = max([1, *(len(w) for w in sample.column("w").to_pylist())])
    references = directions(dense(sample.column("w"), dims).astype(float))

    def measure(batches):
        for batch in batches:
            width = max([references.shape[1], *batch.column("w").value_lengths().to_pylist()])
            wide = np.zeros((len(references), width))
            wide[:, :references.shape[1]] = references
            norm, turn = angles(dense(batch.column("w"), width), wide)
            turns = pa.ListArray.from_arrays(np.arange(len(norm) + 1, dtype=np.int32) * turn.shape[1], turn.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), turns],
                                             names=[*batch.schema.names, "norm", "turn"])

    kept = frames.written(known.mapInArrow(
        measure, "vec_id long, label string, w array<long>, anchor boolean, mark long, norm double, turn array<double>"),
        "angles")
    return kept, kept.agg(F.coalesce(F.max(F.size("w")), F.lit(0))).first()[0]


def mined(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80,
          high: int = 100, **columns) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each anchor and each of its `positives` best rows of the same label: the first `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    known, dims = stored(rows, is_anchor, label, **columns)
    count = known.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    row_blocks, anchor_blocks = (max(1, -(-n // size)) for n, size in zip(count, (ROW_BLOCK, ANCHOR_BLOCK)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = known.withColumn("ab", F.pmod("mark", F.lit(anchor_blocks)).cast("int"))
    dealt = dealt.withColumn("rb", F.pmod(F.shiftright("mark", 20), F.lit(row_blocks)).cast("int"))
    anchors = dealt.where("anchor").drop("rb", "anchor")
    others = dealt.drop("ab", "anchor", "mark").withColumn("ab", every(anchor_blocks))
    others = others.toDF(*others.columns).groupBy("ab", "rb")  # columns of their own, to tell both sides apart

    def met(side: DataFrame, work, schema: str) -> DataFrame:
        side = side.withColumn("rb", every(row_blocks))
        return side.groupBy("ab", "rb").cogroup(others).applyInArrow(work, schema)

    order = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("positive_score"), "positive_id")
    best = met(anchors, _positives(positives, dims), "anchor_id long, mark long, positive_id long, positive_score long")
    best = frames.written(best.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives),
                          "positives")
    goals = best.groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"])
        .alias("goals"))
    found = met(anchors.join(goals, ["vec_id", "mark"]), _negatives(negatives, dims, low, high),
                "anchor_id long, mark long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "mark", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(best.withColumn("slot", F.col("slot").cast("long")), ["anchor_id", "mark", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
