"""Which intervals of a key cover a point, without pairs, copies of points or a join on the bare key.

A key is worked whole, its points and intervals meeting once, unless it or another of its group has many rows. For those
time is cut into cells, cells into larger cells (`CELL_BITS`). An interval is a piece in the cell it begins in, a piece
in the cell it ends in, and between them a run of whole cells, which is an interval again one level up, where cells
stand for points. Levels are worked from the largest cells down: what covers a whole cell comes to the next level as one
piece of that cell. On a level everything is dealt by (key, cell), so a key of any size spreads over time; above the
first level equal pieces are aggregated first, so that a cell holds a bounded number of them.

Within a cell or a whole key points lie in order, and an interval is a range of their places. Largest and least values come from a
sparse table: a range is two overlapping blocks of a power of two of places, blocks are laid into the table level by
level and pushed down to their halves. Sums come from differences. Both work on whole Arrow batches of many cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from tidemark.functions.timefn import micros
from tidemark.operators.ordered import alone, key_buckets
from tidemark.session import checkpointed

#: cells of 2^36 microseconds (19 hours), of 1024 of these (2 years), and two for all time
CELL_BITS = (36, 10, 20)
#: points and pieces that meet in one group, on average: what a group holds does not grow with the tables
GROUP_ROWS = 1 << 18
_NONE = {"max": -(1 << 63), "min": (1 << 63) - 1}


def place_ranges(point_group, point_at, group, first, last):
    """(order of the points, begin, end): the places, in that order, of the points that each interval covers."""
    times = np.unique(point_at)
    wide = len(times) + 1
    key = point_group * wide + np.searchsorted(times, point_at)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.searchsorted(key, group * wide + np.searchsorted(times, first))
    end = np.searchsorted(key, group * wide + np.searchsorted(times, last, side="right"))
    return order, begin, np.maximum(begin, end)


def range_extremes(n: int, begin: np.ndarray, end: np.ndarray, value: np.ndarray, op: str) -> np.ndarray:
    """For each of n places the greatest (or least) value of the ranges that hold it; `_NONE[op]` where none does."""
    better = np.maximum if op == "max" else np.minimum
    some = end > begin
    begin, end, value = begin[some], end[some], value[some]
    level = np.frexp((end - begin).astype(float))[1] - 1  # the greatest power of two within the range
    out = np.full(n, _NONE[op], np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        half = 1 << k
        pushed = out.copy()  # blocks of twice the size fall into their halves
        pushed[half:] = better(pushed[half:], out[:n - half])
        if k == level.max(initial=0):
            pushed[:] = _NONE[op]
        here = level == k
        better.at(pushed, begin[here], value[here])
        better.at(pushed, end[here] - half, value[here])
        out = pushed
    return out


def range_sums(n: int, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, value)
    np.add.at(step, end, -value)
    return np.cumsum(step)[:n]


def _group_codes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """A number for each distinct combination of the columns."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        column = table.column(c).combine_chunks().dictionary_encode()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        kinds = len(column.dictionary)
        code = np.unique(code * (kinds + 1) + column.indices.fill_null(kinds).to_numpy(), return_inverse=True)[1]
    return code


def _stab(by: Sequence[str], kept: Sequence[str], ops: Mapping[str, str]):
    """The points of a table of points and pieces, with the aggregates of the pieces that cover each.

    Pieces have no nulls in `by` and times; points that do lie in groups of their own, those without a time in group -1.
    """
    def run(table: pa.Table) -> pa.Table:
        is_point = table.column("_point").to_numpy()
        code = _group_codes(table, by)
        points, pieces = table.filter(pa.array(is_point)), table.filter(pa.array(~is_point))
        at = points.column("_a")
        group = np.where(at.is_valid().to_numpy(), code[is_point], -1)
        order, begin, end = place_ranges(group, at.fill_null(0).to_numpy(), code[~is_point],
                                         pieces.column("_a").to_numpy(), pieces.column("_b").to_numpy())
        columns = [points.column(c) for c in kept]
        for name, op in ops.items():
            value = pieces.column(name)
            known = value.is_valid().to_numpy()
            b, e, v = begin[known], end[known], value.drop_null().to_numpy()
            if op == "sum":
                found, none = range_sums(len(order), b, e, v), range_sums(len(order), b, e, np.ones(len(b), np.int64)) == 0
            else:
                found = range_extremes(len(order), b, e, v, op)
                none = found == _NONE[op]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            columns.append(pa.array(found[back], pa.int64(), mask=none[back]))
        return pa.table(columns, names=[*kept, *ops])
    return run


def covered(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
            aggs: Mapping[str, tuple]) -> DataFrame:
    """All points, each with aggregates over the intervals of its key that contain it (ends included), null if none does.

    `aggs` is {new: (op, column)} with op max, min or sum over whole numbers. Times count in microseconds. Rows
    with a null in a key or a time, and intervals that end before they begin, match nothing.
    """
    kinds = {new: intervals.schema[column].dataType for new, (_, column) in aggs.items()}
    wrong = [new for new, kind in kinds.items() if not isinstance(kind, IntegralType)]
    if wrong:
        raise TypeError(f"aggregates of {wrong}: only whole numbers can be looked up")
    ops = {new: op for new, (op, _) in aggs.items()}
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # both sides are read more than once: they are computed once, and a lost executor costs no more than a read
    spans = checkpointed(intervals.filter(known).select(
        *keys, micros(start).alias("_a"), micros(end).alias("_b"),
        *[F.col(column).cast("long").alias(new) for new, (_, column) in aggs.items()]).filter("_a <= _b"))
    timed = checkpointed(points.withColumn("_a", micros(at)))
    usable = F.coalesce(known & F.col("_a").isNotNull(), F.lit(False))
    buckets = key_buckets(timed, timed.count() + 2 * spans.count(), GROUP_ROWS)
    whole = alone(timed.filter(usable).select(*keys).unionByName(spans.select(*keys)), keys, buckets)
    found = _met(timed.filter(~usable | whole), spans.filter(whole), keys, points.columns, ops, usable, buckets)
    spread = usable & ~whole
    if not spans.filter(~whole).isEmpty():
        found = found.unionByName(_covered_in_cells(
            timed.filter(spread), spans.filter(~whole), keys, points.columns, ops, usable, buckets))
    else:
        found = found.unionByName(timed.filter(spread).select(
            *points.columns, *[F.lit(None).cast("long").alias(new) for new in ops]))
    return found.select(*points.columns, *[F.col(new).cast(kind).alias(new) for new, kind in kinds.items()])


def _met(units: DataFrame, pieces: DataFrame, by: Sequence[str], kept: Sequence[str], ops: Mapping[str, str],
         usable: Column, buckets: int) -> DataFrame:
    """Units with the aggregates of the pieces equal in `by` that cover them, dealt by `by`."""
    both = units.withColumn("_point", F.lit(True)).unionByName(
        pieces.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    schema = StructType([*[units.schema[c] for c in kept], *[StructField(new, LongType()) for new in ops]])
    # points that match nothing are spread instead of meeting in one task
    place = F.when(usable, F.xxhash64(*by)).otherwise(F.xxhash64(*kept))
    return (both.withColumn("_bucket", F.pmod(place, F.lit(buckets)))
            .groupBy("_bucket").applyInArrow(_stab(by, kept, ops), schema))


def _covered_in_cells(timed: DataFrame, spans: DataFrame, keys: Sequence[str], columns: Sequence[str],
                      ops: Mapping[str, str], usable: Column, buckets: int) -> DataFrame:
    """Points of keys of any size, spread over cells of time."""
    levels = []  # (points, pieces) from the smallest cells up
    units = timed
    for level, bits in enumerate(CELL_BITS):
        spans = spans.withColumns({"_l": F.expr(f"shiftright(_a, {bits})"), "_r": F.expr(f"shiftright(_b, {bits})")})
        ends = F.array(
            F.struct(F.col("_l").alias("_cell"), F.col("_a"),
                     F.expr(f"least(_b, shiftleft(_l + 1, {bits}) - 1)").alias("_b")),
            F.when(F.col("_l") < F.col("_r"), F.struct(
                F.col("_r").alias("_cell"), F.expr(f"shiftleft(_r, {bits})").alias("_a"), F.col("_b"))))
        pieces = spans.select(*keys, F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("_x"), *ops).select(
            *keys, "_x.*", *ops)
        if level:  # one row for equal pieces
            pieces = pieces.groupBy(*keys, "_cell", "_a", "_b").agg(
                *[getattr(F, op)(new).alias(new) for new, op in ops.items()])
        cell = F.expr(f"shiftright(_a, {bits})")
        levels.append((units.withColumn("_cell", cell), pieces))
        units = units.filter(usable).select(*keys, cell.alias("_a")).distinct()
        spans = spans.filter("_r - _l > 1").select(*keys, (F.col("_l") + 1).alias("_a"), (F.col("_r") - 1).alias("_b"), *ops)

    found = None
    for level in reversed(range(len(levels))):
        units, pieces = levels[level]
        if found is not None:  # what covers a whole cell of this level
            bits = CELL_BITS[level]
            pieces = pieces.unionByName(found.select(
                *keys, F.col("_a").alias("_cell"), F.expr(f"shiftleft(_a, {bits})").alias("_a"),
                F.expr(f"shiftleft(_a + 1, {bits}) - 1").alias("_b"), *ops))
        kept = [*columns] if level == 0 else [*keys, "_a"]
        found = _met(units, pieces, [*keys, "_cell"], kept, ops, usable, buckets)
        if level:
            found = found.filter(" or ".join(f"{new} is not null" for new in ops))
    return found


def covering(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_id: Sequence[str],
             at: str, start: str, end: str, aggs: Mapping[str, tuple]) -> DataFrame:
    """Per point that an interval of its key contains, by `point_id`, the aggregates over these intervals."""
    counted = covered(points.select(*dict.fromkeys([*point_id, *keys, at])), intervals.withColumn("_one", F.lit(1)), keys, at, start, end,
                      {**aggs, "_n": ("sum", "_one")})
    return counted.filter("_n > 0").select(*point_id, *aggs)
