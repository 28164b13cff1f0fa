"""Ordered work inside a key, safe when one key holds a large part of the table.

A plain window sends a whole key to one task. Here every key is cut into lanes
(monotone chunks of the order column), worked lane by lane, and stitched from
one small row per lane. Nothing runs while a plan is built, and no key takes
another way than the others.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timefn import epoch

LANE_IDS = 1_000_000


def id_lane(c, width: int = LANE_IDS) -> Column:
    """Lane of an id or number: consecutive values share a lane."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(width))


def hour_lane(c) -> Column:
    """Lane of a timestamp: one per hour."""
    return F.floor(epoch(c) / F.lit(3600))


#: stands for the lane of a null order value, which comes first
_FIRST_LANE = -(1 << 62)


class _Level:
    """Steps that need nothing from each other: their columns come from one pass over the lanes."""

    def __init__(self, known: DataFrame):
        self.known = known  # for analysis alone: the columns the steps may use
        self.made: dict = {}  # types of the columns the steps make
        self.local, self.whole, self.ends, self.carried, self.merged = {}, {}, {}, {}, {}
        self.reach = 0
        self.shifted: dict[str, tuple] = {}

    def can_use(self, exprs) -> bool:
        log = logging.getLogger("DataFrameQueryContextLogger")
        before, log.disabled = log.disabled, True  # that a column is not there yet is no error here
        try:
            return self.known.select(*exprs).schema is not None
        except AnalysisException:
            return False
        finally:
            log.disabled = before


class KeyedSequence:
    """The rows of each key in order. Each method adds columns; `frame()` gives the result.

    `order` must be total within a key. `lane` must never decrease along
    `order`; for a descending order pass the negated lane. Rows equal in all
    order columns share a lane.

    Rows are dealt by (key, lane) and worked lane by lane; a summary with one
    row per lane gives each lane what comes from the lanes before and after it.
    So a key of any size is spread, and there is one path for all keys. Steps
    are collected and grouped into levels: a step joins the first level that
    knows the columns it reads. A level is one exchange, which its lane pass and
    its summary both read; the source is read once, whatever the chain.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], lane: Column):
        self._df, self.keys, self.order, self._lane = df, list(keys), list(order), lane
        self._levels = [_Level(df)]

    @property
    def _by_lane(self):
        return Window.partitionBy("_key", "_lane").orderBy(*self.order)

    def _level(self, exprs: Sequence[Column]) -> _Level:
        for level in self._levels:
            if level.can_use(exprs):
                return level
        last = self._levels[-1]
        level = _Level(last.known.withColumns({n: F.lit(None).cast(t) for n, t in last.made.items()}))
        if not last.made or not level.can_use(exprs):
            raise ValueError("a step reads a column that no step before it makes")
        self._levels.append(level)
        return level

    @staticmethod
    def _made(level: _Level, columns: Mapping[str, Column]) -> None:
        """Remember the types of a step's columns for the levels after it."""
        fields = level.known.select(*[e.alias(n) for n, e in columns.items()]).schema
        level.made.update({f.name: f.dataType for f in fields})

    def shift(self, columns: Mapping[str, tuple]) -> "KeyedSequence":
        """{new: (source, offset)}: positive offsets look ahead, negative ones back."""
        sources = {n: F.col(s) if isinstance(s, str) else s for n, (s, _) in columns.items()}
        level = self._level(list(sources.values()))
        self._made(level, sources)
        for new, (_, offset) in columns.items():
            level.shifted[new] = (sources[new], offset)
            level.reach = max(level.reach, abs(offset))
        return self

    def running(self, columns: Mapping[str, Column], op: str = "sum") -> "KeyedSequence":
        """Running sum, max or min up to and including the row."""
        level = self._level(list(columns.values()))
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[op]
        self._made(level, {n: agg(e).over(Window.partitionBy(F.lit(0))) for n, e in columns.items()})
        zero = F.lit(0)
        for n, e in columns.items():
            level.local[n] = lambda by, e=e: agg(e).over(by.rowsBetween(Window.unboundedPreceding, 0))
            level.whole["_s_" + n] = agg(e)
            level.carried["_c_" + n] = lambda before, _, n=n: agg("_s_" + n).over(before)
            own, past = F.col(n), F.col("_c_" + n)
            level.merged[n] = {
                "max": F.greatest(own, past), "min": F.least(own, past),
                "sum": F.when(own.isNotNull() | past.isNotNull(), F.coalesce(own, zero) + F.coalesce(past, zero)),
            }[op]
        return self

    def total(self, columns: Mapping[str, Column]) -> "KeyedSequence":
        """Sums over the whole key, next to every row."""
        level = self._level(list(columns.values()))
        self._made(level, {n: F.sum(e).over(Window.partitionBy(F.lit(0))) for n, e in columns.items()})
        for n, e in columns.items():
            level.whole["_s_" + n] = F.sum(e)
            level.carried["_c_" + n] = lambda _, whole, n=n: F.sum("_s_" + n).over(whole)
            level.merged[n] = F.col("_c_" + n)
        return self

    def number(self, new: str = "row_num") -> "KeyedSequence":
        """Row number from 1."""
        return self.running({new: F.lit(1).cast("long")})

    def number_where(self, columns: Mapping[str, Column]) -> "KeyedSequence":
        """Row number among the rows where a predicate holds; null elsewhere."""
        self.running({n: F.when(p, 1).otherwise(0).cast("long") for n, p in columns.items()})
        for level in self._levels:
            for n, p in columns.items():
                if n in level.merged:
                    level.merged[n] = F.when(p, level.merged[n])
        return self

    def rank(self, new: str = "rank") -> "KeyedSequence":
        """Rank with gaps."""
        level = self._level([F.lit(1)])
        self._made(level, {new: F.lit(1).cast("long")})
        level.local[new] = lambda by: F.rank().over(by).cast("long")
        level.whole["_s_" + new] = F.count(F.lit(1))
        level.carried["_c_" + new] = lambda before, _: F.sum("_s_" + new).over(before)
        level.merged[new] = F.col(new) + F.coalesce("_c_" + new, F.lit(0))
        return self

    def fill(self, columns: Mapping[str, Column]) -> "KeyedSequence":
        """The latest non-null value up to and including the row."""
        level = self._level(list(columns.values()))
        self._made(level, columns)
        for n, e in columns.items():
            level.local[n] = lambda by, e=e: F.last(e, ignorenulls=True).over(
                by.rowsBetween(Window.unboundedPreceding, 0))
            level.ends["_s_" + n] = F.max_by(F.struct(F.col(n).alias("v")), "_lane_pos")
            level.carried["_c_" + n] = lambda before, _, n=n: F.last(
                F.col("_s_" + n)["v"], ignorenulls=True).over(before)
            level.merged[n] = F.coalesce(F.col(n), F.col("_c_" + n))
        return self

    def _worked(self, df: DataFrame, level: _Level) -> DataFrame:
        base = df.repartition("_key", "_lane")
        by = self._by_lane
        local = {n: make(by) for n, make in level.local.items()}
        whole, carried, merged = dict(level.whole), dict(level.carried), dict(level.merged)
        reach = level.reach
        if level.ends or reach:
            local["_lane_pos"] = F.row_number().over(by)
        if reach:
            local["_lane_rest"] = sum((F.when(F.lead(F.lit(1), q).over(by).isNotNull(), 1).otherwise(0)
                                  for q in range(1, reach + 1)), F.lit(0))
            for n, (source, offset) in level.shifted.items():
                local[n] = (F.lead if offset > 0 else F.lag)(source, abs(offset)).over(by)
            values = [source.alias(f"v{k}") for k, (source, _) in enumerate(level.shifted.values())]
            ends = {  # the first and the last rows of a lane, nearest to its edge first
                "_lane_head": F.when(F.col("_lane_pos") <= reach, F.struct(F.col("_lane_pos").alias("k"), *values)),
                "_lane_tail": F.when(F.col("_lane_rest") < reach, F.struct(F.col("_lane_rest").alias("k"), *values))}
            for name, row in ends.items():
                whole[name] = F.sort_array(F.collect_list(row))
            near = lambda name, step, window: F.slice(F.flatten(F.array(*[
                F.coalesce(step(name, q).over(window), F.slice(F.col(name), 1, 0))
                for q in range(1, reach + 1)])), 1, reach)
            lanes = Window.partitionBy("_key").orderBy("_lane")
            carried["_lane_after"] = lambda *_: near("_lane_head", F.lead, lanes)
            carried["_lane_before"] = lambda *_: near("_lane_tail", F.lag, lanes)
            for k, (n, (_, offset)) in enumerate(level.shifted.items()):
                inside = F.col("_lane_rest") if offset > 0 else F.least(F.col("_lane_pos") - 1, F.lit(reach))
                beyond = F.get(F.col("_lane_after" if offset > 0 else "_lane_before"), F.lit(abs(offset) - 1) - inside)
                merged[n] = F.when(inside >= abs(offset), F.col(n)).otherwise(beyond[f"v{k}"])
        lane_pass = base.withColumns(local) if local else base
        # what a lane is in sum; from the lane pass only where its windows are needed
        summary = (lane_pass if level.ends or reach else base).groupBy("_key", "_lane").agg(
            *[e.alias(n) for n, e in {**whole, **level.ends}.items()])
        along = Window.partitionBy("_key").orderBy("_lane")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        lanes = summary.select("_key", "_lane", *[
            make(before, Window.partitionBy("_key")).alias(n) for n, make in carried.items()])
        out = lane_pass.join(lanes, ["_key", "_lane"]).withColumns(merged)
        return out.drop("_lane_pos", "_lane_rest", *carried)

    def frame(self) -> DataFrame:
        lane = F.coalesce(self._lane.cast("long"), F.lit(_FIRST_LANE))
        # a struct of the keys is equal to itself also where they are null
        out = self._df.withColumns({"_lane": lane, "_key": F.struct(*self.keys)})
        for level in self._levels:
            if level.merged or level.shifted:
                out = self._worked(out, level)
        return out.drop("_lane", "_key")


#: rows of one key, or of a bucket of keys, that are no burden to a task, whatever the others hold
FEW = 1 << 12


def key_buckets(df: DataFrame, rows: int, width: int) -> int:
    """Into how many buckets the keys of `rows` rows are dealt: `width` rows to a bucket, but some for every task."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // width)


def alone(df: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    """Whether a row's key shares its bucket, by hash, with no key of many rows: such keys can be worked whole.

    A bucket is too full at twice the rows of the mean one. Rows are counted where they are, one number a bucket comes
    to the driver, and nothing is joined. `df` is read for that: hand in a written frame.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    counts = {r[0]: r[1] for r in df.select(bucket.alias("b")).groupBy("b").agg(F.count(F.lit(1))).collect()}
    most = max(FEW, 2 * sum(counts.values()) // buckets)
    return ~bucket.isin([b for b, n in counts.items() if n > most])


def row_numbers(df, keys, order, lane, new="row_num") -> DataFrame:
    return KeyedSequence(df, keys, order, lane).number(new).frame()


def ranks(df, keys, order, lane, new="rank") -> DataFrame:
    return KeyedSequence(df, keys, order, lane).rank(new).frame()


def percent_ranks(df, keys, order, lane, new="percent_rank") -> DataFrame:
    """(rank - 1) / (rows - 1), zero for a single row."""
    seq = KeyedSequence(df, keys, order, lane).rank("_rank").total({"_rows": F.lit(1)})
    value = F.when(F.col("_rows") > 1, (F.col("_rank") - 1) / (F.col("_rows") - 1)).otherwise(0.0)
    return seq.frame().withColumn(new, value).drop("_rank", "_rows")


def first_by(df: DataFrame, keys, columns, order, latest: bool = False) -> DataFrame:
    """One row per key, the first (or latest) by `order`: an aggregate, so hot keys shrink map-side."""
    pick = F.max_by if latest else F.min_by
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in
                      ([order] if isinstance(order, (str, Column)) else order)])
    row = F.struct(*columns)
    return (df.groupBy(*keys).agg(pick(row, rank).alias("_row"))
            .select(*keys, *[F.col("_row." + c).alias(c) for c in columns]))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
         columns: Sequence[str], side: str = "before", strict: bool = True,
         tie: str | None = None, count: str | None = None, lane=hour_lane) -> DataFrame:
    """For each left row the nearest right row before (or after) it; unmatched rows keep nulls.

    Left and right rows are laid into one sequence per key and the right row is
    carried along it, so no pairs are formed. `tie` orders right rows of equal
    time: the greatest wins. `count` names a column with the number of right rows
    on that side.
    """
    ahead = side == "after"
    payload = F.struct(*columns)
    names = left.columns
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    # left rows without a key match nothing: they are spread instead of meeting in one task
    spread = F.when(keyless, F.pmod(F.xxhash64(*names), F.lit(4096)) + 1).otherwise(F.lit(0))
    lrow = left.select(*keys, spread.cast("long").alias("_salt"), F.col(left_at).alias("_at"), F.lit(0 if strict else 1).alias("_side"),
                       F.lit(None).cast("long").alias("_tie"),
                       F.struct(*[F.col(c) for c in names]).alias("_left"),
                       F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
                       .alias("_right"))
    known = F.col(right_at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rrow = right.filter(known).select(
        *keys, F.lit(0).cast("long").alias("_salt"), F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"),
        (F.col(tie) if tie else F.lit(None)).cast("long").alias("_tie"),
        F.lit(None).cast(lrow.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    both = lrow.unionByName(rrow)
    mark = lane("_at")
    if ahead:
        order = [F.col("_at").desc_nulls_first(), F.col("_side"), F.col("_tie")]
        mark = -mark
    else:
        order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_tie")]
    seq = KeyedSequence(both, [*keys, "_salt"], order, mark).fill({"_near": F.col("_right")})
    extra = []
    if count:
        seq.running({"_count": F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long")})
        extra = [F.col("_count").alias(count)]
    return (seq.frame().filter(F.col("_left").isNotNull())
            .select("_left.*", *[F.col("_near." + c).alias(c) for c in columns], *extra))


def spread_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on `key`: left rows without a key match nothing and are spread instead of meeting in one task."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(4096)) + 1).otherwise(F.lit(0))
    same = F.pmod(F.xxhash64(key), F.lit(1))  # 0; a plain literal would be folded out of the join's keys
    return (left.withColumn("_salt", salt.cast("long")).join(right.withColumn("_salt", same), [key, "_salt"], "left")
            .drop("_salt"))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column,
              right_at: Column, below: int, above: int) -> DataFrame:
    """Inner join on keys where right_at lies in [left_at - below, left_at + above] (integers).

    Both sides carry a bucket of the band's width as a further equality key, so
    a large key is spread over time and only neighbouring buckets meet.
    """
    width = F.lit(below + above + 1)
    lo, hi = F.floor((F.col("_l") - below) / width), F.floor((F.col("_l") + above) / width)
    lhs = left.withColumn("_l", left_at).withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    rhs = right.withColumn("_r", right_at).withColumn("_bucket", F.floor(F.col("_r") / width))
    met = lhs.join(rhs, [*keys, "_bucket"])
    return met.filter((F.col("_r") - F.col("_l")).between(-below, above)).drop("_bucket", "_l", "_r")


#: a sketch of a group is off by a rank of one in SKETCH at most; groups up to WHOLE rows need none
SKETCH, WHOLE = 2000, 20_000


def exact_percentiles(df: DataFrame, dims: Sequence[str], value: str,
                      probs: Mapping[str, float], kind: str = "cont", accuracy: int = SKETCH,
                      whole: int = WHOLE) -> DataFrame:
    """Exact percentiles per group, `cont` interpolated or `disc`; a group of any size is spread.

    A mergeable quantile sketch of each group, built where the rows are, brackets every wanted rank by two values. Of
    the rows below a bracket only the number counts, rows above it don't; so both are summed up before they are sent,
    and only the few values inside a bracket are put in order. Small groups are one bracket. A rank that should lie
    outside its bracket, against the sketch's bound, ends the query with an error instead of a wrong value.
    The rows are read twice: hand in a checkpointed frame where they are costly.
    """
    known = df.filter(F.col(value).isNotNull()).select(*dims, F.col(value).alias("_v"))
    names, margin = list(probs), 2.0 / accuracy
    sides = [max(0.0, min(1.0, probs[n] + way * margin)) for n in names for way in (-1, 1)]
    sketch = known.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(
        "_v", F.array(*map(F.lit, sides)), F.lit(accuracy)).alias("_cuts"))
    sketch = sketch.withColumn("_cuts", F.when(F.col("_n") > whole, F.col("_cuts")))
    sketch = sketch.withColumnsRenamed({d: f"_d{k}" for k, d in enumerate(dims)})
    same = F.lit(True)
    for k, d in enumerate(dims):
        same = same & F.col(d).eqNullSafe(F.col(f"_d{k}"))
    met = known.join(sketch, same)

    def side(k: int, way: int) -> Column:
        """The bracket's edge; none where it would lie beyond the first or the last row."""
        inner = 0 < probs[names[k]] + (2 * way - 1) * margin < 1
        return F.get("_cuts", F.lit(2 * k + way)) if inner else F.lit(None)

    spots = F.array(*[F.when(F.coalesce(F.col("_v") > side(k, 1), F.lit(False)), None).otherwise(F.struct(
        F.lit(k).alias("_k"), F.when(~F.coalesce(F.col("_v") < side(k, 0), F.lit(False)), F.col("_v")).alias("_in")))
        for k in range(len(names))])
    counted = (met.select(*dims, "_n", F.inline(F.array_compact(spots))).groupBy(*dims, "_n", "_k", "_in")
               .agg(F.count(F.lit(1)).alias("_c")))
    along = Window.partitionBy(*dims, "_n", "_k").orderBy(F.col("_in").asc_nulls_first())  # the values of one bracket
    placed = counted.withColumn("_hi", F.sum("_c").over(along)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    lost = F.raise_error(F.lit(f"a rank of {value} lies outside its bracket")).cast(known.schema["_v"].dataType)

    def at(k: int, index: Column) -> Column:
        inside = F.col("_in").isNotNull() & (F.col("_lo") <= index) & (index < F.col("_hi"))
        return F.coalesce(F.max(F.when((F.col("_k") == k) & inside, F.col("_in"))), lost)

    aggs = []
    for k, name in enumerate(names):
        if kind == "disc":
            aggs.append(at(k, F.greatest(F.ceil(F.col("_n") * F.lit(probs[name])) - 1, F.lit(0))).alias(name))
        else:
            spot = (F.col("_n") - 1) * F.lit(probs[name])
            low, high = at(k, F.floor(spot)), at(k, F.ceil(spot))
            part = F.max(spot - F.floor(spot))
            aggs.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*dims).agg(*aggs)
