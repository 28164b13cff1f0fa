"""Lanes must give what a plain window gives."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import ordered as od
from tidemark.operators.intervals import covered, covering, range_extremes, range_sums

@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        # one key holds most rows, one key is null, some keys have a single row
        key = 1 if i % 3 else rng.choice([None, 2, 3, 4, 100 + i])
        rows.append((i, key, rng.randrange(6), rng.randrange(1000)))
    return spark.createDataFrame(rows, "id long, k long, code int, v long").repartition(4).cache()


def lane():
    return od.id_lane("id", 37)


def seq(log):
    return od.KeyedSequence(log, ["k"], [F.col("id")], lane())


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_shift(log):
    w = Window.partitionBy("k").orderBy("id")
    want = log.withColumns({"a": F.lead("v", 1).over(w), "b": F.lead("code", 2).over(w),
                            "c": F.lag("v", 1).over(w)})
    got = seq(log).shift({"a": ("v", 1), "b": ("code", 2), "c": ("v", -1)}).frame()
    assert rows(got, "id", "a", "b", "c") == rows(want, "id", "a", "b", "c")


def test_number_running_and_predicate(log):
    w = Window.partitionBy("k").orderBy("id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumns({
        "n": F.row_number().over(w).cast("long"), "s": F.sum("v").over(up), "m": F.max("v").over(up),
        "p": F.when(F.col("code") == 3, F.sum(F.when(F.col("code") == 3, 1).otherwise(0)).over(up))})
    got = (seq(log).number("n").running({"s": F.col("v")}).running({"m": F.col("v")}, "max")
           .number_where({"p": F.col("code") == 3}).frame())
    assert rows(got, "id", "n", "s", "m", "p") == rows(want, "id", "n", "s", "m", "p")


def test_fill_then_shift(log):
    w = Window.partitionBy("k").orderBy("id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("code") == 0, F.col("v"))
    want = log.withColumn("f", F.last(value, ignorenulls=True).over(up)).withColumn(
        "g", F.lag("f").over(w))
    got = seq(log).fill({"f": value}).shift({"g": ("f", -1)}).frame()
    assert rows(got, "id", "f", "g") == rows(want, "id", "f", "g")


def test_descending_order(log):
    w = Window.partitionBy("k").orderBy(F.col("id").desc())
    want = log.withColumn("n", F.row_number().over(w).cast("long"))
    got = od.KeyedSequence(log, ["k"], [F.col("id").desc()], -lane()).number("n").frame()
    assert rows(got, "id", "n") == rows(want, "id", "n")


def test_rank_and_percent_rank_with_ties(log):
    w = Window.partitionBy("k").orderBy("code", "v")
    want = log.withColumns({"r": F.rank().over(w).cast("long"), "p": F.percent_rank().over(w)})
    got = od.ranks(log, ["k"], [F.col("code"), F.col("v")], F.col("code"), "r")
    assert rows(got, "id", "r") == rows(want, "id", "r")
    got = od.percent_ranks(log, ["k"], [F.col("code"), F.col("v")], F.col("code"), "p")
    assert rows(got, "id", "p") == rows(want, "id", "p")


@pytest.mark.parametrize("side", ["before", "after"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_against_brute_force(spark, side, strict):
    rng = random.Random(3)
    left = [(i, 1 if i % 3 else rng.choice([2, None, 9]), rng.randrange(60)) for i in range(200)]
    right = [(i, 1 if i % 4 else 2, rng.randrange(60)) for i in range(150)]
    stamp = lambda df, c: df.withColumn(c, F.timestamp_add(
        "MINUTE", F.col(c), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    ldf = stamp(spark.createDataFrame(left, "lid long, k long, lt int"), "lt")
    rdf = stamp(spark.createDataFrame(right, "rid long, k long, rt int"), "rt")
    got = od.asof(ldf, rdf, ["k"], "lt", "rt", ["rid"], side=side, strict=strict, tie="rid",
                  count="n")
    assert got.count() == 200
    for row in got.collect():
        at = next(x[2] for x in left if x[0] == row.lid)
        if side == "before":
            ok = [r for r in right if r[1] == row.k and (r[2] < at or (not strict and r[2] == at))]
            best = max(ok, key=lambda r: (r[2], r[0]), default=None)
        else:
            ok = [r for r in right if r[1] == row.k and (r[2] > at or (not strict and r[2] == at))]
            best = min(ok, key=lambda r: (r[2], -r[0]), default=None)
        assert row.rid == (best[0] if best else None)
        if row.k is not None:
            assert row.n == len(ok)


def _covered(spark, points, spans):
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c), base)
    p = spark.createDataFrame(points, "pid long, k long, t long").withColumn("t", at("t"))
    s = spark.createDataFrame(spans, "sid long, k long, a long, b long").withColumns({"a": at("a"), "b": at("b")})
    return {r.pid: (r.top, r.low, r.total) for r in covering(
        p, s, ["k"], ["pid"], "t", "a", "b",
        {"top": ("max", "sid"), "low": ("min", "sid"), "total": ("sum", "sid")}).collect()}


def _hits(points, spans):
    out = {}
    for pid, k, t in points:
        hit = [x[0] for x in spans if k is not None and x[1] == k and None not in (t, x[2], x[3])
               and x[2] <= t <= x[3]]
        if hit:
            out[pid] = (max(hit), min(hit), sum(hit))
    return out


def test_covering_against_brute_force(spark):
    rng = random.Random(11)
    second, year = 10**6, 366 * 86400 * 10**6
    points = [(i, rng.choice([1, 1, 2, None]), 1_700_000_000 * second + rng.randrange(5000 * second))
              for i in range(120)]
    spans = []
    for i in range(90):
        a = 1_700_000_000 * second + rng.randrange(5000 * second)
        spans.append((i, rng.choice([1, 1, 2, None]), a, a + rng.choice([0, 1, 2, 3, 7, 300 * second, 2000 * second])))
    # dates from 1900 to 9999, open and reversed ends, ends to the microsecond
    early, late = -70 * year, 8000 * year
    points += [(200 + i, 1, t) for i, t in enumerate(
        [early, -13 * year, -12 * year - 1, -1, 0, 1, late, spans[0][2], spans[0][3], spans[1][2] - 1, spans[1][3] + 1])]
    spans += [(300, 1, early, late), (301, 1, -20 * year, -10 * year), (302, 1, 0, late), (303, 1, None, late),
              (304, 1, early, None), (305, 1, 5, 4), (306, 2, early, late), (307, 1, -3, 3)]
    spans += [(400 + i, 1, t, t) for i, t in enumerate([-1, 0, 1])]
    assert _covered(spark, points, spans) == _hits(points, spans)


def test_covering_of_random_powers(spark):
    rng = random.Random(2)
    points = [(i, 1, rng.randrange(-300, 300)) for i in range(150)]
    spans = []
    for i in range(150):
        a = rng.randrange(-300, 300)
        spans.append((i, 1, a, a + rng.choice([0, 1, 2, 3, 4, 7, 8, 15, 16, 31, 63, 64, 127, 255])))
    assert _covered(spark, points, spans) == _hits(points, spans)


def test_covered_keeps_all_points_and_their_columns(spark):
    base = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda c: F.timestamp_add("HOUR", F.col(c), base)
    points = [(1, "x", "u", 5), (1, "x", "u", 5), (2, "x", None, 5), (3, "x", "u", None), (4, "y", "u", 5), (None, "x", "u", 900)]
    spans = [("x", "u", 0, 10, 7), ("x", "u", -9000, 90000, 3), ("x", "u", 5, 5, None), ("x", None, 0, 10, 99), ("y", "v", 0, 10, 9)]
    p = spark.createDataFrame(points, "pid int, k string, m string, t int").withColumns({"t": at("t"), "_n": F.lit("z")})
    s = spark.createDataFrame(spans, "k string, m string, a int, b int, v int").withColumns({"a": at("a"), "b": at("b")})
    got = covered(p, s, ["k", "m"], "t", "a", "b", {"top": ("max", "v"), "low": ("min", "v"), "total": ("sum", "v")})
    assert got.columns == ["pid", "k", "m", "t", "_n", "top", "low", "total"] and got.schema["top"].dataType.simpleString() == "int"
    want = [(1, 7, 3, 10), (1, 7, 3, 10), (2, None, None, None), (3, None, None, None), (4, None, None, None), (None, 3, 3, 3)]
    assert sorted(((r.pid, r.top, r.low, r.total) for r in got.collect()), key=str) == sorted(want, key=str)
    assert covered(p.limit(0), s, ["k", "m"], "t", "a", "b", {"top": ("max", "v")}).count() == 0
    assert covered(p, s.limit(0), ["k", "m"], "t", "a", "b", {"top": ("max", "v")}).filter("top is null").count() == 6
    with pytest.raises(TypeError):
        covered(p, s.withColumn("v", F.lit("a")), ["k", "m"], "t", "a", "b", {"top": ("max", "v")})


def test_a_point_is_in_one_row_per_level(spark):
    """A hot key's points are dealt over cells, never copied, and no join is made."""
    at = lambda c: F.timestamp_add("HOUR", c, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    p = spark.range(4000).select("id", F.lit(1).alias("k"), at(F.col("id").cast("int")).alias("t"))
    s = spark.range(500).select(F.col("id").alias("v"), F.lit(1).alias("k"), at(F.col("id").cast("int") * 3).alias("a"),
                                at(F.col("id").cast("int") * 9).alias("b"))
    got = covered(p, s, ["k"], "t", "a", "b", {"top": ("max", "v")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 3  # of the pieces alone
    want = {t: max((v for v in range(500) if 3 * v <= t <= 9 * v), default=None) for t in range(4000)}
    assert {r.id: r.top for r in got.collect()} == want


def test_range_tables_against_loops():
    rng = random.Random(4)
    for n in (1, 2, 7, 64, 100):
        spans = [sorted((rng.randrange(n + 1), rng.randrange(n + 1))) for _ in range(60)]
        values = [rng.randrange(-50, 50) for _ in spans]
        b, e, v = (np.array(x) for x in ([s[0] for s in spans], [s[1] for s in spans], values))
        for op, pick in (("max", max), ("min", min)):
            want = [pick((x for (i, j), x in zip(spans, values) if i <= k < j), default=None) for k in range(n)]
            got = range_extremes(n, b, e, v, op).tolist()
            assert [None if abs(x) > 100 else x for x in got] == want
        assert range_sums(n, b, e, v).tolist() == [sum(x for (i, j), x in zip(spans, values) if i <= k < j) for k in range(n)]


def test_steps_that_read_each_other(spark, log):
    """Five steps on three levels: the source is scanned once, and nothing runs before the result is asked for."""
    w = Window.partitionBy("k").orderBy("id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumn("s", F.lag("v", 2).over(w)).withColumn("n", F.when(F.col("code") > 2, F.sum(
        F.when(F.col("code") > 2, 1).otherwise(0)).over(up))).withColumn(
        "f", F.last(F.when(F.col("code") > 3, F.col("n")), ignorenulls=True).over(up)).withColumn(
        "g", F.lead("f", 2).over(w)).withColumn("t", F.sum("v").over(Window.partitionBy("k")))
    chain = (seq(log).shift({"s": ("v", -2)}).number_where({"n": F.col("code") > 2})
             .fill({"f": F.when(F.col("code") > 3, F.col("n"))}).shift({"g": ("f", 2)}).total({"t": F.col("v")}))
    assert len(chain._levels) == 3
    cols = ["id", "s", "n", "f", "g", "t"]
    assert rows(chain.frame(), *cols) == rows(want, *cols)


def test_a_chain_reads_its_source_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(5000).selectExpr("id", "id % 3 as k", "id % 7 as code").write.parquet(path)
    chain = od.KeyedSequence(spark.read.parquet(path), ["k"], [F.col("id")], od.id_lane("id", 100))
    chain.shift({"a": ("code", 1)}).number("n").fill({"f": F.when(F.col("n") > 2, F.col("a"))})
    chain.shift({"g": ("f", -1)}).total({"t": F.col("g")})
    df = chain.frame()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert 1 <= final.count("FileScan") <= 3


def test_no_task_gets_a_whole_hot_key(spark):
    hot = spark.range(200_000).selectExpr("id", "1 as k")
    seen = od.KeyedSequence(hot, ["k"], [F.col("id")], od.id_lane("id", 1000)).number("n").frame()
    assert seen.agg(F.max("n")).first()[0] == 200_000
    lanes = hot.withColumn("lane", od.id_lane("id", 1000)).groupBy("lane").count()
    assert lanes.agg(F.max("count")).first()[0] == 1000


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 2), (1, 900, 3), (None, 3, 4)], "k int, t int, id int")
    got = od.KeyedSequence(df, ["k"], [F.col("t")], F.floor(F.col("t") / 10)).number("n").shift(
        {"p": ("id", -1)}).frame()
    assert rows(got, "id", "n", "p") == [(1, 2, 2), (2, 1, None), (3, 3, 1), (4, 1, None)]


def test_band_join_against_brute_force(spark):
    rng = random.Random(5)
    a = [(i, rng.choice([1, 1, 2]), rng.randrange(-40, 40)) for i in range(60)]
    b = [(i, rng.choice([1, 1, 2]), rng.randrange(-40, 40)) for i in range(60)]
    got = od.band_join(spark.createDataFrame(a, "x long, k long, u int"),
                       spark.createDataFrame(b, "y long, k long, w int"), ["k"], F.col("u"), F.col("w"), 3, 5)
    want = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and -3 <= q[2] - p[2] <= 5}
    pairs = [(r.x, r.y) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_exact_percentiles(spark, log):
    import numpy as np
    got = {r.k: r for r in od.exact_percentiles(
        log, ["k"], "v", {"p25": .25, "med": .5, "p90": .9}).collect()}
    values = {}
    for r in log.collect():
        values.setdefault(r.k, []).append(r.v)
    for k, vs in values.items():
        for name, q in (("p25", 25), ("med", 50), ("p90", 90)):
            assert got[k][name] == pytest.approx(np.percentile(vs, q))
    disc = od.exact_percentiles(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"], "v",
                                {"p": .98}, kind="disc").first()
    assert disc.p == 2
    cont = od.exact_percentiles(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"], "v",
                                {"p": .5}).first()
    assert cont.p == 1.5


@pytest.mark.parametrize("shape", ["spread", "lumps", "same"])
def test_percentiles_by_brackets(spark, shape):
    """Groups beyond the whole-group bound: only values inside the brackets are ordered, and the result is exact."""
    value = {"spread": "(id * 7919) % 100003 / 7", "lumps": "(id * 7919) % 5 * 1.5", "same": "3.0"}[shape]
    df = spark.range(60_000).selectExpr("CASE WHEN id % 10 = 0 THEN null ELSE id % 2 END AS k", f"cast({value} as double) AS v")
    probs = {"p0": 0.0, "p001": .001, "p05": .05, "med": .5, "p98": .98, "p1": 1.0}
    values = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    for whole in (100, 10**6):
        for kind in ("cont", "disc"):
            got = {r.k: r for r in od.exact_percentiles(df, ["k"], "v", probs, kind=kind, accuracy=200, whole=whole).collect()}
            for k, vs in values.items():
                vs = sorted(vs)
                for name, p in probs.items():
                    want = np.quantile(vs, p) if kind == "cont" else vs[max(0, math.ceil(len(vs) * p) - 1)]
                    assert got[k][name] == pytest.approx(want, rel=1e-12)


def test_a_hot_group_is_counted_not_ordered(spark):
    df = spark.range(200_000).selectExpr("1 AS k", "cast(hash(id) as long) AS v")
    out = od.exact_percentiles(df, ["k"], "v", {"med": .5, "p9": .9}, accuracy=1000, whole=1000)
    assert out.first().med == pytest.approx(np.median([r.v for r in df.collect()]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    sent = [int(x.replace(",", "")) for x in re.findall(r"Window.*?rowCount=([0-9,]+)", plan)]
    assert all(n < 5000 for n in sent)


def test_first_by_ties(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (2, 7, 9)], "k int, t int, id int")
    assert rows(od.first_by(df, ["k"], ["id"], ["t", "id"]), "k", "id") == [(1, 1), (2, 9)]
    assert rows(od.first_by(df, ["k"], ["id"], ["t", "id"], latest=True), "k", "id") == [(1, 2), (2, 9)]


def test_small_keys_are_looked_up_whole_beside_a_large_one(spark):
    """Keys of few rows meet in one exchange and are not cut into cells; a large key among them is."""
    base = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda c: F.timestamp_add("HOUR", F.col(c), base)
    rng = random.Random(5)
    points = [(i, rng.randrange(40), rng.randrange(40000)) for i in range(900)]
    spans = [(i, rng.randrange(40), a, a + rng.choice([0, 30, 2000, 30000])) for i, a in
             enumerate(rng.randrange(40000) for _ in range(900))]
    points += [(900 + i, None if i == 0 else 3, None) for i in range(100)]  # without a time: dealt to all groups
    spans += [(900, 3, -9_000_000, 9_000_000), (901, 5, -9_000_000, 9_000_000)]  # over 1970, for all the points of a key
    large = [(2000 + i, 100, rng.randrange(40000)) for i in range(3000)], [(2000 + i, 100, 13 * i, 13 * i + 500) for i in range(3000)]

    def looked_up(points, spans):
        p = spark.createDataFrame(points, "pid long, k long, t int").withColumn("t", at("t"))
        s = spark.createDataFrame(spans, "sid long, k long, a int, b int").withColumns({"a": at("a"), "b": at("b")})
        got = covered(p, s, ["k"], "t", "a", "b", {"top": ("max", "sid"), "low": ("min", "sid"), "total": ("sum", "sid")})
        hits = _hits(points, spans)
        assert {r.pid: (r.top, r.low, r.total) for r in got.collect()} == {p[0]: hits.get(p[0], (None,) * 3) for p in points}
        return got._jdf.queryExecution().optimizedPlan().toString()

    small = looked_up(points, spans)
    assert "Generate" not in small and small.count("FlatMapGroupsInArrow") == 1
    both = looked_up(points + large[0], spans + large[1])
    assert both.count("Generate") == 3 and "Join" not in both
