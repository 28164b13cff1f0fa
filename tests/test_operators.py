"""Edge rules on hand-made frames."""

import glob
import os
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import calls, chains, cohorts, distinct, forecast, lifecycle, ordered, people, queues, refresh, scoring
from tidemark.operators import orders as order_ops
from tidemark.operators.ordered import id_lane
from tidemark.plans import orders as order_plans
from tidemark.plans.views import Bound
from tidemark.session import shared_dir
from tidemark.sources import chunks, sinks
from tidemark.sources.tables import fill_template


def at(text):
    return datetime.fromisoformat(f"2024-01-{text}")


LOG = "id long, entity_id long, code int, made_at timestamp_ntz, owner long"


def log(spark, *rows):
    return spark.createDataFrame([(i, e, c, at(t), 0) for i, (e, c, t) in enumerate(rows)], LOG)


def test_stage_dwell_counts_open_visit_but_not_its_time(spark):
    df = log(spark, (1, 3, "01 10:00:00"), (1, 4, "01 10:05:00"), (1, 3, "01 11:00:00"))
    row = lifecycle.stage_dwell(df, 3).first()
    assert (row.in_stage_seconds, row.visits) == (300, 2)


def test_snapshot_ends_are_included(spark):
    df = log(spark, (1, 3, "01 10:00:00"), (1, 4, "01 11:00:00"), (2, 3, "01 12:00:00"))
    at_end = lifecycle.snapshot_at(df, 3, "2024-01-01 11:00:00").collect()
    assert [r.entity_id for r in at_end] == [1]
    assert lifecycle.snapshot_at(df, 3, "2024-01-01 12:30:00").count() == 0


def test_reentry_skips_first_visit_and_first_return_from_a_status(spark):
    df = log(spark, (1, 5, "29 01:00:00"), (1, 3, "29 02:00:00"), (1, 5, "29 03:00:00"),
             (1, 3, "29 04:00:00"), (1, 5, "29 05:00:00"))
    got = lifecycle.reentry_instances(df, 5, {3: "care"}, "2024-01-30 12:00:00", [3]).collect()
    assert [(r.made_at.hour, r.instance) for r in got] == [(5, 1)]


def test_open_block_removes_session(spark):
    s = spark.createDataFrame([(1, at("02 10:00:00"), at("02 12:00:00")), (2, at("02 10:00:00"), at("02 12:00:00"))],
                              "owner long, online_start timestamp_ntz, online_end timestamp_ntz")
    b = spark.createDataFrame([(1, at("01 00:00:00")), (2, at("01 00:00:00"))], "owner long, blocked_at timestamp_ntz")
    a = spark.createDataFrame([(2, at("02 11:00:00"))], "owner long, approved_at timestamp_ntz")
    assert [r.owner for r in people.approved_sessions(s, b, a).collect()] == [2]


def test_upsert_twice_gives_the_same_table(spark):
    path = sinks.fresh_path(spark, "t")
    sinks.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    second, third = sinks.fresh_path(spark, "t"), sinks.fresh_path(spark, "t")
    once = sinks.upsert_table(spark, path, batch, "k", second)
    twice = sinks.upsert_table(spark, second, batch, "k", third)
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_template_rejects_values(spark):
    with pytest.raises(ValueError):
        fill_template("select $x", x="1; drop")


def test_retention_rows_and_monotone_size(spark):
    df = spark.createDataFrame([(1, datetime(2023, 12, 31)), (1, datetime(2024, 1, 1)), (2, datetime(2023, 12, 1))],
                               "customer_id long, placed_at timestamp_ntz")
    row = cohorts.retention_cohorts(df).first()
    assert (row.customers_acquired, row.m_1, row.m_2) == (2, 1, 0)


def test_prob_clamps_and_unseen_hour(spark):
    rows = [("a", 1, 0), ("b", 1, 1)] + [("c", 1, int(i < 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "f string, hr int, success int")
    tables = scoring.prob_tables(df, ["f"])
    assert {r.value: r.p for r in tables.collect()} == {"a": .2, "b": .5, "c": pytest.approx(.3)}
    new = spark.createDataFrame([("a", 9), ("c", 1)], "f string, hr int")
    got = {r.f: r.prob_f for r in scoring.prob_values(new, tables, ["f"]).collect()}
    assert got == {"a": .2, "c": pytest.approx(.3)}


def test_iqr_fence_drops_cohort_from_all_months(spark):
    cols = "month string, acquired string, latest string, chronic int, discounted int, hub string, courier int, source string, customers long, retention double"
    rows = [("m1", "M1", "M1", 0, 0, f"h{i}", 0, "Google", 10, 10.0 + i % 3) for i in range(12)]
    rows += [("m1", "M2", "M1", 0, 0, "odd", 0, "Google", 10, 99.0), ("m2", "M2", "M1", 0, 0, "odd", 0, "Google", 10, 11.0)]
    df = spark.createDataFrame(rows, cols)
    kept = forecast.drop_outliers(df, "retention")
    assert "odd" not in {r.hub for r in kept.collect()} and kept.count() == 12
    assert forecast.drop_outliers(df, "retention", per_month=True).filter("hub = 'odd'").count() == 1


def test_unhot_inverts_one_hot(spark):
    cols = "acquired string, latest string, hub string, source string"
    df = spark.createDataFrame([("M1", "M6+", "ASIA", "Google")], cols)
    row = forecast.unhot(forecast.one_hot(df, ["ASIA", "EUROPE"]), ["ASIA", "EUROPE"]).first()
    assert (row.acquired_label, row.latest_label, row.hub_label, row.source_label) == ("M1", "M6+", "ASIA", "Google")
    assert row.am_m1 == 1 and row.sc_europe == 0


def test_loyalty_ratio_takes_the_larger_side_and_skips_short_codes(spark):
    day = datetime(2024, 1, 10).date()
    refills = spark.createDataFrame([(1, 7, day, False)], "refill_id long, customer_id long, due_on date, fulfilled boolean")
    orders = spark.createDataFrame([(5, 7, datetime(2024, 1, 20).date()), (6, 7, datetime(2024, 1, 21).date())],
                                   "order_id long, customer_id long, placed_on date")
    a = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "x")], "refill_id long, code string")
    b = spark.createDataFrame([(5, "aa"), (6, "aa")], "order_id long, code string")
    pairs = queues.loyalty_pairs(refills, a, orders, b)
    assert [(r.order_id, r.match) for r in pairs.collect()] == [(5, 1.0)]
    assert queues.loyalty_match(pairs).first().match_exact == 1


def test_hold_span_starts_after_the_hold_and_stays_open(spark):
    h = spark.createDataFrame([(1, 1, at("01 10:00:00"), 5), (1, 2, at("01 11:00:00"), 2), (2, 3, at("01 10:00:00"), 5)],
                              "order_id long, id long, made_at timestamp_ntz, action int")
    got = {r.order_id: (r.hold_from, r.hold_to) for r in calls.hold_intervals(h, 5).collect()}
    assert got[1] == (at("01 10:00:00").replace(microsecond=1), at("01 11:00:00"))
    assert got[2][1] == datetime(2100, 1, 1)


def test_hold_spans_of_short_histories_need_no_lanes(spark, monkeypatch):
    rows = [(o, i, at(f"{d:02d} 10:00:00") if d else None, a) for i, (o, d, a) in enumerate(
        [(o, 1 + (7 * i + o) % 28, (i + o) % 3) for o in (1, 2, 3) for i in range(4)]
        + [(9, 1 + (5 * i) % 28, i % 3) for i in range(60)] + [(3, 0, 1), (None, 4, 1)])]
    h = spark.createDataFrame(rows, "order_id long, id long, made_at timestamp_ntz, action int")
    want = set()
    for o, i, t, a in rows:
        after = [x[2] for x in rows if x[0] == o and x[2] is not None and (t is None or (x[2], x[1]) > (t, i))]
        if a == 1:
            want.add((o, t and t.replace(microsecond=1), min(after, default=datetime(2100, 1, 1))))
    got = calls.hold_intervals(h, 1)
    assert set(map(tuple, got.collect())) == want and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr("tidemark.operators.ordered.FEW", 20)  # order 9 is spread over lanes
    got = calls.hold_intervals(h, 1)
    assert set(map(tuple, got.collect())) == want and "Join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_actions_on_program_orders_are_put_in_order(spark, monkeypatch):
    seen = []
    real = calls.hold_intervals
    monkeypatch.setattr(calls, "hold_intervals", lambda history, held: seen.append(history) or real(history, held))
    path = spark.createDataFrame(
        [(7, 1, at("01 10:00:00"), True), (7, 2, at("01 10:00:00"), False), (None, 3, at("01 10:00:00"), True)],
        "phone long, order_id long, placed_at timestamp_ntz, in_program boolean").selectExpr(
        "*", "placed_at + interval 9 day as closed_at", "placed_at as in_at", "placed_at as out_at")
    history = spark.createDataFrame([(o, 10 * o, at("02 10:00:00"), 5) for o in (1, 2, 3)],
                                    "order_id long, id long, made_at timestamp_ntz, action int")
    pts = spark.createDataFrame([(1, 7, at("02 10:00:00")), (2, 7, at("03 10:00:00"))], "call_id long, caller long, made_at timestamp_ntz")
    got = calls.call_context(pts, [path, path], history=history, held=5).orderBy("call_id").collect()
    assert [(r.acted_flag, r.on_hold_flag, r.program_order_id) for r in got] == [(0, 0, 1), (1, 1, 1)]
    assert [r.order_id for r in seen[0].collect()] == [1]


def test_repeat_new_items_counts_union_of_buyers_once(spark):
    detail = spark.createDataFrame([(1, 10, False, "aNewly Mapped"), (1, 11, False, "aNewly Mapped")],
                                   "entity_id long, item_code int, deleted boolean, mapping string")
    lines = spark.createDataFrame([(1, 10, False), (1, 11, False), (2, 10, True), (2, 11, False), (3, 11, True)],
                                  "entity_id long, item_code int, deleted boolean")
    dwell = spark.createDataFrame([(1, 5, 1)], "entity_id long, in_stage_seconds long, visits long")
    ends = spark.createDataFrame([(1, at("01 10:00:00"), "won"), (2, at("01 10:00:00"), "won"), (3, at("01 10:00:00"), "open")],
                                 "entity_id long, placed_at timestamp_ntz, outcome string")
    row = lifecycle.repeat_new_items(detail, lines, ends, dwell).first()
    assert (row.new_items, row.times_ordered, row.times_ordered_and_retained) == (2, 2, 1)
    assert (row.won_lines, row.closed_lines, row.open_lines) == (2, 0, 1)


def test_repeat_new_items_forms_no_pairs_of_entities_and_buyers(spark):
    known = {1: [10, 11], 2: [10, 11], 3: [11, 12, 13], 4: [13], 5: [11, 10]}
    bought = {**{e: {c: e % 2 == 0 for c in cs} for e, cs in known.items()}, 6: {13: True}, 7: {10: False, 12: True}, 8: {14: False}}
    detail = spark.createDataFrame([(e, c, False, "aNewly Mapped") for e, cs in known.items() for c in cs],
                                   "entity_id long, item_code int, deleted boolean, mapping string")
    lines = spark.createDataFrame([(e, c, d) for e, cs in bought.items() for c, d in cs.items()] * 2,
                                  "entity_id long, item_code int, deleted boolean")
    ends = spark.createDataFrame([(e, at("01 10:00:00"), "won") for e in bought], "entity_id long, placed_at timestamp_ntz, outcome string")
    dwell = spark.createDataFrame([(1, 5, 1)], "entity_id long, in_stage_seconds long, visits long")
    found = lifecycle.repeat_new_items(detail, lines, ends, dwell)
    want = set()
    for e, cs in known.items():
        buyers = {b for b, held in bought.items() if b != e and set(cs) & {*held}}
        want.add((e, len(cs), len(buyers), sum(any(not bought[b].get(c, True) for c in cs) for b in buyers)))
    assert {(r.entity_id, r.new_items, r.times_ordered, r.times_ordered_and_retained) for r in found.collect()} == want
    # buyers of sets of items come from blocks of both, not from a join on the item
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(*item_code", plan) and "CoGroup" in plan


@pytest.mark.parametrize("bits", [1 << 27, 64, 1 << 10])
def test_distinct_in_unions_against_sets(spark, monkeypatch, bits):
    monkeypatch.setattr(distinct, "BLOCK_ROWS", 300)
    monkeypatch.setattr(distinct, "BLOCK_SETS", 4)
    rows = [(f"i{k * 31 % 17}" if k % 23 else None, k * 7 % 211 if k % 29 else None, k % 3 == 0) for k in range(1500)]
    asked = [["i1"], ["i1", "i2"], ["i1", "i2"], ["i3", "i4", "none"], ["none"], [f"i{k}" for k in range(17)], ["i16", "i5", "i9"], ["i0", "i8"]]
    held = spark.createDataFrame(rows + rows[:100], "item string, who long, ok boolean")
    sets = spark.createDataFrame([(s,) for s in asked], "items array<string>")
    got = distinct.distinct_in_unions(sets, held, "items", "item", "who", "ok", ("n", "good")).collect()
    want = {(tuple(s), len({w for i, w, _ in rows if i in s and w is not None}),
             len({w for i, w, ok in rows if i in s and w is not None and ok})) for s in asked if s != ["none"]}
    assert len(got) == len(want) and {(tuple(r["items"]), r.n, r.good) for r in got} == want
    assert distinct.distinct_in_unions(sets.limit(0), held, "items", "item", "who", "ok", ("n", "good")).count() == 0
    assert distinct.distinct_in_unions(sets, held.limit(0), "items", "item", "who", "ok", ("n", "good")).count() == 0
    # matrices of few bits are worked in slices of members and of sets
    item, who = np.arange(5000) * 13 % 97, np.arange(5000) * 7 % 1009
    many = [[int(x) for x in sorted({k, (k * 5 + 3) % 97, (k * k) % 97})] for k in range(97)]
    monkeypatch.setattr(distinct, "MATRIX_BITS", bits)
    counts = distinct._union_bits(item, who, 97, 1009, np.concatenate(many), np.cumsum([0, *map(len, many)])[:-1])
    assert counts.tolist() == [len({*who[np.isin(item, s)]}) for s in many]


FUNNEL_LOG = "order_id long, original long, substitute long, agent long, created_at timestamp_ntz, log_type int"
FUNNEL_ITEMS = "order_id long, item_id long, deleted boolean, invoiced boolean, returned int, return_reason int"
FUNNEL_ORDERS = "order_id long, customer_id long, status int, placed_at timestamp_ntz"


def funnel_by_hand(log, items, orders, reasons, start, end):
    """The funnel by nested loops; equal but null keys are no match."""
    same = lambda *pairs: all(a is not None and a == b for a, b in pairs)
    least = lambda v: (v is not None, v)
    keys = {r[0:2] + (r[3],): [] for r in log if r[4] and start <= r[4].date().isoformat() <= end}
    for r in log:
        if r[4] and start <= r[4].date().isoformat() <= end:
            keys[r[0:2] + (r[3],)].append(r)
    out = []
    for (order, original, agent), rows in keys.items():
        picked = [r for r in log if r[5] == 3 and same((r[0], order))]
        top = max(picked, key=lambda r: (least(r[4]), least(r[1]))) if picked else None
        sub = top[2] if top and same((top[1], original), (top[3], agent)) else None
        offered = max((r[2] for r in rows if r[2] is not None), default=None)
        carts = [i for i in items if same((i[0], order), (i[1], offered))] or [None]
        bills = [i for i in items if i[3] and same((i[0], order), (i[1], sub))] or [None]
        for cart in carts:
            for bill in bills:
                for o in [o for o in orders if same((o[0], order))] or [(None,) * 4]:
                    at_last = lambda item: max((p[3] for i in items if i[3] and same((i[1], item)) for p in orders
                                                if same((p[0], i[0]), (p[1], o[1])) and p[3]), default=None)
                    last = max((p[3] for p in orders if same((p[1], o[1])) and p[3]), default=None)
                    later = lambda v: v is not None and o[3] is not None and v > o[3]
                    back = bool(bill and bill[4] == 1)
                    out.append((order, original, agent, sub,
                                {9: "fulfilled", 10: "fulfilled", 2: "rejected", 8: "cancelled"}.get(o[2], "under process"),
                                min(r[4] for r in rows), *[int(any(r[5] == k for r in rows)) for k in (1, 2, 3)],
                                int(cart is not None), int(bool(cart and cart[2] is False)), int(back), reasons.get(bill[5]) if back else None,
                                "dSubstituteOrderedAgain" if later(at_last(sub)) else "cOriginalOrderedAgain" if later(at_last(original))
                                else "bNoneOrderedAgain" if later(last) else "aNeverOrderedAgain"))
    return out


def funnel_rows():
    day = lambda k: at(f"{1 + k % 28:02d} 10:00:00")
    maybe = lambda v, k, n=13: None if k % n == 5 else v
    log = [(maybe(k % 23, k), maybe(k * 7 % 6, k, 17), maybe((k * 7 + 1) % 6, k, 19), maybe(k % 2, k, 29),
            maybe(day(k * 5), k, 11), k * 3 % 4 or None) for k in range(150)]
    # one latest choice an order and day, item and agent
    log = [r for i, r in enumerate(log) if r[5] != 3 or not any(q[5] == 3 and (q[0], q[1], q[4]) == (r[0], r[1], r[4]) for q in log[:i])]
    items = [(maybe(k % 23, k), maybe(k * 5 % 6, k, 17), maybe(k % 3 == 0, k, 7), maybe(k % 4 > 0, k, 9), int(k % 5 < 3), k % 4) for k in range(200)]
    orders = [(maybe(k % 21, k, 20), maybe(k % 5, k, 6), (9, 10, 2, 8, 1, None)[k % 6], maybe(day(k * 11), k, 15)) for k in range(28)]
    return log, items, orders


@pytest.mark.parametrize("small", [True, False])
def test_substitution_funnel_against_nested_loops(spark, monkeypatch, small):
    log, items, orders = funnel_rows()
    reasons = {1: "one", 2: "two"}
    monkeypatch.setattr(order_ops, "_all_small", lambda df, key: small)
    got = order_ops.substitution_funnel(spark.createDataFrame(log, FUNNEL_LOG), spark.createDataFrame(items, FUNNEL_ITEMS),
                                        spark.createDataFrame(orders, FUNNEL_ORDERS), reasons, "2024-01-03", "2024-01-25").collect()
    want = funnel_by_hand(log, items, orders, reasons, "2024-01-03", "2024-01-25")
    assert Counter(map(tuple, got)) == Counter(want)
    assert len({r.reordered for r in got}) == 4 and {r.in_cart for r in got} == {r.returned for r in got} == {0, 1}


def funnel_tables(spark, tmp_path):
    lines = [(None if k % 50 == 7 else 1000 if k % 3 else k % 40, None if k % 31 == 3 else k * 17 % 101, float(1 + k % 50), 30000.0 * (k % 7), 0.05,
              "R" if k % 4 == 0 else "N", None if k % 37 == 1 else at(f"{1 + k % 28:02d} 00:00:00").replace(year=1997)) for k in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_returnflag string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(k if k < 40 else 1000, k % 9, "FPO"[k % 3], 10.0, at(f"{1 + k % 28:02d} 00:00:00").replace(year=1997), "5-LOW") for k in range(41)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("few", [ordered.FEW, 50])
def test_orders_of_many_lines_give_the_same_log_and_cart(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    t = Bound(spark, funnel_tables(spark, tmp_path))
    small, large = t._item_by_order
    assert (large.count() > 0) == (few == 50) and small.count() > 0
    for one, other in ((t.sub_log, t.sub_log_by_order), (t.cart_item, t.cart_item_by_order)):
        assert Counter(map(tuple, other.select(*one.columns).collect())) == Counter(map(tuple, one.collect()))
    got = entry.queries()["a02_substitution_funnel"](spark, t.folder).collect()
    log = t.sub_log.select("order_id", "original", "substitute", "agent", "created_at", "log_type").collect()
    items = t.cart_item.select("order_id", "item_id", "deleted", "invoiced", "returned", "return_reason").collect()
    orders = t.ord.select("order_id", "customer_id", "status", "placed_at").collect()
    want = funnel_by_hand([tuple(r) for r in log], [tuple(r) for r in items], [tuple(r) for r in orders],
                          order_plans.REASONS, order_plans.START, order_plans.END)
    assert Counter(map(tuple, got)) == Counter(want)


def test_substitution_funnel_sends_lines_twice_and_rows_once(spark, tmp_path):
    found = entry.queries()["a02_substitution_funnel"](spark, funnel_tables(spark, tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # lines for the log and for the cart, orders by order, rows by customer, customers' last orders
    assert plan.count("Exchange hashpartitioning") <= 5 and "Exchange SinglePartition" not in plan


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_by_ranges_leaves_other_files_alone(spark, tmp_path):
    path, by = str(tmp_path / "t"), id_lane("k", 10)
    rows = [(k, f"v{k}") for k in range(95)] + [(None, "none")]
    sinks.create_partitioned(spark.createDataFrame(rows, "k long, v string"), path, by)
    before = _files(path)
    batch = spark.createDataFrame([(3, "new"), (41, "new"), (200, "added"), (200, "twice")], "k long, v string")
    assert sorted(sinks.upsert_partitions(spark, path, batch, "k", by)) == [0, 4, 20]
    after = _files(path)
    kept = {f for f in before if "key_range=0/" not in f and "key_range=4/" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(f in after for f in before if f not in kept)
    want = {(k, "new" if k in (3, 41) else v) for k, v in rows} | {(200, "added"), (200, "twice")}
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()} == want
    # the same batch again, keys without rows, null keys, and nothing
    sinks.upsert_partitions(spark, path, batch, "k", by)
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()} == want
    gone = spark.createDataFrame([(5,), (94,), (7000,)], "k long")
    sinks.upsert_partitions(spark, path, batch.filter("k = 0"), "k", by, replaced=gone)
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(None, "more")], "k long, v string"), "k", by)
    assert sinks.upsert_partitions(spark, path, batch.limit(0), "k", by) == []
    want = {r for r in want if r[0] not in (5, 94)} | {(None, "more")}
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()} == want


def test_refresh_reads_and_writes_what_changed(spark, tmp_path):
    log_path, fact_path, by = str(tmp_path / "log"), str(tmp_path / "fact"), id_lane("k", 10)
    log = spark.range(3000).selectExpr("id % 300 as k", "id as n")
    build = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("total")).filter("total > 0")
    sinks.create_partitioned(log, log_path, by)
    sinks.create_partitioned(build(log), fact_path, by)
    before = _files(fact_path)
    new = spark.createDataFrame([(17, 1000), (18, 5), (299, -10**7)], "k long, n long")
    refresh.append_log(new, log_path, by)
    changed = new.select("k")
    part = refresh.rows_of(spark, log_path, changed, "k", by)
    others = {f: open(f, "rb").read() for f in _files(log_path) if re.search("key_range=([0-9]+)", f)[1] not in ("1", "29")}
    for f in others:
        open(f, "wb").close()
    assert len(others) == 28 and part.count() == 33  # no other file is opened
    for f, content in others.items():
        with open(f, "wb") as back:
            back.write(content)
    assert sorted(refresh.refresh(spark, log_path, fact_path, changed, "k", by, build)) == [1, 29]
    after = _files(fact_path)
    assert sum(after.get(f) == m for f, m in before.items()) == 28
    whole = build(spark.read.parquet(log_path))
    assert ({tuple(r) for r in spark.read.parquet(fact_path).select("k", "total").collect()}
            == {tuple(r) for r in whole.collect()} and whole.filter("k = 299").count() == 0)
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k long, g string")
    some = refresh.touched_groups(spark.createDataFrame([(1,), (4,), (9,)], "k long"), groups, "k", "g")
    assert sorted(r.k for r in some.collect()) == [1, 2]


def test_forecast_figures(spark):
    """The figures that the flag queries judge are given, one row for each target and cohort."""
    got = {q: entry.queries()[q](spark, "/root/testdata/sf0.001") for q in ("m09_gates", "m12_forecast_table")}
    gates = got["m09_gates"].collect()
    assert [g.target for g in gates] == list(forecast.TARGETS)
    assert all(g.accepted == (g.adjusted_r2 >= 0.85) for g in gates)
    table = got["m12_forecast_table"]
    assert {f"{x}_predicted" for x in forecast.TARGETS} <= set(table.columns)
    assert all(0 <= r[f"{x}_predicted"] <= 100 for r in table.collect() for x in forecast.TARGETS)


def test_chains_of_any_length_and_cycles(spark):
    n = 3000
    links = [(k, k - 1 if k else None) for k in range(n)]  # one chain of 2,999 steps
    links += [(5000 + k, 0) for k in range(500)]  # a hub
    links += [(6000, 6001), (6001, 6002), (6002, 6000), (6003, 6000), (6004, 6003), (7000, 7000)]  # cycles, and below one
    links += [(8000, 8888), (8001, 8000), (8002, None), (9000, 9002), (9000, 9001), (None, 1)]
    parents = {}
    for node, up in links:
        if node is not None:
            parents[node] = min([x for x in (parents.get(node), up) if x is not None], default=None)

    def walk(node):
        at, steps, seen = node, 0, set()
        while parents.get(at) is not None:
            if at in seen:
                return node, None, None, True
            seen.add(at)
            at, steps = parents[at], steps + 1
        return node, at, steps, False

    df = spark.createDataFrame(links, "a long, b long").withColumns({"node": F.lit("x"), "up": F.lit(1), "steps": F.lit(2)})
    got = {r.node: (r.node, r.root, r.steps, r.cyclic) for r in chains.resolve(df, "a", "b").collect()}
    assert got == {k: walk(k) for k in parents}
    assert chains.resolve(df.limit(0), "a", "b").count() == 0


def test_distinct_rollup_against_plain_counts(spark):
    rows = [(k % 3, ["a", "b", None][k % 7 % 3], k * 37 % 1000 - 400 if k % 11 else None, k % 5 * 40000) for k in range(2000)]
    df = spark.createDataFrame(rows, "x int, y string, u long, v int")
    sets = [["x", "y"], ["y"], []]
    got = distinct.distinct_rollup(df, ["x", "y"], {"us": "u", "vs": "v"}, sets).collect()
    want = set()
    for s in sets:
        level = 2 * ("x" not in s) + ("y" not in s)
        groups = {}
        for x, y, u, v in rows:
            groups.setdefault((x if "x" in s else None, y if "y" in s else None), []).append((u, v))
        want |= {(*k, level, len({u for u, _ in g if u is not None}), len({v for _, v in g})) for k, g in groups.items()}
    assert len(got) == len(want) and {(r.x, r.y, r.level, r.us, r.vs) for r in got} == want
    assert distinct.distinct_rollup(df.limit(0), ["x"], {"us": "u"}, [["x"]]).count() == 0


def test_chunks_show_a_batch_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "sink")
    os.makedirs(path)
    df = spark.range(0, 2500, 1, 3).withColumn("v", F.col("id") * 2)
    name = chunks.append_chunks(df, path, rows=400)
    files = glob.glob(f"{path}/batch={name}/*.parquet")
    sizes = [spark.read.parquet(f).count() for f in files]
    assert sum(sizes) == 2500 and max(sizes) == 400 and len(files) == 9
    broken = df.withColumn("v", F.when(F.col("id") == 2400, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception):
        chunks.append_chunks(broken, path, rows=100)
    chunks.append_chunks(df.limit(0), path)
    assert [f for f in os.listdir(path)] == [f"batch={name}"]  # nothing shown, nothing left
    chunks.append_chunks(df.limit(5), path, batch="second")
    got = chunks.read_chunks(spark, path, df.schema)
    assert got.count() == 2505 and got.agg(F.sum("v")).first()[0] == sum(2 * k for k in range(2500)) + 20
    with pytest.raises(Exception):
        df.write.format("tidemark_chunks").mode("overwrite").option("path", path).save()


def test_retention_masks_against_sets(spark):
    import random
    rng = random.Random(3)
    rows = [(rng.randrange(40), datetime(1995 + rng.randrange(9), rng.randrange(12) + 1, 3)) for _ in range(600)]
    got = cohorts.retention_cohorts(spark.createDataFrame(rows, "customer_id long, placed_at timestamp_ntz"), horizon=7).collect()
    months = {}
    for c, t in rows:
        months.setdefault(c, set()).add(t.year * 12 + t.month)
    for r in got:
        born = [s for s in months.values() if min(s) == r.acquisition_month]
        assert r.customers_acquired == len(born)
        assert all(r[f"m_{k}"] == sum(min(s) + k in s for s in born) for k in range(1, 8))
    assert len(got) == len({min(s) for s in months.values()})


def test_a_busy_customer_forms_no_pairs_that_share_nothing(spark):
    import random
    rng = random.Random(6)
    day = lambda k: datetime.fromordinal(datetime(2024, 1, 1).toordinal() + k).date()
    refills = [(k, 7 if k < 250 else k % 5, day(rng.randrange(40)), k % 9 == 0) for k in range(300)] + [(900, 8, day(3), False)]
    orders = [(1000 + k, 7 if k < 250 else k % 5, day(rng.randrange(60))) for k in range(300)]
    a = [(r[0], f"r{rng.randrange(400)}") for r in refills for _ in range(3)] + [(r[0], "x") for r in refills[:4]]
    b = [(o[0], f"o{rng.randrange(400)}") for o in orders for _ in range(3)] + [(o[0], "x") for o in orders[:4]]
    b += [(1000 + k, code) for k, code in [(rng.randrange(300), a[rng.randrange(900)][1]) for _ in range(120)]]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (refills, "refill_id long, customer_id long, due_on date, fulfilled boolean"), (a, "refill_id long, code string"),
        (orders, "order_id long, customer_id long, placed_on date"), (b, "order_id long, code string"))]
    items = lambda rows, key: {c for k, c in rows if k == key}
    met = [(r, o) for r in refills for o in orders if r[1] == o[1] and abs((r[2] - o[2]).days) <= 10]
    want = {}
    for r, o in met:
        x, y = items(a, r[0]), items(b, o[0])
        sizes = [len([c for c in z if len(c) > 1]) for z in (x, y)]
        ratio = max([len(x & y) / n for n in sizes if n], default=0)
        old = want.get(r[0], (0, 0))
        want[r[0]] = (max(old[0], o[0]), max(old[1], ratio))
    got = {r.refill_id: (r.order_id, r.match) for r in queues.loyalty_refills(*frames).collect()}
    assert got == {r[0]: want.get(r[0], (None, None)) for r in refills}
    pairs = queues.shared_items(*frames)
    assert pairs.count() == sum(bool(items(a, r[0]) & items(b, o[0])) for r, o in met) < 0.02 * len(met)
    plain = queues.loyalty_match(queues.loyalty_pairs(*frames)).first()
    assert queues.loyalty_match(queues.loyalty_refills(*frames)).first() == plain


def test_left_rows_without_a_key_are_spread(spark, monkeypatch):
    """Calls without an order meet no order; they don't meet in one task either."""
    from tidemark.operators import ordered

    left = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 1000, 10)] + [(10, -1), (None, 7)], "k long, w long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordered.spread_left(left, right, "k")
        rows = got.withColumn("p", F.spark_partition_id()).collect()
        want = left.join(right, "k", "left").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got.columns == ["k", "v", "w"]
    order = lambda rs: sorted((r.v, r.w is None, r.w or 0, r.k or -1) for r in rs)
    assert order(rows) == order(want)
    held = [r.p for r in rows if r.k is None]
    assert len(set(held)) == 4 and max(map(held.count, set(held))) < 0.4 * len(held)


def test_groups_of_the_interval_lookup_do_not_grow(spark, monkeypatch):
    from tidemark.operators import intervals

    real = intervals._stab

    def watched(*args):
        run = real(*args)

        def check(table):
            if table.num_rows > 60:
                raise ValueError(f"{table.num_rows} rows in one group")
            return run(table)
        return check

    monkeypatch.setattr(intervals, "_stab", watched)
    monkeypatch.setattr(intervals, "GROUP_ROWS", 20)
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    points = spark.range(800).select((F.col("id") % 400).alias("k"), at.alias("at"), "id")
    spans = spark.range(400).select(F.col("id").alias("k"), at.alias("a"), F.timestamp_add("HOUR", F.lit(1), at).alias("b"),
                                    F.col("id").alias("v"))
    got = intervals.covered(points, spans, ["k"], "at", "a", "b", {"x": ("max", "v")}).collect()
    assert len(got) == 800 and all(r.x == (r.id if r.id < 400 else None) for r in got)


def test_task_fact_counts_times_once_without_copies_of_the_log(spark):
    from tidemark.operators import facts

    at = lambda s: f"2024-01-0{s} 10:00:00"
    log = spark.createDataFrame(
        [("t1", 1, 7, "New", 2, at(2), 3, None), ("t1", 1, 7, "New", 2, at(2), 5, None), ("t1", 1, 7, "New", 2, at(3), 3, None),
         ("t1", 1, 7, "New", 4, at(4), 3, "b"), ("t1", 1, 7, "New", 4, at(4), 3, "a"), ("t1", 1, 7, "New", 5, None, 3, None),
         ("t2", 1, 7, "New", 2, at(3), 3, None), ("t3", None, None, None, 1, at(5), None, None), (None, None, None, None, 2, at(5), 1, "z")],
        "task_id string, order_id long, case_id long, task_type string, code int, made_at string, owner long, reason string",
    ).withColumn("made_at", F.col("made_at").cast("timestamp_ntz"))
    people = spark.createDataFrame([(3, 900)], "owner long, profile_id long")
    fact = facts.task_fact(log, people, {4: "Done", 1: "Again"}, call=2, answered=4, hangup=5, inactive=1, done=4,
                           start="2024-01-01", as_of="2024-02-01")
    rows = {r.task_id: r for r in fact.collect()}
    assert set(rows) == {"t1", "t2", "t3", None}
    a = rows["t1"]
    assert (a.owner, a.attempts, a.connected, a.hangups, a.notified, a.reject_reason, a.action) == (5, 2, 1, 0, 0, "b", "Done")
    assert (a.issue_flag, rows["t2"].issue_flag, rows["t3"].issue_flag, rows["t3"].notified) == (1, 0, 0, 1)
    assert a.next_task_id == "t2" and rows["t2"].previous_task_id == "t1" and rows[None].reject_reason == "z"
    assert "Expand" not in fact._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_a_table_are_bounded(spark):
    from tidemark.operators import refresh

    count = lambda df: df.select(refresh.key_ranges(df, "id", 16).alias("r")).distinct().count()
    assert count(spark.range(160)) == 10
    assert 256 < count(spark.range(5, 200_000)) <= refresh.RANGES + 1
    assert count(spark.range(3).select(F.lit(None).cast("long").alias("id"))) == 1


def test_state_before_call_puts_only_called_orders_in_sequence(spark):
    context = spark.createDataFrame(
        [(1, 10, at("05 10:00:00")), (2, None, at("05 10:00:00")), (2, None, at("05 10:00:00")), (3, 11, at("01 10:00:00")),
         (4, 12, at("05 10:00:00")), (5, 10, None)], "call_id long, live_program_order_id long, made_at timestamp_ntz")
    history = spark.createDataFrame(
        [(10, 1, at("02 10:00:00"), 3), (10, 2, at("04 10:00:00"), 4), (10, 3, at("05 10:00:00"), 5), (11, 4, at("02 10:00:00"), 6),
         (None, 5, at("02 10:00:00"), 7), *[(k, k, at("02 10:00:00"), 8) for k in range(100, 400)]],
        "order_id long, id long, made_at timestamp_ntz, action int")
    out = calls.state_before_call(context, history)
    assert out.columns == ["call_id", "live_program_order_id", "made_at", "acted_at", "state_before"]
    got = sorted((r.call_id, r.acted_at, r.state_before) for r in out.collect() if r.acted_at) + [
        r.call_id for r in out.orderBy("call_id").collect() if not r.acted_at]
    assert got == [(1, at("04 10:00:00"), 4), 2, 2, 3, 4, 5]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_many_small_ranges_are_written_by_several_tasks(spark, tmp_path):
    from tidemark.operators import refresh
    from tidemark.sources import sinks

    path, part = str(tmp_path / "ranges"), F.floor(F.col("k") / 4)
    writers = lambda: {f.name.split("-")[1] for f in (tmp_path / "ranges").glob("*/*.parquet")}
    sinks.create_partitioned(spark.range(256).select(F.col("id").alias("k"), F.lit(0).alias("v")), path, part)
    assert len(writers()) > 1 and len(list((tmp_path / "ranges").glob("key_range=*"))) == 64
    refresh.append_log(spark.range(256, 512).select(F.col("id").alias("k"), F.lit(0).alias("v")), path, part)
    sinks.upsert_partitions(spark, path, spark.range(0, 512, 2).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k", part)
    got = spark.read.parquet(path)
    assert len(writers()) > 1 and got.count() == 512 and got.filter("v = 1 and k % 2 = 0").count() == 256
