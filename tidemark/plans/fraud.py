"""Margin, abuse and fraud features per customer and per phone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.textfn import pad_code
from tidemark.operators import fraud as fr
from tidemark.plans.registry import query
from tidemark.plans.views import PHONE
from tidemark.session import checkpointed

SINCE = "1997-01-01 00:00:00"
HUBS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_HUB_LIST = "[" + ", ".join(f"'{h}'" for h in HUBS) + "]"


def _orders(t):
    return (t.ord.join(t.geo.select("customer_id", "hub"), "customer_id")
            .withColumn("phone", F.floor(F.col("customer_id") / 2)))


def _items(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"),
        F.round("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("gross"),
        F.round(F.col("l_discount") * 100).cast("long").alias("rate")).withColumn(
        "disc", F.col("gross") * F.col("rate"))
    bad = t.ret.filter("source = 4").select("order_id").distinct()
    return fr.order_item_margin(_orders(t), lines, bad, SINCE)


_MARGIN = f"""
    order_item AS (
        SELECT o.customer_id, o.customer_id // 2 AS phone, o.order_id, g.hub, i.item_id, i.gross, i.disc, i.qty
        FROM ord o JOIN item i USING (order_id) JOIN geo g ON g.customer_id = o.customer_id
        WHERE o.status IN (9, 10) AND o.placed_at >= TIMESTAMP '{SINCE}'
          AND o.order_id NOT IN (SELECT order_id FROM ret WHERE source = 4)),
    limits AS (SELECT item_id, quantile_disc(qty, 0.98) AS qty_limit FROM order_item GROUP BY 1)"""


@query("a81_order_item_margin", f"WITH {_MARGIN} SELECT * FROM order_item")
def _(t):
    return _items(t)


@query("a82_item_quantity_percentile", f"WITH {_MARGIN} SELECT * FROM limits")
def _(t):
    return fr.item_quantity_percentile(_items(t))


@query("a83_pad_code", """
    SELECT p_partkey, CASE length(c) WHEN 6 THEN c WHEN 5 THEN '0' || c WHEN 4 THEN '00' || c WHEN 3 THEN '000' || c
           WHEN 2 THEN '0000' || c WHEN 1 THEN '00000' || c WHEN 0 THEN '000000' || c END AS code
    FROM (SELECT p_partkey, (p_partkey * 997)::VARCHAR AS c FROM part)""")
def _(t):
    return t.part.select("p_partkey", pad_code((F.col("p_partkey") * 997).cast("string")).alias("code"))


def _abuse(t, items, **options):
    items = checkpointed(items)  # read for the limits and again for the flags
    code = F.col("p_partkey").cast("string").alias("code")
    hub = F.element_at(F.array(*[F.lit(h) for h in HUBS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    margins = t.part.select(code, hub.alias("hub"), (F.col("p_size") % 10 / 100).alias("margin"))
    caps = t.part.filter("p_size > 25").select(code, (40 + F.col("p_size") % 10).alias("cap"))
    listed = t.part.filter("p_type = 'ECONOMY'").select(code)
    return fr.abuse_features(items, fr.item_quantity_percentile(items), listed, margins, caps,
                             default_cap=45, **options)


def _abuse_sql(key, floor, all_flags):
    more = ""
    if all_flags:
        more = "".join(f", count(*) FILTER ({x} = items) AS orders_all_{n}" for x, n in
                       (("top", "at_cap"), ("outl", "outlier"), ("low", "low_margin"), ("pa", "abuse")))
    return f"""
    flagged AS (
        SELECT i.*, CASE WHEN i.hub = ({_HUB_LIST})[i.item_id % 5 + 1]
                          AND (p_size % 10) / 100::DOUBLE - i.disc::DOUBLE / nullif(i.gross * 100, 0)::DOUBLE < {floor} THEN 1 ELSE 0 END AS low,
               CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS pa,
               CASE WHEN i.qty >= CASE WHEN p_size > 25 THEN 40 + p_size % 10 ELSE 45 END THEN 1 ELSE 0 END AS top,
               CASE WHEN i.qty >= l.qty_limit THEN 1 ELSE 0 END AS outl
        FROM order_item i JOIN part ON p_partkey = i.item_id JOIN limits l ON l.item_id = i.item_id),
    per_order AS (
        SELECT {key}, order_id, count(*) AS items, sum(low * outl) AS low_out, sum(pa * outl) AS pa_out,
               sum(low) AS low, sum(pa) AS pa, sum(top) AS top, sum(outl) AS outl FROM flagged GROUP BY 1, 2),
    abuse AS (
        SELECT {key}, count(*) AS orders_delivered, count(*) FILTER (low_out > 0) AS orders_high_low_margin,
               count(*) FILTER (pa_out > 0) AS orders_high_abuse, count(*) FILTER (top > 0) AS orders_at_cap,
               count(*) FILTER (outl > 0) AS orders_outlier, count(*) FILTER (pa > 0) AS orders_abuse{more}
        FROM per_order GROUP BY 1)"""


@query("a84_abuse_features_customer", f"WITH {_MARGIN}, {_abuse_sql('customer_id', 0.0, False)} SELECT * FROM abuse")
def _(t):
    return _abuse(t, _items(t), key="customer_id")


@query("a85_abuse_features_phone", f"WITH {_MARGIN}, {_abuse_sql('phone', 0.05, True)} SELECT * FROM abuse")
def _(t):
    return _abuse(t, _items(t), key="phone", margin_floor=0.05, all_flags=True)


def _fraud(t, key):
    o = _orders(t)
    if key == "customer_id":
        shunned = o.filter("channel = '5-LOW'").select("customer_id").distinct()
        o = o.join(shunned, "customer_id", "left_anti")
    else:
        o = o.filter("channel <> '5-LOW'")
    day = lambda n: F.timestamp_add("DAY", F.lit(n), "placed_at")
    cancelled = F.col("status") == 8
    o = o.withColumns({
        "cancelled_at": F.when(cancelled, day(20)),
        "vertical": F.when(F.col("channel") == "2-HIGH", "hub").when(
            F.col("channel") == "3-MEDIUM", "last mile").otherwise("care"),
        "at_delivery": cancelled & (F.col("channel") == "4-NOT SPECIFIED")})
    program = t.ord.filter("channel < '3'").select(
        "order_id", F.when(F.col("value") > 20000000, 4).otherwise(3).alias("outcome"),
        (F.col("order_id") % 3 == 0).alias("chosen"))
    plus = lambda n: F.timestamp_add("DAY", F.lit(n), F.min("first_ship"))
    # one pass over the items of an order gives its times and values
    facts = t.item.groupBy("order_id").agg(
        plus(0).alias("packed_at"), plus(200).alias("billed_at"), plus(400).alias("out_at"),
        plus(500).alias("last_try_at"), F.sum(F.when(F.col("returned") == 1, F.col("gross"))).alias("returned_value"),
        F.sum(F.when(F.col("qty") > 45, F.col("disc"))).alias("issue_value"))
    profile = _orders(t).groupBy(key).agg(
        F.max(F.when(F.col("order_id") % 50 == 7, 1).otherwise(0)).alias("banned_flag"),
        F.count_distinct("channel").alias("address_count"),
        F.count_distinct(F.col("order_id") % 3).alias("patient_count"))
    return fr.fraud_features(o, program, facts, profile, key,
                             active_since="1999-01-01 00:00:00", phone=PHONE)


def _fraud_sql(key):
    keep = ("customer_id NOT IN (SELECT customer_id FROM ord WHERE channel = '5-LOW')"
            if key == "customer_id" else "channel <> '5-LOW'")
    return f"""
    keyed AS (SELECT *, customer_id // 2 AS phone FROM ord),
    facts AS (
        SELECT o.*, CASE WHEN channel < '3' THEN CASE WHEN value > 20000000 THEN 4 ELSE 3 END END AS outcome,
               i.packed_at, i.packed_at + INTERVAL 200 DAY AS billed_at, i.packed_at + INTERVAL 400 DAY AS out_at,
               i.packed_at + INTERVAL 500 DAY AS last_try_at, channel < '3' AND order_id % 3 = 0 AS chosen,
               i.returned_value, i.issue_value, placed_at + INTERVAL 20 DAY AS cancelled_at,
               status = 8 AND channel = '4-NOT SPECIFIED' AS at_delivery, status IN (9, 10) AS won, status IN (2, 8, 9, 10) AS closed,
               coalesce(i.returned_value > 0, false) AS back
        FROM keyed o LEFT JOIN (
            SELECT order_id, min(first_ship) AS packed_at, sum(gross) FILTER (returned = 1) AS returned_value,
                   sum(disc) FILTER (qty > 45) AS issue_value FROM item GROUP BY 1) i USING (order_id)
        WHERE {keep}),
    numbered AS (
        SELECT *, CASE WHEN closed THEN row_number() OVER (PARTITION BY {key}, closed ORDER BY order_id DESC) END AS end_no,
               CASE WHEN status = 8 THEN row_number() OVER (PARTITION BY {key}, status = 8 ORDER BY order_id DESC) END AS cancel_no,
               CASE WHEN won THEN row_number() OVER (PARTITION BY {key}, won ORDER BY order_id DESC) END AS done_no FROM facts),
    behaviour AS (
        SELECT {key}, count(*) FILTER (status = 8 AND channel = '2-HIGH') AS cancelled_at_hub,
               count(*) FILTER (status = 8 AND channel = '3-MEDIUM') AS cancelled_at_last_mile,
               count(*) FILTER (status = 8 AND cancelled_at > packed_at) AS cancelled_after_packed,
               count(*) FILTER (status = 8 AND cancelled_at > billed_at) AS cancelled_after_billed,
               count(*) FILTER (status = 8 AND cancelled_at > out_at) AS cancelled_after_out,
               count(*) FILTER (status = 8 AND cancelled_at > last_try_at) AS cancelled_after_last_try,
               count(*) FILTER (chosen) AS app_chosen, count(*) FILTER (chosen AND outcome = 4) AS app_chosen_done,
               count(*) FILTER (chosen AND outcome = 4 AND status = 8) AS app_chosen_done_cancelled,
               count(*) FILTER (at_delivery) AS cancelled_at_delivery, count(*) AS orders_placed,
               count(*) FILTER (NOT closed) AS orders_open, count(*) FILTER (closed) AS orders_closed,
               count(*) FILTER (won) AS orders_done, count(*) FILTER (status = 8) AS orders_cancelled,
               count(*) FILTER (status = 2) AS orders_rejected, sum(value) FILTER (won)::BIGINT AS value_done,
               sum(returned_value) FILTER (won)::BIGINT AS value_returned, sum(coalesce(issue_value, 0))::BIGINT AS issue_value,
               count(*) FILTER (won AND returned_value = value) AS complete_returns, count(*) FILTER (back) AS orders_with_return,
               count(*) FILTER (issue_value > 0) AS orders_with_issue, count(*) FILTER (channel <> '1-URGENT') AS orders_web,
               count(*) FILTER (channel = '1-URGENT') AS orders_phone, min(placed_at) AS first_placed_at, max(placed_at) AS last_placed_at,
               min(placed_at) FILTER (won) AS first_done_at, max(placed_at) FILTER (won) AS last_done_at,
               count(outcome) AS program_orders, count(*) FILTER (outcome = 4) AS program_done,
               count(*) FILTER (outcome = 4 AND status = 8) AS program_done_cancelled,
               count(*) FILTER (end_no IN (1, 2, 3) AND at_delivery) AS last3_cancelled_at_delivery,
               count(*) FILTER (end_no <= 5 AND status = 8) AS last5_cancelled,
               count(*) FILTER (cancel_no <= 5 AND outcome = 4) AS last5_program_cancelled,
               count(*) FILTER (done_no <= 5 AND back) AS last5_returned
        FROM numbered GROUP BY 1 HAVING count(*) >= 10 AND max(placed_at) >= DATE '1999-01-01'),
    fraud AS (SELECT b.*, a.banned_flag, a.address_count, a.patient_count FROM behaviour b LEFT JOIN (
                  SELECT {key}, max(CASE WHEN order_id % 50 = 7 THEN 1 ELSE 0 END) AS banned_flag,
                         count(DISTINCT channel) AS address_count, count(DISTINCT order_id % 3) AS patient_count
                  FROM keyed GROUP BY 1) a USING ({key}))"""


@query("a86_fraud_features_customer", f"WITH {_fraud_sql('customer_id')} SELECT * FROM fraud")
def _(t):
    return _fraud(t, "customer_id")


@query("a87_fraud_features_phone", f"WITH {_fraud_sql('phone')} SELECT * FROM fraud")
def _(t):
    return _fraud(t, "phone")


def _both_sql(key, floor, all_flags):
    names = ["orders_delivered", "orders_high_low_margin", "orders_high_abuse", "orders_at_cap",
             "orders_outlier", "orders_abuse"]
    if all_flags:
        names += [f"orders_all_{n}" for n in ("at_cap", "outlier", "low_margin", "abuse")]
    return f"""WITH {_MARGIN}, {_abuse_sql(key, floor, all_flags)}, {_fraud_sql(key)}
    SELECT f.*, {", ".join(f"coalesce(a.{n}, 0) AS {n}" for n in names)} FROM fraud f LEFT JOIN abuse a USING ({key})"""


@query("a88_fraud_and_abuse_customer", _both_sql("customer_id", 0.0, False))
def _(t):
    return fr.fraud_and_abuse(_fraud(t, "customer_id"), _abuse(t, _items(t), key="customer_id"),
                              "customer_id")


@query("a89_fraud_and_abuse_phone", _both_sql("phone", 0.05, True))
def _(t):
    return fr.fraud_and_abuse(
        _fraud(t, "phone"), _abuse(t, _items(t), key="phone", margin_floor=0.05, all_flags=True), "phone")
