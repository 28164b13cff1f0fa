"""Inbound calls against orders, prefetchable items and return attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calls as cl
from tidemark.operators.facts import staff_category
from tidemark.operators.queries import (filtered, probe_count_distinct, probe_distinct, probe_sample)
from tidemark.plans.registry import query
from tidemark.sources import sinks


@query("a23_probe_distinct", "SELECT DISTINCT form FROM line")
def _(t):
    return probe_distinct(t.line, "form")


@query("a29_probe_count_distinct", "SELECT count(DISTINCT call_id) AS n FROM inbound")
def _(t):
    return probe_count_distinct(t.inbound, "call_id")


def _paths(t, split=False):
    """Orders by contact phone and by registered phone; the contact is at times someone else's."""
    o = t.ord
    base = o.select(
        "order_id", "customer_id", "placed_at", "status",
        F.timestamp_add("DAY", F.lit(5), "placed_at").alias("in_at"),
        F.timestamp_add("DAY", F.lit(30), "placed_at").alias("out_at"),
        (F.col("channel") < "3").alias("in_program"))
    days = F.when(F.col("status") == 9, 60).when(F.col("status") == 8, 20) if split else F.lit(60)
    base = base.withColumn("closed_at", F.timestamp_add("DAY", days, "placed_at"))
    contact = base.withColumn("phone", F.when(F.col("status") == 9, F.col("customer_id"))
                              .otherwise(F.col("customer_id") + 1))
    return [contact, base.withColumn("phone", F.col("customer_id"))]


def _context_sql(split, ids=True):
    closed = ("CASE status WHEN 9 THEN placed_at + INTERVAL 60 DAY WHEN 8 THEN placed_at + INTERVAL 20 DAY END"
              if split else "placed_at + INTERVAL 60 DAY")
    return f"""
    base AS (
        SELECT *, placed_at + INTERVAL 5 DAY AS in_at, placed_at + INTERVAL 30 DAY AS out_at,
               channel < '3' AS in_program, {closed} AS closed_at FROM ord),
    span AS (
        SELECT *, CASE WHEN status = 9 THEN customer_id ELSE customer_id + 1 END AS phone FROM base
        UNION ALL SELECT *, customer_id AS phone FROM base),
    met AS (
        SELECT c.call_id, c.caller, c.made_at, s.order_id, s.in_program,
               c.made_at BETWEEN s.placed_at AND s.closed_at AS live,
               s.in_program AND c.made_at BETWEEN s.in_at AND s.out_at AS staged
        FROM inbound c LEFT JOIN span s ON s.phone = c.caller),
    context AS (
        SELECT call_id, caller, made_at, max(CASE WHEN order_id IS NOT NULL THEN 1 ELSE 0 END) AS ordered_flag,
               max(CASE WHEN live THEN 1 ELSE 0 END) AS live_order_flag,
               max(CASE WHEN in_program {"AND live" if ids else ""} THEN 1 ELSE 0 END) AS program_flag,
               max(CASE WHEN staged THEN 1 ELSE 0 END) AS live_program_flag
               {", max(CASE WHEN live THEN order_id END) AS live_order_id, max(CASE WHEN in_program AND live THEN order_id END) AS program_order_id, max(CASE WHEN staged THEN order_id END) AS live_program_order_id" if ids else ""}
        FROM met GROUP BY 1, 2, 3)"""


@query("a30_call_context_flags", f"WITH {_context_sql(False, False)} SELECT * FROM context")
def _(t):
    return cl.call_context(t.inbound, _paths(t), with_ids=False)


@query("a31_call_context_ids", f"WITH {_context_sql(False)} SELECT * FROM context")
def _(t):
    return cl.call_context(t.inbound, _paths(t), with_ids=True)


@query("a32_call_context_union", f"WITH {_context_sql(False)} SELECT * FROM context")
def _(t):
    return cl.call_context(t.inbound, _paths(t), combine="union")


@query("a33_call_context_union_all", f"WITH {_context_sql(True)} SELECT * FROM context")
def _(t):
    return cl.call_context(t.inbound, _paths(t, split=True), combine="union_all")


_ACTED = """acted AS (SELECT order_id, order_id * 1000000000 + item_id AS id, first_ship AS made_at,
                      item_id % 10 + 1 AS action FROM item)"""


def _acted(t):
    return t.item.select("order_id", (F.col("order_id") * 1000000000 + F.col("item_id")).alias("id"),
                         F.col("first_ship").alias("made_at"),
                         (F.col("item_id") % 10 + 1).alias("action"))


@query("a34_state_before_call", f"""
    WITH {_context_sql(True)}, {_ACTED},
    ranked AS (
        SELECT c.*, a.made_at AS acted_at, a.action AS state_before,
               row_number() OVER (PARTITION BY c.call_id ORDER BY a.made_at DESC, a.id DESC) AS n
        FROM context c LEFT JOIN acted a ON a.order_id = c.live_program_order_id AND a.made_at < c.made_at)
    SELECT * EXCLUDE (n) FROM ranked WHERE n = 1""")
def _(t):
    return cl.state_before_call(cl.call_context(t.inbound, _paths(t, split=True)), _acted(t))


_HOLD = f"""
    {_context_sql(True)}, {_ACTED},
    latest AS (
        SELECT m.call_id, m.order_id, a.action, row_number() OVER (PARTITION BY m.call_id, m.order_id ORDER BY a.made_at DESC, a.id DESC) AS n
        FROM (SELECT DISTINCT call_id, order_id, made_at FROM met WHERE in_program) m
        JOIN acted a ON a.order_id = m.order_id AND a.made_at < m.made_at),
    holds AS (SELECT call_id, 1 AS acted_flag, max(CASE WHEN action = 5 THEN 1 ELSE 0 END) AS on_hold_flag
              FROM latest WHERE n = 1 GROUP BY 1),
    held AS (SELECT c.*, coalesce(h.acted_flag, 0) AS acted_flag, coalesce(h.on_hold_flag, 0) AS on_hold_flag
             FROM context c LEFT JOIN holds h USING (call_id))"""


def _held(t):
    return cl.call_context(t.inbound, _paths(t, split=True), history=_acted(t), held=5)


@query("a35_call_context_hold", f"WITH {_HOLD} SELECT * FROM held")
def _(t):
    return _held(t)


@query("a36_hold_call_impact", f"""
    WITH {_HOLD}
    SELECT h.*, o.status, o.order_id % 3 AS closed_stage,
           CASE WHEN o.status = 8 THEN o.placed_at + INTERVAL 20 DAY END AS cancelled_at,
           CASE WHEN o.status = 8 THEN 'reason ' || (o.order_id % 5) END AS closed_reason,
           CASE WHEN o.channel < '3' THEN o.order_id % 6 END AS latest_status,
           CASE WHEN o.channel < '3' THEN o.placed_at + INTERVAL 12 DAY END AS first_done_at,
           CASE WHEN o.channel < '3' AND o.order_id % 4 = 0 THEN 'rejected ' || (o.order_id % 3) END AS rejection_reason,
           CASE WHEN o.channel < '3' AND o.order_id % 4 = 1 THEN 'refused ' || (o.order_id % 3) END AS refuse_reason,
           CASE WHEN o.channel < '3' THEN o.placed_at + INTERVAL 25 DAY END AS last_done_at,
           CASE WHEN o.status = 8 AND o.order_id % 3 = 1 THEN 1 ELSE 0 END AS cancelled_in_stage,
           CASE WHEN on_hold_flag = 1 AND o.channel < '3' THEN date_diff('minute', made_at, o.placed_at + INTERVAL 25 DAY) END AS minutes_wasted,
           CASE WHEN o.status IN (2, 8) THEN date_diff('minute', made_at, o.placed_at + INTERVAL 20 DAY) END AS minutes_to_cancel
    FROM held h LEFT JOIN ord o ON o.order_id = h.live_program_order_id""")
def _(t):
    day = lambda n: F.timestamp_add("DAY", F.lit(n), "placed_at")
    text = lambda word, n: F.concat(F.lit(word), (F.col("order_id") % n).cast("string"))
    orders = t.ord.select("order_id", "status", (F.col("order_id") % 3).alias("closed_stage"),
                          F.when(F.col("status") == 8, day(20)).alias("cancelled_at"),
                          F.when(F.col("status") == 8, text("reason ", 5)).alias("closed_reason"))
    program = t.ord.filter("channel < '3'").select(
        "order_id", day(25).alias("last_done_at"), day(12).alias("first_done_at"),
        (F.col("order_id") % 6).alias("latest_status"),
        F.when(F.col("order_id") % 4 == 0, text("rejected ", 3)).alias("rejection_reason"),
        F.when(F.col("order_id") % 4 == 1, text("refused ", 3)).alias("refuse_reason"))
    return cl.hold_call_impact(_held(t), orders, program, 1)


_BASE = """
    base AS (
        SELECT DISTINCT o.order_id, o.customer_id, o.placed_at, o.status, l.item_id,
               CASE WHEN l.qty > 40 THEN 'caller' ELSE 'other' END AS entered_by, r.rx_count
        FROM ord o JOIN line l USING (order_id)
        LEFT JOIN (SELECT customer_id, count(*) AS rx_count FROM ord WHERE value > 30000000 GROUP BY 1) r
          ON r.customer_id = o.customer_id
        WHERE o.placed_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND l.needs_rx
          AND o.order_id NOT IN (SELECT order_id FROM line WHERE form = 'LARGE')),
    seen AS (SELECT customer_id, item_id, min(first_ship) AS first_seen FROM item JOIN ord USING (order_id)
             WHERE returned = 0 GROUP BY 1, 2),
    flagged AS (SELECT b.*, CASE WHEN first_seen < placed_at THEN 1 ELSE 0 END AS prefetchable
                FROM base b LEFT JOIN seen USING (customer_id, item_id))"""


def _base(t):
    items = t.line.filter("needs_rx").select(
        "order_id", "item_id", F.when(F.col("qty") > 40, "caller").otherwise("other").alias("entered_by"))
    rx = t.ord.filter("value > 30000000").groupBy("customer_id").agg(F.count(F.lit(1)).alias("rx_count"))
    custom = t.line.filter("form = 'LARGE'").select("order_id").distinct()
    return cl.item_rx_base(t.ord, items, rx, custom, "1996-01-01", "2000-12-31")


def _seen(t):
    return t.item.filter("returned = 0").join(t.ord, "order_id").select(
        "customer_id", "item_id", F.col("first_ship").alias("seen_at"))


def _saved_base(t):
    path = sinks.fresh_path(t.spark, "item_rx_base")
    sinks.append(_base(t), path)
    return t.spark.read.parquet(path)


@query("a37_prefetchable_items", f"""
    WITH {_BASE}
    SELECT order_id, customer_id, placed_at,
           CASE WHEN status IN (9, 10) THEN 'Fulfilled' WHEN status IN (2, 8) THEN 'Cancelled/Rejected'
                ELSE 'Under Process' END AS order_status, count(item_id) AS line_items,
           count(CASE WHEN entered_by = 'caller' THEN 1 END) AS entered_by_caller,
           sum(prefetchable)::BIGINT AS prefetchable FROM flagged GROUP BY 1, 2, 3, 4""")
def _(t):
    return cl.prefetchable_items(_base(t), _seen(t))


@query("a38_item_rx_base", f"WITH {_BASE} SELECT * FROM base")
def _(t):
    return _saved_base(t)


@query("a39_flag_prefetch", f"WITH {_BASE} SELECT * FROM flagged")
def _(t):
    return cl.flag_prefetch(_saved_base(t), _seen(t))


_RETURNS = """
    detail AS (
        SELECT r.order_id, r.item_id, r.qty, r.raised_at, r.source,
               CASE WHEN r.qty > 25 THEN r.item_id ELSE r.desired_item END AS desired_item,
               o.placed_at, g.hub, o.channel < '3' AS in_program, o.placed_at + INTERVAL 25 DAY AS answered_at,
               CASE WHEN r.item_id % 2 = 0 THEN 'dp_' || r.item_id ELSE 'img_' || r.item_id END AS image,
               r.raised_at - INTERVAL 10 DAY AS image_at, r.raised_at - INTERVAL 5 DAY AS entered_at,
               o.placed_at + INTERVAL 4 DAY AS delivered_at, CASE WHEN r.item_id % 3 = 0 THEN r.item_id % 17 + 1 ELSE r.item_id END AS delivered_item,
               CASE r.item_id % 3 WHEN 1 THEN 'CMS' WHEN 2 THEN 'APP/Web-Customer' END AS raised_source,
               CASE WHEN r.item_id % 3 = 1 AND r.order_id % 8 < 6 THEN 'agent ' || (r.order_id % 8) END AS raised_by_name,
               CASE WHEN r.item_id % 3 = 1 AND r.order_id % 8 < 6 THEN CASE WHEN r.order_id % 2 = 0 THEN 'care' ELSE 'desk' END END AS raised_by_role,
               CASE WHEN r.item_id % 9 < 6 THEN 'agent ' || (r.item_id % 9) END AS entered_by_name,
               CASE WHEN r.item_id % 9 < 6 THEN CASE WHEN r.item_id % 9 % 2 = 0 THEN 'care' ELSE 'desk' END END AS entered_by_role,
               CASE WHEN r.item_id % 9 < 6 THEN 'CMS' ELSE 'APP/Web-Customer' END AS entry_source,
               g.city AS place, 'retailer ' || (o.order_id % 4) AS retailer,
               CASE WHEN o.channel < '3' THEN CASE WHEN o.order_id % 7 IN (1, 2) THEN 'Third_Party' ELSE 'House' END ELSE 'Not Applicable' END AS staff_category,
               CASE WHEN o.channel < '3' THEN 'Dr ' || (o.order_id % 7) END AS staff_name,
               p.p_name AS item_name, CASE r.source % 3 WHEN 0 THEN 'raised' WHEN 1 THEN 'picked_up' ELSE 'reconciled' END AS return_status
        FROM ret r JOIN ord o USING (order_id) LEFT JOIN geo g ON g.customer_id = o.customer_id
        LEFT JOIN part p ON p.p_partkey = r.item_id),
    named AS (SELECT d.*, q.p_name AS desired_name, v.p_name AS delivered_name, v.p_size AS delivered_price
              FROM detail d LEFT JOIN part q ON q.p_partkey = d.desired_item LEFT JOIN part v ON v.p_partkey = d.delivered_item)"""
_LATE = "(image_at > placed_at AND entered_at >= answered_at)"


def _cause(extra):
    late = f"(source = 4 OR {_LATE})" if extra else _LATE
    return f"""CASE WHEN desired_item IS NOT NULL THEN CASE WHEN item_id = desired_item THEN 'Picker'
        WHEN source IN (1, 2, 3) THEN 'Entry-Customer' WHEN source = 11 THEN 'Entry-Warehouse'
        WHEN in_program AND image LIKE 'dp%' AND {late} THEN 'Entry-Program' ELSE 'Entry-Care' END END"""


_COLS = "order_id, raised_at, item_id, delivered_item, desired_item, item_name, delivered_name, desired_name"
_ALL = f"""{_COLS}, hub, placed_at, delivered_at, raised_source, raised_by_name, raised_by_role, entry_source,
    entered_by_name, entered_by_role, source"""
_OVERALL = f"{_RETURNS}, overall AS (SELECT {_ALL}, {_cause(True)} AS responsibility FROM named)"


def _attribution(t, start="1995-01-01", end="2010-12-31", **options):
    ret = t.ret.withColumns({
        "delivered_item": F.when(F.col("item_id") % 3 == 0, F.col("item_id") % 17 + 1).otherwise(F.col("item_id")),
        "raised_code": F.col("item_id") % 3, "raiser": F.col("order_id") % 8,
        "desired_item": F.when(F.col("qty") > 25, F.col("item_id")).otherwise(F.col("desired_item")),
        "return_status": F.when(F.col("source") % 3 == 0, "raised")
        .when(F.col("source") % 3 == 1, "picked_up").otherwise("reconciled")})
    entered = ret.select(
        "order_id", "item_id",
        F.concat(F.when(F.col("item_id") % 2 == 0, "dp_").otherwise("img_"),
                 F.col("item_id").cast("string")).alias("image"),
        F.timestamp_add("DAY", F.lit(-10), "raised_at").alias("image_at"),
        F.timestamp_add("DAY", F.lit(-5), "raised_at").alias("entered_at"), (F.col("item_id") % 9).alias("enterer"))
    i, seen = F.col("order_id"), F.col("channel") < "3"
    orders = t.ord.join(t.geo.select("customer_id", "hub", "city"), "customer_id").select(
        "order_id", "placed_at", "hub", F.col("city").alias("place"), seen.alias("in_program"),
        F.concat(F.lit("retailer "), (i % 4).cast("string")).alias("retailer"),
        staff_category(F.when(seen, i % 7), [1, 2]).alias("staff_category"),
        F.when(seen, F.concat(F.lit("Dr "), (i % 7).cast("string"))).alias("staff_name"),
        F.timestamp_add("DAY", F.lit(4), "placed_at").alias("delivered_at"),
        F.timestamp_add("DAY", F.lit(25), "placed_at").alias("answered_at"))
    names = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"),
                          F.col("p_size").alias("price"))
    people = t.spark.range(6).select(
        F.col("id").alias("person"), F.concat(F.lit("agent "), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 2 == 0, "care").otherwise("desk").alias("role"))
    return cl.return_attribution(ret, entered, orders, names, people, start, end, **options)


@query("a97_return_attribution", f"""
    WITH {_RETURNS} SELECT {_ALL}, {_cause(False)} AS responsibility FROM named
    WHERE raised_at::DATE BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")
def _(t):
    return _attribution(t, "2000-01-01", "2000-12-31")


@query("a98_attribution_probe", f"WITH {_OVERALL} SELECT * FROM overall WHERE responsibility = 'Entry-Care'")
def _(t):
    return filtered(_attribution(t, source4_rule=True), F.col("responsibility") == "Entry-Care")


@query("a99_attribution_care", f"""
    WITH {_RETURNS} SELECT {_COLS}, source, entered_by_name, entered_by_role FROM named
    WHERE item_id <> desired_item AND source IN (0, 5, 6, 7, 8, 10)
      AND (NOT in_program OR image NOT LIKE 'dp%' OR image_at <= placed_at OR entered_at < answered_at)""")
def _(t):
    return _attribution(t, slice="care")


@query("a100_attribution_program", f"""
    WITH {_RETURNS} SELECT {_COLS}, source, staff_category, staff_name FROM named
    WHERE item_id <> desired_item AND source NOT IN (1, 2, 3, 10) AND in_program AND image LIKE 'dp%'
      AND (source = 4 OR {_LATE})""")
def _(t):
    return _attribution(t, slice="program")


@query("a101_attribution_overall", f"WITH {_OVERALL} SELECT * FROM overall")
def _(t):
    return _attribution(t, source4_rule=True)


@query("a102_attribution_summary",
       f"WITH {_OVERALL} SELECT responsibility, count(order_id) AS returns FROM overall GROUP BY 1")
def _(t):
    return cl.attribution_summary(_attribution(t, source4_rule=True))


@query("a103_attribution_warehouse", f"""
    WITH {_RETURNS} SELECT {_COLS}, hub, place, retailer, return_status, delivered_price,
           CASE WHEN item_id = desired_item THEN 'Picker' ELSE 'Entry' END AS error_reason, sum(qty)::BIGINT AS quantity
    FROM named WHERE item_id = desired_item OR (item_id <> desired_item AND source = 11) GROUP BY ALL""")
def _(t):
    return _attribution(t, slice="warehouse")


@query("a29_probe_sample", "SELECT * FROM inbound ORDER BY made_at, call_id LIMIT 100")
def _(t):
    return probe_sample(t.inbound, 100, ["made_at", "call_id"])
