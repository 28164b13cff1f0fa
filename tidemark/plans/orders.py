"""Order wide rows, substitution, baskets, queues, validation, overdue orders, subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import orders as od
from tidemark.plans.registry import query
from tidemark.plans.views import PHONE, WEB

START, END = "1996-01-01", "1999-12-31"
GROUPS = {"cart_flag": [22, 23], "offline_flag": [14], "phone_flag": [43], "program_flag": [17],
          "first_flag": [1], "promo_flag": [11], "order_chronic_flag": [12]}
CHANNELS = {"1-URGENT": "PHONE", "2-HIGH": "APP", "3-MEDIUM": "WEBSITE", "4-NOT SPECIFIED": "CMS",
            "5-LOW": "PARTNER"}
# fixed values: reasons of a return
REASONS = {1: "No Longer Needed", 2: "Damaged", 3: "Wrong Item", 4: "Ice Pack Issue",
           5: "Non-Veg Item", 6: "Expired", 7: "Additional Item At PickUp", 8: "Extra Items"}


def _phones(t):
    return t.ord.withColumn("phone", F.floor(F.col("customer_id") / 2))


def _queue(t):
    return t.ord.filter("value >= 20000000").select("order_id")


_FLAGS = ",\n".join(
    f"CASE WHEN order_id IN (SELECT order_id FROM mark WHERE flag_id IN ({', '.join(map(str, codes))})) "
    f"THEN 1 ELSE 0 END AS {name}" for name, codes in GROUPS.items())


@query("a01_order_wide", f"""
    WITH flagged AS (
        SELECT o.order_id, o.customer_id, o.customer_id // 2 AS phone, o.placed_at AS placed_time, o.value,
               g.city, g.hub, CASE WHEN g.city_id % 2 = 1 THEN 1 ELSE 0 END AS courier_flag, o.channel AS platform,
               CASE o.channel {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNELS.items())} END AS source,
               {_FLAGS.replace("order_id IN", "o.order_id IN")},
               CASE WHEN o.customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 ELSE 0 END AS customer_chronic_flag,
               o.order_id IN (SELECT order_id FROM line GROUP BY 1 HAVING sum(needs_rx::INT) = 0) AS free,
               o.order_id IN (SELECT order_id FROM ord WHERE value >= 20000000) AS queued,
               o.order_id IN (SELECT order_id FROM sub_order WHERE order_id <> template_order_id) AS refilled,
               CASE WHEN o.order_id IN (SELECT order_id FROM sub_order) THEN 1 ELSE 0 END AS subscription_flag,
               o.channel IN ('2-HIGH', '3-MEDIUM') AS web
        FROM ord o LEFT JOIN geo g USING (customer_id)
        WHERE o.placed_at::DATE BETWEEN DATE '{START}' AND DATE '{END}' AND o.status IN (9, 10))
    SELECT * EXCLUDE (free, queued, refilled, web),
           CASE WHEN cart_flag = 1 AND free THEN 1 ELSE 0 END AS cart_without_rx_flag,
           CASE WHEN queued AND cart_flag = 0 AND NOT refilled AND web THEN 1 ELSE 0 END AS upload_flag,
           CASE WHEN refilled THEN 1 ELSE 0 END AS refill_flag,
           row_number() OVER (PARTITION BY customer_id ORDER BY placed_time, order_id) AS customer_order_number,
           row_number() OVER (PARTITION BY phone ORDER BY placed_time, order_id) AS phone_order_number
    FROM flagged""")
def _(t):
    owners = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    return od.order_wide(_phones(t), t.mark, t.line, owners, t.geo.select(
        "customer_id", "city", "hub", (F.col("city_id") % 2 == 1).alias("carrier")),
                         t.sub_order, _queue(t), GROUPS, CHANNELS, WEB, START, END)


_ANY = """min(created_at) AS first_logged_at, max(CASE WHEN log_type = 1 THEN 1 ELSE 0 END) AS offered,
    max(CASE WHEN log_type = 2 THEN 1 ELSE 0 END) AS viewed, max(CASE WHEN log_type = 3 THEN 1 ELSE 0 END) AS selected"""


@query("a02_substitution_funnel", f"""
    WITH chosen AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, original DESC) AS k
                       FROM sub_log WHERE log_type = 3) WHERE k = 1),
    seen AS (
        SELECT order_id, original, agent, max(substitute) AS offered_item, {_ANY}
        FROM sub_log WHERE created_at::DATE BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2, 3),
    bought AS (SELECT customer_id, item_id, max(placed_at) AS at_last FROM cart_item JOIN ord USING (order_id)
               WHERE invoiced GROUP BY 1, 2),
    ended AS (SELECT customer_id, max(placed_at) AS at_last FROM ord GROUP BY 1)
    SELECT s.order_id, s.original, s.agent, c.substitute,
           CASE WHEN o.status IN (9, 10) THEN 'fulfilled' WHEN o.status = 2 THEN 'rejected'
                WHEN o.status = 8 THEN 'cancelled' ELSE 'under process' END AS order_status,
           s.first_logged_at, s.offered, s.viewed, s.selected,
           CASE WHEN m.order_id IS NOT NULL THEN 1 ELSE 0 END AS in_cart,
           CASE WHEN m.order_id IS NOT NULL AND NOT m.deleted THEN 1 ELSE 0 END AS retained,
           CASE WHEN v.returned = 1 THEN 1 ELSE 0 END AS returned,
           CASE WHEN v.returned = 1 THEN CASE v.return_reason
                {" ".join(f"WHEN {k} THEN '{v}'" for k, v in REASONS.items())} END END AS return_reason,
           CASE WHEN bs.at_last > o.placed_at THEN 'dSubstituteOrderedAgain'
                WHEN bo.at_last > o.placed_at THEN 'cOriginalOrderedAgain'
                WHEN e.at_last > o.placed_at THEN 'bNoneOrderedAgain' ELSE 'aNeverOrderedAgain' END AS reordered
    FROM seen s LEFT JOIN chosen c ON s.order_id = c.order_id AND s.original = c.original AND s.agent = c.agent
    LEFT JOIN cart_item m ON s.order_id = m.order_id AND s.offered_item = m.item_id
    LEFT JOIN cart_item v ON s.order_id = v.order_id AND c.substitute = v.item_id AND v.invoiced
    LEFT JOIN ord o ON s.order_id = o.order_id
    LEFT JOIN bought bs ON bs.customer_id = o.customer_id AND bs.item_id = c.substitute
    LEFT JOIN bought bo ON bo.customer_id = o.customer_id AND bo.item_id = s.original
    LEFT JOIN ended e ON e.customer_id = o.customer_id""")
def _(t):
    return od.substitution_funnel(t.sub_log_by_order, t.cart_item_by_order, t.ord, REASONS, START, END)


@query("a03_substitution_daily", f"""
    WITH kept AS (SELECT * FROM sub_log WHERE created_at::DATE = DATE '2000-06-14' AND substitute_kind = 1)
    SELECT k.order_id, k.original, k.agent, {_ANY},
           max(CASE WHEN m.order_id IS NOT NULL THEN 1 ELSE 0 END) AS in_cart,
           max(CASE WHEN m.order_id IS NOT NULL AND NOT m.deleted THEN 1 ELSE 0 END) AS retained
    FROM kept k LEFT JOIN cart_item m ON k.order_id = m.order_id AND k.substitute = m.item_id GROUP BY 1, 2, 3""")
def _(t):
    return od.substitution_daily(t.sub_log, t.cart_item, "2000-06-15 09:00:00", 1)


@query("a07_channel_basket", f"""
    WITH people AS (
        SELECT o.order_id, o.channel, o.value, o.customer_id * 3 + i.item_id % 3 AS patient_id,
               CASE WHEN (o.customer_id * 3 + i.item_id % 3) % 7 <> 0
                    THEN 20 + (o.customer_id * 3 + i.item_id % 3) % 60 END AS age,
               o.order_id % 3 = 0 AS chronic, o.order_id % 2 = 0 AS needs_rx, count(i.item_id) FILTER (i.qty >= 10) AS meds,
               count(i.item_id) FILTER (i.qty < 10) AS deleted, sum(i.qty) AS qty, sum(i.gross) AS gross, sum(i.disc) AS disc
        FROM ord o LEFT JOIN item i USING (order_id)
        WHERE o.placed_at::DATE BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2, 3, 4, 5, 6, 7),
    ranked AS (
        SELECT *, CASE WHEN age IS NOT NULL THEN row_number() OVER
               (PARTITION BY order_id, age IS NOT NULL ORDER BY meds DESC, patient_id) END AS k FROM people),
    per AS (
        SELECT order_id, channel, value, chronic, needs_rx, sum(meds) AS meds, sum(deleted) AS deleted, sum(qty) AS qty,
               count(patient_id) AS patients, sum(gross) AS gross, sum(disc) AS disc, min(CASE WHEN k = 1 THEN age END) AS main_age
        FROM ranked GROUP BY 1, 2, 3, 4, 5)
    SELECT channel, count(*) AS total_orders, avg(value) AS avg_value,
           sum(disc)::DOUBLE / (sum(gross) * 100)::DOUBLE AS discount_share, count(*) FILTER (chronic) AS chronic_orders,
           count(*) FILTER (needs_rx) AS rx_orders, avg(meds) AS avg_line_items, avg(deleted) AS avg_deleted_items,
           sum(qty)::DOUBLE / count(*) AS quantity_per_order, sum(gross)::DOUBLE / sum(meds)::DOUBLE AS avg_product_value,
           avg(patients) FILTER (needs_rx) AS avg_patients, avg(main_age) AS avg_patient_age
    FROM per GROUP BY 1""")
def _(t):
    who = F.col("customer_id") * 3 + F.col("item_id") % 3
    lines = (t.item.join(t.ord.select("order_id", "customer_id"), "order_id")
             .select("order_id", "item_id", "qty", "gross", "disc", (F.col("qty") < 10).alias("deleted"),
                     who.alias("patient_id"),
                     F.when(who % 7 != 0, 20 + who % 60).alias("age")))
    orders = t.ord.withColumns({"chronic": F.col("order_id") % 3 == 0, "needs_rx": F.col("order_id") % 2 == 0})
    return od.channel_basket(orders, lines, START, END)


@query("a08_paired_channels", """
    WITH kept AS (
        SELECT o.*, l.item_id, l.chronic, CASE WHEN channel = '1-URGENT' THEN 'a' ELSE 'b' END AS side
        FROM ord o LEFT JOIN line l USING (order_id)
        WHERE status IN (9, 10) AND channel IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
          AND customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)),
    per AS (
        SELECT customer_id, side, count(DISTINCT order_id) AS n, avg(value) AS value,
               count(item_id) AS items, count(CASE WHEN NOT chronic THEN item_id END) AS acute
        FROM kept GROUP BY 1, 2)
    SELECT a.customer_id, a.n AS a_orders, a.value AS a_value, a.items AS a_line_items, a.acute AS a_acute_items,
           b.n AS b_orders, b.value AS b_value, b.items AS b_line_items, b.acute AS b_acute_items
    FROM per a JOIN per b ON a.customer_id = b.customer_id AND a.side = 'a' AND b.side = 'b'""")
def _(t):
    who = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"))
    return od.paired_channels(t.ord, t.line, [PHONE], WEB, who)


def _matrix_columns():
    out = []
    for s in ("fulfilled", "rejected"):
        out.append(f"count(CASE WHEN queue IS NULL AND state = '{s}' THEN 1 END) AS blank_{s}")
        for q in ("refill", "no_rx"):
            out.append(f"count(CASE WHEN queue = '{q}' AND state = '{s}' THEN 1 END) AS {q}_{s}")
        for q in ("cart", "non_cart"):
            for c in ("called", "not_called"):
                out.append(f"count(CASE WHEN queue = '{q}' AND called = '{c}' AND state = '{s}' THEN 1 END) AS {q}_{c}_{s}")
    return ",\n".join(out)


@query("a11_queue_status_matrix", f"""
    WITH ranked AS (SELECT order_id, rank() OVER (PARTITION BY subscription_id ORDER BY order_id) AS r FROM sub_order),
    rung AS (
        SELECT DISTINCT TRY_CAST(CASE WHEN position('|' IN ref) > 0 AND ref[1] BETWEEN '0' AND '9'
               THEN split_part(ref, '|', 1) END AS BIGINT) AS order_id FROM comment_log),
    tagged AS (
        SELECT o.*, CASE WHEN r.r > 1 THEN 'refill'
               WHEN o.value >= 20000000 THEN CASE WHEN o.order_id IN (SELECT order_id FROM mark WHERE flag_id IN (22, 23)) THEN 'cart' ELSE 'non_cart' END
               WHEN o.order_id IN (SELECT order_id FROM mark WHERE flag_id IN (22, 23))
                AND o.order_id IN (SELECT order_id FROM line GROUP BY 1 HAVING sum(needs_rx::INT) = 0) THEN 'no_rx' END AS queue,
               CASE WHEN o.status IN (9, 10) THEN 'fulfilled' WHEN o.status IN (2, 8) THEN 'rejected' END AS state,
               CASE WHEN o.order_id IN (SELECT order_id FROM rung WHERE order_id IS NOT NULL) THEN 'called' ELSE 'not_called' END AS called,
               o.order_id IN (SELECT order_id FROM item GROUP BY 1 HAVING min(returned) = 1) AS auto
        FROM ord o LEFT JOIN ranked r USING (order_id)
        WHERE o.placed_at::DATE BETWEEN DATE '{START}' AND DATE '{END}')
    SELECT year(placed_at) AS year, month(placed_at) AS month, {_matrix_columns()},
           count(CASE WHEN auto THEN 1 END) AS auto_accepted FROM tagged GROUP BY 1, 2""")
def _(t):
    history = t.item.select("order_id", F.when(F.col("returned") == 1, 218).otherwise(1).alias("updated_by"))
    return od.queue_status_matrix(t.ord, t.mark, t.line, _queue(t), t.sub_order, history,
                                  t.comment_log, [22, 23], 218, START, END)


UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
# fixed values: doses per day of each frequency code
WEIGHTS = {0: 1.0, 1: 0.143, 2: 0.286, 3: 0.067, 4: 0.033}
_UNIT = ["day", "week", "month", "year", "lifetime", "not-mentioned"]


@query("a12_rx_validation", f"""
    WITH note AS (
        SELECT order_id, item_id, first_ship AS prescribed_at, qty AS duration,
               CASE item_id % 6 {" ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_UNIT))} END AS unit,
               CASE WHEN qty % 2 = 0 THEN 'H' END AS hospital, CASE WHEN qty % 3 = 0 THEN 'D' END AS staff,
               item_id % 6 AS frequency, qty % 2 AS morning, qty % 3 AS noon, qty % 4 AS evening
        FROM item WHERE returned = 0)
    SELECT o.order_id, o.placed_at, g.city, g.hub, CASE WHEN o.order_id % 2 = 0 THEN 1 ELSE 0 END AS program_flag,
           max(CASE WHEN n.unit IS NULL THEN 1 ELSE 0 END) AS some_item_without_rx,
           min(n.prescribed_at) AS prescribed_at, max(CASE WHEN n.hospital IS NOT NULL THEN 1 ELSE 0 END) AS hospital_flag,
           max(CASE WHEN n.staff IS NOT NULL THEN 1 ELSE 0 END) AS staff_flag,
           min(CASE n.unit WHEN 'day' THEN duration WHEN 'week' THEN duration * 7 WHEN 'month' THEN duration * 30
                    WHEN 'year' THEN duration * 365 WHEN 'lifetime' THEN CASE WHEN l.chronic THEN 1095 ELSE 180 END
                    WHEN 'not-mentioned' THEN CASE WHEN l.chronic THEN 1095 ELSE 180 END END)::BIGINT AS duration_days,
           min(morning + noon + evening) AS dosage_per_day,
           min(CASE frequency {" ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} END) AS frequency_weight
    FROM ord o JOIN line l ON o.order_id = l.order_id AND l.needs_rx JOIN geo g ON o.customer_id = g.customer_id
    LEFT JOIN note n ON l.order_id = n.order_id AND l.item_id = n.item_id
    WHERE o.placed_at::DATE BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    units = F.array(*[F.lit(u) for u in _UNIT])
    q, i = F.col("qty"), F.col("item_id")
    notes = t.item.filter("returned = 0").select(
        "order_id", "item_id", F.col("first_ship").alias("prescribed_at"), q.alias("duration"),
        F.element_at(units, (i % 6 + 1).cast("int")).alias("unit"),
        F.when(q % 2 == 0, "H").alias("hospital"), F.when(q % 3 == 0, "D").alias("staff"),
        (i % 6).cast("int").alias("frequency"), (q % 2).alias("morning"), (q % 3).alias("noon"),
        (q % 4).alias("evening"))
    placed = t.ord.join(t.geo.select("customer_id", "city", "hub"), "customer_id").withColumn(
        "in_program", F.col("order_id") % 2 == 0)
    return od.rx_validation(placed, t.line.select("order_id", "item_id", "needs_rx", "chronic"), notes,
                            ["hospital", "staff"], UNITS, WEIGHTS, START, END)


STAGES, OWNERS = {1: "ORDER PLACED", 8: "ON HOLD"}, {1: "intake", 8: "care"}


@query("a17_overdue_orders", """
    WITH ranked AS (SELECT order_id, rank() OVER (PARTITION BY subscription_id ORDER BY order_id) AS r FROM sub_order),
    moved AS (SELECT order_id, max(first_ship) AS changed_at FROM item GROUP BY 1)
    SELECT o.order_id, o.placed_at, o.placed_at::DATE + 3 AS promised_on, g.hub, CASE o.status WHEN 1 THEN 'ORDER PLACED' WHEN 8 THEN 'ON HOLD' END AS current_status,
           CASE o.status WHEN 1 THEN 'intake' WHEN 8 THEN 'care' END AS responsible,
           CASE WHEN o.order_id % 4 = 1 THEN 'corporate' WHEN r.r > 1 THEN 'refill' WHEN g.city_id % 2 = 1 THEN 'courier' END AS order_type,
           date_diff('minute', m.changed_at, TIMESTAMP '2000-06-15 09:50:00') AS minutes_since_change,
           date_diff('hour', m.changed_at, TIMESTAMP '2000-06-15 09:50:00') AS hours_since_change
    FROM ord o LEFT JOIN geo g USING (customer_id) LEFT JOIN ranked r USING (order_id) LEFT JOIN moved m USING (order_id)
    WHERE o.placed_at BETWEEN TIMESTAMP '2000-06-14 12:00:00' AND TIMESTAMP '2000-06-15 12:00:00'
      AND o.status IN (1, 8) AND o.channel <> '5-LOW'""")
def _(t):
    moved = t.item.groupBy("order_id").agg(F.max("first_ship").alias("changed_at"))
    direct = t.ord.filter("channel = '5-LOW'").select("order_id")
    orders = t.ord.withColumn("promised_at", F.timestamp_add("DAY", F.lit(3), "placed_at"))
    courier = t.ord.join(t.geo.filter("city_id % 2 = 1").select("customer_id"), "customer_id")
    return od.overdue_orders(orders, moved, t.sub_order, direct, t.geo.select("customer_id", "hub"),
                             t.ord.filter("order_id % 4 = 1"), courier, STAGES, OWNERS, "2000-06-15 10:00:00")


_SUB_DIMS = ["year", "month", "hub", "channel"]


@query("a71_subscription_matrix", """
    WITH ranked AS (SELECT *, rank() OVER (PARTITION BY subscription_id ORDER BY order_id) > 1 OR clone AS refill FROM sub_order),
    shipped AS (SELECT order_id, min(first_ship)::DATE AS done_on FROM item GROUP BY 1),
    base AS (
        SELECT o.*, year(placed_at) AS year, month(placed_at) AS month, g.hub, r.refill, status IN (9, 10) AS ok,
               CASE WHEN placed_at::DATE + 30 = done_on THEN 'on_time' WHEN placed_at::DATE + 30 > done_on THEN 'before_time'
                    ELSE 'after_time' END AS kept
        FROM ord o JOIN ranked r USING (order_id) JOIN geo g ON g.customer_id = o.customer_id
        LEFT JOIN shipped s ON s.order_id = o.order_id WHERE placed_at > TIMESTAMP '1996-01-01 00:00:00')
    SELECT year, month, hub, channel, count(DISTINCT order_id) AS total_orders,
           count(DISTINCT order_id) FILTER (ok) AS delivered_orders, count(DISTINCT order_id) FILTER (refill) AS refill_orders,
           count(DISTINCT order_id) FILTER (refill AND ok) AS refill_delivered_orders,
           count(DISTINCT order_id) FILTER (refill AND status = 2) AS refill_rejected_orders,
           count(DISTINCT order_id) FILTER (refill AND status = 8) AS refill_cancelled_orders,
           count(DISTINCT order_id) FILTER (refill AND ok AND kept = 'on_time') AS refill_on_time_orders,
           count(DISTINCT order_id) FILTER (refill AND ok AND kept = 'before_time') AS refill_before_time_orders,
           count(DISTINCT order_id) FILTER (refill AND ok AND kept = 'after_time') AS refill_after_time_orders,
           sum(CASE WHEN order_id % 3 > 0 THEN order_id % 5 + 1 END) FILTER (refill AND ok)::BIGINT AS refill_feedback,
           count(CASE WHEN order_id % 3 > 0 THEN 1 END) FILTER (refill AND ok) AS refill_feedbacks,
           sum(value) FILTER (refill AND ok)::BIGINT AS refill_value, sum(value) FILTER (ok)::BIGINT AS delivered_value,
           sum(value - value // 10) FILTER (refill AND ok)::BIGINT AS refill_discounted_value,
           sum(value - value // 10) FILTER (ok)::BIGINT AS delivered_discounted_value,
           count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (ok) AS customers_delivered_orders,
           count(DISTINCT customer_id) FILTER (refill) AS customers_refill_orders,
           count(DISTINCT customer_id) FILTER (refill AND ok) AS customers_refill_delivered_orders
    FROM base GROUP BY 1, 2, 3, 4""")
def _(t):
    shipped = t.item.groupBy("order_id").agg(F.to_date(F.min("first_ship")).alias("done_on"))
    rows = (t.ord.join(t.geo.select("customer_id", "hub"), "customer_id").join(shipped, "order_id", "left")
            .withColumns({"year": F.year("placed_at"), "month": F.month("placed_at"),
                          "due_on": F.date_add(F.to_date("placed_at"), 30),
                          "feedback": F.when(F.col("order_id") % 3 > 0, F.col("order_id") % 5 + 1),
                          "discounted_value": F.col("value") - F.floor(F.col("value") / 10)}))
    return od.subscription_matrix(rows, t.sub_order, _SUB_DIMS, "1996-01-01 00:00:00")


@query("a28_order_phones", """
    SELECT o.order_id, o.customer_id, o.customer_id // 2 AS contact_phone, c_custkey + 1000000 AS registered_phone
    FROM ord o LEFT JOIN customer ON c_custkey = o.customer_id""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("customer_id"),
                               (F.col("c_custkey") + 1000000).alias("phone"))
    return od.order_phones(_phones(t), people)
