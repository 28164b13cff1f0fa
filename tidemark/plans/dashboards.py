"""Hour comparison, open cases, live tracker, funnel, phone orders, trends and geo counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dashboards as db
from tidemark.plans.facts import PARTNERS, SOURCES, office_sql, staff
from tidemark.plans.registry import QUERIES, SQL, query
from tidemark.plans.views import EVENTS_AS_OF, ORDERS_AS_OF, PARTNER, PHONE

OWNERS = {"Third_Party": [0, 1], "Panel": [2]}
NAMES = {1: "Moved", 2: "Assigned", 3: "Rejected", 4: "Accepted", 5: "On Hold"}


def _entities(t):
    return t.program.join(t.geo.select(F.col("customer_id").alias("entity_id"), "segment", "hub"),
                          "entity_id").withColumn(
        "owner", F.when(F.col("entity_id") % 7 != 6, F.col("entity_id") % 7))


_ENTITY = """
    entity AS (
        SELECT p.*, g.segment, g.hub, CASE WHEN entity_id % 7 <> 6 THEN entity_id % 7 END AS owner
        FROM program p JOIN geo g ON g.customer_id = p.entity_id)"""


@query("a52_hour_comparator", f"""
    WITH {_ENTITY},
    base AS (SELECT s.entity_id, s.made_at, s.code, e.segment, e.owner, date_diff('day', s.made_at::DATE, DATE '2024-01-30') AS back
             FROM status_log s JOIN entity e USING (entity_id) WHERE s.code IN (1, 4))
    SELECT hour(made_at) AS hour, CASE code WHEN 1 THEN 'Moved' ELSE 'Accepted' END AS category, segment,
           CASE WHEN owner IN (0, 1) THEN 'Third_Party' WHEN owner = 2 THEN 'Panel' WHEN owner IS NULL THEN 'NotAssigned' ELSE 'House' END AS owner_category,
           count(*) FILTER (back = 0) AS back_0, count(*) FILTER (back = 1) AS back_1, count(*) FILTER (back = 7) AS back_7,
           count(*) FILTER (back = 14) AS back_14, count(*) FILTER (back IN (7, 14, 21, 28)) AS same_weekday_sum,
           count(*) FILTER (back IN (7, 14, 21, 28)) / 4 AS same_weekday_avg
    FROM base GROUP BY 1, 2, 3, 4""")
def _(t):
    labels = {1: "Moved", 4: "Accepted"}
    return db.hour_comparator(t.status_log, _entities(t), labels, OWNERS, EVENTS_AS_OF)


_TIMES = """
    times AS (
        SELECT entity_id, min(made_at) FILTER (code IN (1, 2)) AS moved_at, min(made_at) FILTER (code = 2) AS assigned_at,
               min(made_at) FILTER (code IN (3, 4, 5)) AS first_response_at, max(made_at) FILTER (code IN (3, 4, 5)) AS last_response_at,
               min(made_at) FILTER (code = 4) AS first_done_at, max(made_at) FILTER (code = 4) AS last_done_at,
               max(made_at) FILTER (code = 3) AS rejected_at, count(DISTINCT made_at) FILTER (code = 5) AS holds,
               count(DISTINCT made_at) FILTER (code IN (3, 4, 5)) AS attempts
        FROM status_log GROUP BY 1)"""


@query("a53_open_cases", f"""
    WITH {_ENTITY}, {_TIMES},
    prior AS (SELECT entity_id, owner AS prior_owner FROM (
        SELECT entity_id, k % 8 AS owner, row_number() OVER (PARTITION BY entity_id ORDER BY id DESC) AS n FROM stage_log) WHERE n = 2),
    promise AS (SELECT entity_id, min_by(made_at::DATE + 2, id) AS original_promise FROM status_log WHERE code = 2 GROUP BY 1)
    SELECT e.entity_id, e.placed_at, p.original_promise, CASE WHEN e.entity_id % 4 = 1 THEN 1 ELSE 0 END AS courier_flag,
           e.placed_at + INTERVAL 10 MINUTE AS requested_at, e.last_code AS latest_action,
           CASE WHEN e.entity_id % 3 = 2 THEN 1 ELSE 0 END AS issue_flag,
           CASE e.entity_id % 12 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in SOURCES.items())} END AS case_source,
           CASE WHEN e.owner IN (0, 1) THEN 'Third_Party' WHEN e.owner = 2 THEN 'Panel'
                WHEN e.owner IS NULL THEN CASE WHEN r.prior_owner IN (0, 1) THEN 'Third_Party' WHEN r.prior_owner = 2 THEN 'Panel'
                     WHEN r.prior_owner IS NULL THEN 'Not Applicable' ELSE 'House' END ELSE 'House' END AS owner_category,
           t.* EXCLUDE (entity_id)
    FROM entity e JOIN times t USING (entity_id) LEFT JOIN prior r USING (entity_id) LEFT JOIN promise p USING (entity_id)
    WHERE e.last_code = 3""")
def _(t):
    log = t.stage_log.withColumn("owner", F.col("k") % 8)
    promises = t.status_log.filter("code = 2").select(
        "entity_id", "id", F.date_add(F.to_date("made_at"), 2).alias("promised_on"))
    cases = _tracked(t).withColumn("requested_at", F.timestamp_add("MINUTE", F.lit(10), "placed_at"))
    return db.open_cases(cases, log, promises, 3, OWNERS, SOURCES)


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


STATES = {4: "Fulfilled", 3: "In_Stage", 5: "Cancelled", 2: "Rejected"}
_CASE = lambda column, names: f"CASE {column} {' '.join(f'WHEN {k} THEN {v!r}' for k, v in names.items())}"


def _tracked(t):
    return _entities(t).withColumns({
        "customer_id": F.col("entity_id") % 50, "platform": F.col("segment"), "place": F.col("hub"),
        "new_customer": F.col("entity_id") % 2 == 0, "cart": F.col("entity_id") % 3 == 0,
        "chronic": F.col("entity_id") % 5 == 0, "courier": F.col("entity_id") % 4 == 1,
        "staff": F.col("owner"), "source": F.col("entity_id") % 12, "kind": F.col("entity_id") % 3})


@query("a54_live_tracker", f"""
    WITH {_ENTITY}, {_TIMES},
    coarse AS (
        SELECT entity_id, code, lead(code) OVER (PARTITION BY entity_id ORDER BY id) AS next_code,
               lead(made_at) OVER (PARTITION BY entity_id ORDER BY id) AS next_at,
               row_number() OVER (PARTITION BY entity_id, code = 3 ORDER BY id) AS n FROM status_log WHERE code IN (1, 3, 5)),
    won AS (SELECT entity_id % 50 AS customer_id, min(entity_id) AS won FROM entity WHERE last_code = 4 GROUP BY 1),
    answered AS (
        SELECT t.* REPLACE (CASE WHEN k.next_code IS DISTINCT FROM 5 OR date_diff('second', t.first_response_at, k.next_at) >= 40
                            THEN t.first_response_at END AS first_response_at),
               coalesce(k.next_code = 5 AND (date_diff('second', t.first_response_at, k.next_at) < 40 OR t.first_response_at IS NULL), false) AS canned
        FROM times t LEFT JOIN coarse k ON k.entity_id = t.entity_id AND k.code = 3 AND k.n = 1),
    mins AS (
        SELECT e.entity_id, e.entity_id % 50 AS customer_id,
               CASE WHEN e.entity_id = w.won THEN 'First Successful Consultation' WHEN e.entity_id > w.won THEN 'Repeat'
                    ELSE 'Zero Successful Consultations' END AS consultation_number, e.placed_at, e.segment AS order_platform, e.hub AS place,
               {_CASE('e.last_code', STATES)} ELSE 'Under_Process' END AS order_status,
               CASE WHEN e.entity_id % 2 = 0 THEN 1 ELSE 0 END AS new_customer, CASE WHEN e.entity_id % 3 = 0 THEN 1 ELSE 0 END AS cart,
               CASE WHEN e.entity_id % 5 = 0 THEN 1 ELSE 0 END AS chronic, CASE WHEN e.entity_id % 4 = 1 THEN 1 ELSE 0 END AS courier,
               'Dr ' || e.owner AS staff_name, CASE WHEN e.owner IN (1, 2) THEN 'Third_Party' WHEN e.owner IS NULL THEN 'Not Applicable' ELSE 'House' END AS staff_category,
               {_CASE('e.last_code', NAMES)} END AS final_action, CASE WHEN t.canned THEN 1 END AS cancelled_before_response,
               CASE WHEN e.entity_id % 3 = 2 THEN 1 ELSE 0 END AS issue_flag, {_CASE('e.entity_id % 12', SOURCES)} END AS case_source,
               CASE WHEN e.last_code = 3 THEN 1 ELSE 0 END AS in_stage, t.* EXCLUDE (entity_id, last_response_at, attempts, canned),
               ({office_sql('moved_at', 'last_done_at')}) / 60 AS ldo, ({office_sql('moved_at', 'first_done_at')}) / 60 AS fdo,
               ({office_sql('moved_at', 't.first_response_at')}) / 60 AS fro, ({office_sql('moved_at', _NOW)}) / 60 AS age
        FROM entity e JOIN answered t USING (entity_id) LEFT JOIN won w ON w.customer_id = e.entity_id % 50),
    acts AS (
        SELECT entity_id, id AS action_id, CASE code {" ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items())} END AS action, made_at AS changed_at,
               CASE date_diff('day', made_at::DATE, DATE '2024-01-30') {" ".join(f"WHEN {k} THEN '{v}'" for k, v in db.DAY_LABELS.items())} END AS day_filter,
               CASE WHEN m <= 1440 THEN 1 WHEN m > 1440 AND m <= 2880 THEN 2 WHEN m > 11520 AND m <= 12960 THEN 9 WHEN m > 21600 AND m <= 23040 THEN 16 END AS hour24_filter,
               r AS action_rank, date_diff('second', made_at, next_at) AS gap
        FROM (SELECT *, date_diff('minute', made_at, {_NOW}) AS m, rank() OVER (PARTITION BY entity_id ORDER BY id) AS r FROM step)),
    recent AS (SELECT * EXCLUDE (gap) FROM acts WHERE (gap > 2 OR gap IS NULL) AND (day_filter IS NOT NULL OR hour24_filter IS NOT NULL))
    SELECT m.* EXCLUDE (ldo, fdo, fro, age),
           date_diff('second', moved_at, last_done_at) / 60 AS last_done_minutes, CASE WHEN last_done_at IS NOT NULL THEN ldo END AS last_done_office_minutes,
           date_diff('second', moved_at, first_done_at) / 60 AS first_done_minutes, CASE WHEN first_done_at IS NOT NULL THEN fdo END AS first_done_office_minutes,
           date_diff('second', moved_at, first_response_at) / 60 AS response_minutes,
           CASE WHEN first_response_at IS NOT NULL THEN fro END AS response_office_minutes, age AS age_office_minutes,
           CASE WHEN coalesce(CASE WHEN first_response_at IS NOT NULL THEN fro END, age) > 60 THEN 1 ELSE 0 END AS internal_breach,
           CASE WHEN coalesce(CASE WHEN first_response_at IS NOT NULL THEN fro END, age) > 120 THEN 1 ELSE 0 END AS committed_breach,
           CASE WHEN first_done_at IS NOT NULL THEN CASE WHEN fdo > 120 THEN 1 ELSE 0 END END AS overall_breach,
           r.* EXCLUDE (entity_id)
    FROM mins m LEFT JOIN recent r USING (entity_id) WHERE in_stage = 1 OR r.action_id IS NOT NULL""")
def _(t):
    """The case history stands in for the order's; its code 5 for a cancellation."""
    return db.live_tracker(_tracked(t), t.status_log, t.status_log.filter("code in (1, 3, 5)"), staff(t), 3, 5,
                           EVENTS_AS_OF, NAMES, STATES, SOURCES, PARTNERS)


_FACT = SQL["a79_consultation_fact"]


_FUNNEL_DIMS = ["platform", "place", "corporate", "new_customer", "cart", "chronic", "courier"]
_OWN = ["Order Cancelled by user", "Order Cancelled By Moderator"]


@query("a62_program_funnel", f"""
    WITH consulted AS ({_FACT}), {_ENTITY},
    paid AS (SELECT user_id AS entity_id, sum(round(value * 100)::BIGINT)::BIGINT AS value,
                    count(*) FILTER (event_type = 'purchase') AS answers FROM events GROUP BY 1),
    base AS (
        SELECT f.*, e.segment AS platform, e.hub AS place, f.entity_id % 6 = 1 AS corporate, f.entity_id % 2 = 0 AS new_customer,
               f.entity_id % 3 = 0 AS cart, f.entity_id % 5 = 0 AS chronic, f.entity_id % 4 = 1 AS courier,
               CASE latest_status WHEN 4 THEN CASE WHEN f.entity_id % 2 = 0 THEN 9 ELSE 1 END WHEN 5 THEN 8 WHEN 3 THEN 2 ELSE 1 END AS status,
               CASE WHEN latest_status IN (3, 5) THEN 'closed for ' || (f.entity_id % 4) END AS closed_reason,
               CASE WHEN latest_status IN (3, 5) THEN f.placed_at + INTERVAL 2 DAY END AS closed_at, p.value, p.answers
        FROM consulted f JOIN entity e ON e.entity_id = f.entity_id JOIN paid p ON p.entity_id = f.entity_id)
    SELECT placed_at::DATE AS placed_on, consultation_type,
           CASE WHEN latest_status = 4 AND status IN (9, 10) THEN '1_Done Fulfilled' WHEN latest_status = 4 THEN '2_Done'
                WHEN first_response_at IS NOT NULL THEN '3_Reached Out' WHEN first_assigned_at IS NOT NULL THEN '4_Assigned'
                WHEN latest_status IS NOT NULL THEN '5_Moved' END AS funnel_drop,
           CASE WHEN response_office_minutes <= 30 THEN '1) 0 to 30 mins' WHEN response_office_minutes <= 60 THEN '2) 30 to 60 mins'
                WHEN response_office_minutes <= 90 THEN '3) 60 to 90 mins' WHEN response_office_minutes <= 120 THEN '4) 90 to 120 mins' ELSE '5) > 120 mins' END AS response_bucket,
           CASE status WHEN 8 THEN 'Cancellation' WHEN 2 THEN 'Rejection' END AS closed_bucket, closed_reason, staff_category,
           order_source AS case_source, rejection_reason,
           CASE WHEN rejection_reason IN ({", ".join(f"'{r}'" for r in _OWN)}) THEN 'Admin/User' WHEN rejection_reason IS NOT NULL THEN 'Staff' END AS rejection_bucket,
           {", ".join(_FUNNEL_DIMS)}, count(*) AS orders, count(customer_id) AS customers, count(*) FILTER (status IN (9, 10)) AS fulfilled,
           count(*) FILTER (status = 2) AS rejected, count(*) FILTER (status = 8) AS cancelled,
           count(*) FILTER (status NOT IN (2, 8, 9, 10)) AS open, count(*) FILTER (issue_flag = 1) AS issue_orders,
           count(*) FILTER (first_response_at IS NOT NULL) AS responded, sum(attempts) FILTER (first_response_at IS NOT NULL)::BIGINT AS attempts,
           count(*) FILTER (holds > 0) AS held_orders, sum(holds)::BIGINT AS holds, sum(value)::BIGINT AS value, sum(answers)::BIGINT AS answers,
           sum(date_diff('minute', first_moved_at, closed_at))::BIGINT AS minutes_to_close,
           count(*) FILTER (first_done_at IS NOT NULL) AS done_orders, sum(internal_breach)::BIGINT AS internal_breaches,
           sum(committed_breach)::BIGINT AS committed_breaches, sum(overall_breach)::BIGINT AS overall_breaches,
           sum(round(response_office_minutes * 60)::BIGINT)::BIGINT AS response_office_seconds,
           sum(round(first_done_office_minutes * 60)::BIGINT)::BIGINT AS done_office_seconds,
           sum(round(last_done_office_minutes * 60)::BIGINT)::BIGINT AS last_done_office_seconds
    FROM base GROUP BY ALL""")
def _(t):
    fact = QUERIES["a79_consultation_fact"](t.spark, t.folder)
    code, i = F.col("last_code"), F.col("entity_id")
    closed = code.isin(3, 5)
    orders = _entities(t).select(
        "entity_id", F.col("segment").alias("platform"), F.col("hub").alias("place"),
        (i % 6 == 1).alias("corporate"), (i % 2 == 0).alias("new_customer"), (i % 3 == 0).alias("cart"),
        (i % 5 == 0).alias("chronic"), (i % 4 == 1).alias("courier"),
        F.when(code == 4, F.when(i % 2 == 0, 9).otherwise(1)).when(code == 5, 8)
        .when(code == 3, 2).otherwise(1).alias("status"),
        F.when(closed, F.concat(F.lit("closed for "), (i % 4).cast("string"))).alias("closed_reason"),
        F.when(closed, F.timestamp_add("DAY", F.lit(2), "placed_at")).alias("closed_at"))
    paid = t.events.groupBy(F.col("user_id").alias("entity_id")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("answers"))
    return db.program_funnel(fact, orders, paid, _FUNNEL_DIMS, _OWN)


OUTCOMES = {2: "uploaded", 4: "moved to program", 5: "cancelled", 3: "rejected"}
_PHONE = f"""
    {_ENTITY},
    upload AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY id DESC) AS r FROM step WHERE code = 1) WHERE r = 1),
    counts AS (
        SELECT entity_id, count(*) AS items, count(*) FILTER (NOT deleted) AS items_delivered, count(*) FILTER (item_code % 2 = 1) AS chronic_items,
               count(*) FILTER (NOT deleted AND item_code % 2 = 1) AS chronic_delivered FROM stage_item GROUP BY 1),
    links AS (SELECT entity_id, max(made_at) - INTERVAL 5 MINUTE AS link_sent_at FROM status_log WHERE code = 1 AND entity_id % 5 < 3 GROUP BY 1),
    cases AS (SELECT entity_id, last_code AS case_status FROM program WHERE entity_id % 3 = 0),
    closings AS (
        SELECT entity_id, min_by(id % 3 + 1, id) AS action, min_by('because ' || (id % 4), id) AS reason, bool_or(id % 3 + 1 = 3) AS to_program
        FROM status_log WHERE code IN (3, 5) AND id % 2 = 0 GROUP BY 1),
    detail AS (
        SELECT e.entity_id, e.entity_id % 50 AS customer_id, e.placed_at, e.placed_at::DATE AS placed_on, e.entity_id * 100 AS value,
               e.segment AS delivery_place, e.hub AS supplier_place, CASE WHEN p.case_status IS NOT NULL THEN 1 ELSE 0 END AS program_flag,
               CASE e.entity_id % 9 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in db.PLACEMENT.items())} END AS placement_reason,
               'agent ' || (e.entity_id % 6) AS agent, CASE WHEN e.entity_id % 2 = 0 THEN 'care' ELSE 'desk' END AS agent_role,
               CASE e.last_code WHEN 4 THEN 'Fulfilled' WHEN 5 THEN 'Cancelled' WHEN 3 THEN 'Rejected' ELSE 'Under Process' END AS order_status,
               CASE WHEN e.last_code IN (3, 5) THEN 'cause ' || (e.entity_id % 4) END AS cancel_reason,
               CASE WHEN e.last_code IN (3, 5) THEN 'agent ' || (e.entity_id % 5) END AS cancelled_by,
               CASE WHEN e.last_code IN (3, 5) THEN CASE WHEN e.entity_id % 5 % 2 = 0 THEN 'care' ELSE 'desk' END END AS cancelled_by_role,
               CASE WHEN e.entity_id % 4 = 0 THEN 1 ELSE 0 END AS acquired_by_phone,
               CASE WHEN p.case_status IS NOT NULL AND k.link_sent_at IS NULL THEN 'Chose program' WHEN k.link_sent_at IS NOT NULL THEN 'Link option chosen'
                    WHEN e.entity_id % 7 = 0 THEN 'No item needs one' WHEN e.entity_id % 2 = 1 THEN 'Attached from previous' END AS order_type,
               CASE WHEN p.case_status = 4 THEN 1 ELSE 0 END AS program_done_flag, CASE WHEN l.to_program THEN 1 ELSE 0 END AS moved_to_program_flag,
               CASE WHEN e.entity_id % 6 = 0 THEN 1 ELSE 0 END AS refill_flag, u.next_code, u.next_at, u.next2_code, u.next2_at,
               CASE WHEN k.link_sent_at IS NOT NULL THEN CASE u.next_code {" ".join(f"WHEN {k} THEN '{v}'" for k, v in OUTCOMES.items())} END END AS upload_outcome,
               k.link_sent_at, CASE WHEN u.next_code = 2 THEN u.next_at END AS uploaded_at,
               CASE WHEN u.next_code = 2 THEN CASE WHEN u.next_at - k.link_sent_at <= INTERVAL 15 MINUTE THEN 'Within 15 mins'
                    WHEN u.next_at - k.link_sent_at <= INTERVAL 1 HOUR THEN '15mins-1hour' WHEN u.next_at - k.link_sent_at <= INTERVAL 2 HOUR THEN '1hour-2hours'
                    WHEN u.next_at - k.link_sent_at <= INTERVAL 3 HOUR THEN '2hours-3hours' WHEN u.next_at - k.link_sent_at > INTERVAL 3 HOUR THEN '>3hours' END END AS upload_bin,
               CASE WHEN u.next_code IN (2, 4) AND u.next2_code = 3 THEN l.reason END AS closing_reason,
               CASE WHEN u.next_code IN (2, 4) AND u.next2_code = 3 THEN CASE l.action {" ".join(f"WHEN {k} THEN '{v}'" for k, v in db.CLOSING.items())} END END AS closing_action,
               CASE WHEN e.entity_id % 3 = 1 THEN 'Old User' ELSE 'New User' END AS user_type,
               coalesce(c.items, 0) AS items, coalesce(c.items_delivered, 0) AS items_delivered,
               coalesce(c.chronic_items, 0) AS chronic_items, coalesce(c.chronic_delivered, 0) AS chronic_delivered
        FROM entity e LEFT JOIN upload u USING (entity_id) LEFT JOIN counts c USING (entity_id) LEFT JOIN links k USING (entity_id)
        LEFT JOIN cases p USING (entity_id) LEFT JOIN closings l USING (entity_id))"""


def _detail(t):
    i, code = F.col("entity_id"), F.col("last_code")
    text = lambda word, n: F.concat(F.lit(word), (i % n).cast("string"))
    role = lambda n: F.when(i % n % 2 == 0, "care").otherwise("desk")
    gone = code.isin(3, 5)
    orders = _entities(t).select(
        "entity_id", (i % 50).alias("customer_id"), (i * 100).alias("value"), "segment", "hub", "placed_at",
        F.coalesce(db.lookup({4: 9, 5: 8, 3: 2}, code), F.lit(1)).alias("status"), (i % 9).alias("placement"),
        text("agent ", 6).alias("agent"), role(2).alias("agent_role"), F.when(gone, text("cause ", 4)).alias("cancel_reason"),
        F.when(gone, text("agent ", 5)).alias("cancelled_by"), F.when(gone, role(5)).alias("cancelled_by_role"),
        (i % 4 == 0).alias("phone_customer"), (i % 7 != 0).alias("needs_rx"), (i % 2 == 1).alias("has_image"),
        (i % 6 == 0).alias("refill"), F.when(i % 3 == 1, "Old User").otherwise("New User").alias("user_type"))
    items = t.stage_item.withColumn("chronic", F.col("item_code") % 2 == 1)
    links = t.status_log.filter("code = 1 and entity_id % 5 < 3").select(
        "entity_id", F.timestamp_add("MINUTE", F.lit(-5), "made_at").alias("sent_at"))
    program = t.program.filter("entity_id % 3 = 0").select("entity_id", F.col("last_code").alias("latest_status"))
    closings = t.status_log.filter("code in (3, 5) and id % 2 = 0").select(
        "entity_id", "id", "made_at", (F.col("id") % 3 + 1).alias("action"),
        F.concat(F.lit("because "), (F.col("id") % 4).cast("string")).alias("reason"))
    return db.phone_order_detail(orders, t.status_log, items, links, program, closings, 1, OUTCOMES, [2, 4], 3)


@query("a63_phone_order_detail", f"WITH {_PHONE} SELECT * FROM detail")
def _(t):
    return _detail(t)


_DIMS = ["placed_on", "order_status", "delivery_place", "supplier_place", "payment_placed", "payment_delivered",
         "courier_flag", "chronic_flag", "user_type", "program_flag", "program_done_flag", "refill_flag",
         "placement_reason", "agent", "cancel_reason", "acquired_by_phone", "next_code", "order_type",
         "upload_outcome", "upload_bin"]


@query("a64_phone_order_summary", f"""
    WITH {_PHONE},
    more AS (SELECT *, 'paid ' || (entity_id % 3) AS payment_placed, 'paid ' || (entity_id % 2) AS payment_delivered,
                    entity_id % 4 = 1 AS courier_flag, entity_id % 5 = 0 AS chronic_flag FROM detail)
    SELECT {", ".join(_DIMS)}, count(entity_id) AS orders, count(customer_id) AS customers, sum(value)::BIGINT AS value,
           sum(items)::BIGINT AS items, sum(items_delivered)::BIGINT AS items_delivered, sum(chronic_items)::BIGINT AS chronic_items,
           sum(chronic_delivered)::BIGINT AS chronic_delivered, count(DISTINCT customer_id) AS distinct_customers
    FROM more WHERE placed_on < DATE '2024-01-30' GROUP BY ALL""")
def _(t):
    i = F.col("entity_id")
    paid = lambda n: F.concat(F.lit("paid "), (i % n).cast("string"))
    rows = _detail(t).withColumns({"payment_placed": paid(3), "payment_delivered": paid(2),
                                   "courier_flag": i % 4 == 1, "chronic_flag": i % 5 == 0})
    return db.phone_order_summary(rows, _DIMS, EVENTS_AS_OF)


def _registered(t):
    """A customer registers the day before the first order, at 23:30, when the balance is positive."""
    first = t.ord.groupBy("customer_id").agg(F.min("placed_at").alias("p"))
    kept = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"))
    return first.join(kept, "customer_id", "left_semi").select(
        "customer_id", F.timestamp_add("MINUTE", F.lit(-30), "p").alias("registered_at"))


_TREND = """
    reg AS (SELECT customer_id, min(placed_at) - INTERVAL 30 MINUTE AS registered_at FROM ord
            WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1),
    regs AS (SELECT * FROM reg WHERE registered_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2001-07-31'),
    phone AS (SELECT *, placed_at::DATE AS day FROM ord WHERE channel = '1-URGENT' AND placed_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2001-07-31'),
    first_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_id) AS r FROM ord) WHERE r = 1 AND channel = '1-URGENT'),
    trend AS (
        SELECT 'Placed' AS category, day, count(*) AS n FROM phone GROUP BY 1, 2
        UNION SELECT CASE status WHEN 2 THEN 'Rejected' ELSE 'Cancelled' END, day, count(*) FROM phone WHERE status IN (2, 8) GROUP BY 1, 2
        UNION SELECT 'Delivered', day, count(*) FROM phone WHERE status IN (9, 10) GROUP BY 1, 2
        UNION SELECT 'Registered', registered_at::DATE, count(*) FROM regs GROUP BY 1, 2
        UNION SELECT 'Registered and Placed', registered_at::DATE, count(f.customer_id) FROM regs LEFT JOIN first_one f USING (customer_id) GROUP BY 1, 2
        UNION SELECT 'Registered and Placed At Once', registered_at::DATE,
              count(CASE WHEN date_diff('minute', registered_at, f.placed_at) <= 60 THEN 1 END) FROM regs LEFT JOIN first_one f USING (customer_id) GROUP BY 1, 2)"""


def _trend(t):
    return db.stage_trend(t.ord, _registered(t), PHONE, "1996-01-01", ORDERS_AS_OF)


@query("a65_stage_trend", f"WITH {_TREND} SELECT * FROM trend")
def _(t):
    return _trend(t)


_WIDE = ", ".join(f"sum(CASE WHEN category = '{k}' THEN n END)::BIGINT AS {v}" for k, v in db.TREND.items())


@query("a66_stage_trend_pivot",
       f"WITH {_TREND} SELECT year(day) AS year, month(day) AS month, {_WIDE} FROM trend GROUP BY 1, 2")
def _(t):
    return db.stage_trend_pivot(_trend(t))


@query("a67_geo_channel_counts", """
    SELECT placed_at::DATE AS placed_on, g.city_id, g.city, g.hub, count(*) FILTER (channel = '1-URGENT') AS phone_placed,
           count(*) FILTER (channel <> '1-URGENT') AS web_placed, count(*) FILTER (channel = '1-URGENT' AND status IN (9, 10)) AS phone_done,
           count(*) FILTER (channel <> '1-URGENT' AND status IN (9, 10)) AS web_done
    FROM ord o LEFT JOIN geo g USING (customer_id)
    WHERE placed_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2001-07-31'
      AND customer_id NOT IN (SELECT customer_id FROM ord WHERE channel = '5-LOW') GROUP BY 1, 2, 3, 4""")
def _(t):
    return db.geo_channel_counts(t.ord, t.geo, PHONE, PARTNER, "1996-01-01", ORDERS_AS_OF)
