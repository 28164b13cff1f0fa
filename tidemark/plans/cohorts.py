"""Retention, interaction and channel-migration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import channels, cohorts
from tidemark.plans.registry import query
from tidemark.plans.views import PARTNER, PHONE, WEB

_AGES = ",\n".join(f"count(DISTINCT CASE WHEN m = first_m + {k} THEN customer_id END) AS m_{k}"
                   for k in range(1, 13))


@query("a16_retention_cohorts", f"""
    WITH visit AS (SELECT customer_id, year(placed_at) * 12 + month(placed_at) AS m FROM ord),
    born AS (SELECT customer_id, min(m) AS first_m FROM visit GROUP BY 1)
    SELECT first_m AS acquisition_month, count(DISTINCT customer_id) AS customers_acquired, {_AGES}
    FROM visit JOIN born USING (customer_id) GROUP BY 1""")
def _(t):
    return cohorts.retention_cohorts(t.ord)


_CALL_ID = """
    CASE WHEN NOT regexp_matches(comment, '\\D') THEN TRY_CAST(comment AS BIGINT)
         WHEN comment LIKE '%#%' THEN TRY_CAST(regexp_extract(comment, '#(.{1,7})', 1) AS BIGINT)
         WHEN lower(comment) LIKE 'm%' THEN TRY_CAST(substr(replace(comment, ' ', ''), 2, 7) AS BIGINT)
    END"""

_FIRST_CALL = f"""
    about AS (SELECT call_id, made_at AS call_at, {_CALL_ID} AS order_id FROM comment_log),
    first_call AS (
        SELECT * FROM (
            SELECT o.customer_id, a.call_at, o.placed_at,
                   row_number() OVER (PARTITION BY o.customer_id ORDER BY a.call_at, a.call_id) AS k
            FROM about a JOIN ord o ON a.order_id = o.order_id) WHERE k = 1)"""


def _interaction_sql(test):
    flags = ",".join(f"count(DISTINCT CASE WHEN {test.format(k=k)} THEN f.customer_id END) AS month{k}"
                     for k in (1, 2, 3))
    return f"""
    WITH {_FIRST_CALL}
    SELECT month(f.call_at) AS month_of_interaction, count(DISTINCT f.customer_id) AS month0, {flags}
    FROM first_call f JOIN ord o ON f.customer_id = o.customer_id GROUP BY 1"""


@query("a04_interaction_cohort_month_number",
       _interaction_sql("month(o.placed_at) = month(f.placed_at) + {k}"))
def _(t):
    return cohorts.interaction_cohort(t.comment_log, t.ord, mode="month_number")


@query("a05_interaction_cohort_month_range", _interaction_sql(
    "o.placed_at::DATE BETWEEN date_trunc('month', f.call_at) + INTERVAL {k} MONTH "
    "AND last_day((date_trunc('month', f.call_at) + INTERVAL {k} MONTH)::DATE)"))
def _(t):
    return cohorts.interaction_cohort(t.comment_log, t.ord, mode="month_range")


@query("a06_extract_order_id", f"SELECT call_id, caller, comment, {_CALL_ID} AS order_id FROM comment_log")
def _(t):
    return cohorts.extract_order_id(t.comment_log).select("call_id", "caller", "comment", "order_id")


def _eligible(t):
    return t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"))


@query("a09_order_gap", """
    WITH kept AS (
        SELECT * FROM ord WHERE status IN (9, 10) AND channel IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
        AND customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)),
    both_ways AS (
        SELECT customer_id FROM kept WHERE channel = '1-URGENT' INTERSECT
        SELECT customer_id FROM kept WHERE channel <> '1-URGENT'),
    gaps AS (
        SELECT customer_id, date_diff('hour', placed_at,
               lead(placed_at) OVER (PARTITION BY customer_id ORDER BY placed_at, order_id)) AS gap
        FROM kept WHERE customer_id IN (SELECT customer_id FROM both_ways))
    SELECT customer_id, avg(gap) AS order_frequency_in_hours FROM gaps GROUP BY 1""")
def _(t):
    return channels.order_gap(t.ord, PHONE, WEB, _eligible(t))


_EIGHT = ",\n".join(
    f"max(CASE WHEN k = {i + 1} THEN bucket END) AS {w}_order_source"
    for i, w in enumerate(channels.ORDINALS))


@query("a10_channel_sequence", f"""
    WITH kept AS (
        SELECT *, CASE WHEN channel = '1-URGENT' THEN 'PHONE' ELSE 'WEB' END AS bucket,
               row_number() OVER (PARTITION BY customer_id ORDER BY placed_at, order_id) AS k
        FROM ord WHERE status IN (9, 10)
        AND customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
    SELECT customer_id, count(DISTINCT order_id) AS total_orders,
           count(DISTINCT CASE WHEN bucket = 'PHONE' THEN order_id END) AS phone_orders,
           count(DISTINCT CASE WHEN bucket = 'WEB' THEN order_id END) AS web_orders, {_EIGHT}
    FROM kept
    WHERE customer_id IN (SELECT customer_id FROM kept WHERE channel = '1-URGENT')
      AND customer_id IN (SELECT customer_id FROM kept WHERE channel IN ('2-HIGH', '3-MEDIUM'))
      AND customer_id NOT IN (SELECT customer_id FROM kept WHERE channel = '5-LOW')
    GROUP BY 1""")
def _(t):
    return channels.channel_sequence(t.ord, PHONE, WEB, PARTNER, eligible=_eligible(t))


def _journey_sql(p, no, phone_no):
    six = channels.ORDINALS[:6]
    return ",\n".join(
        [f"max(CASE WHEN {phone_no} = 1 THEN 1 ELSE 0 END) AS {p}used_phone",
         f"min(CASE WHEN {no} = 1 THEN placed_at END) AS {p}first_at",
         f"min(CASE WHEN {no}_last = 1 THEN placed_at END) AS {p}last_at",
         f"min(CASE WHEN {phone_no} = 1 THEN {no} END) AS {p}number_of_first_phone",
         f"min(CASE WHEN {phone_no} = 1 THEN placed_at END) AS {p}phone_first_at"]
        + [f"min(CASE WHEN {no} = {i + 1} THEN bucket END) AS {p}{w}_source"
           for i, w in enumerate(six)]
        + [f"min(CASE WHEN {phone_no} = {i + 1} THEN bucket END) AS {p}phone_{w}_source"
           for i, w in enumerate(six)])


def _migration_sql(basis, having):
    since = "phone_done_at" if basis == "both" else "phone_at"
    parts = []
    if basis != "fulfilled":
        parts.append(_journey_sql("placed_", "placed_no", "placed_phone_no"))
    if basis != "placed":
        parts.append(_journey_sql("done_", "done_no", "done_phone_no"))
    return f"""
    WITH firsts AS (
        SELECT customer_id, min(placed_at) AS phone_at,
               min(CASE WHEN status IN (9, 10) THEN placed_at END) AS phone_done_at
        FROM ord WHERE channel = '1-URGENT' GROUP BY 1),
    base AS (
        SELECT o.*, g.segment = 'HOUSEHOLD' AS acquired, o.status IN (9, 10) AS done,
               coalesce(o.placed_at >= f.phone_at, false) AS after_phone,
               coalesce(o.status IN (9, 10) AND o.placed_at >= f.{since}, false) AS done_after,
               CASE WHEN channel = '1-URGENT' THEN 'PHONE' ELSE 'WEB' END AS bucket
        FROM ord o JOIN geo g USING (customer_id) LEFT JOIN firsts f USING (customer_id)
        WHERE o.customer_id NOT IN (SELECT customer_id FROM ord WHERE channel = '5-LOW')),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_id) AS placed_no,
            row_number() OVER (PARTITION BY customer_id ORDER BY order_id DESC) AS placed_no_last,
            CASE WHEN after_phone THEN row_number() OVER (PARTITION BY customer_id, after_phone ORDER BY order_id) END AS placed_phone_no,
            CASE WHEN done THEN row_number() OVER (PARTITION BY customer_id, done ORDER BY order_id) END AS done_no,
            CASE WHEN done THEN row_number() OVER (PARTITION BY customer_id, done ORDER BY order_id DESC) END AS done_no_last,
            CASE WHEN done_after THEN row_number() OVER (PARTITION BY customer_id, done_after ORDER BY order_id) END AS done_phone_no
        FROM base)
    SELECT customer_id, acquired, count(*) AS orders_placed,
           count(CASE WHEN done THEN 1 END) AS orders_fulfilled,
           count(CASE WHEN bucket = 'PHONE' THEN 1 END) AS phone_orders,
           count(CASE WHEN bucket = 'PHONE' AND done THEN 1 END) AS phone_orders_fulfilled,
           {", ".join(parts)}
    FROM numbered GROUP BY 1, 2 HAVING {having}"""


def _members(t):
    return t.geo.select("customer_id", (F.col("segment") == "HOUSEHOLD").alias("acquired"))


@query("a68_channel_migration_placed", _migration_sql("placed", "count(*) > 5"))
def _(t):
    return channels.channel_migration(t.ord, _members(t), PHONE, PARTNER, "placed", 6)


@query("a69_channel_migration_fulfilled",
       _migration_sql("fulfilled", "count(CASE WHEN done THEN 1 END) >= 5"))
def _(t):
    return channels.channel_migration(t.ord, _members(t), PHONE, PARTNER, "fulfilled", 5)


@query("a70_channel_migration_both",
       _migration_sql("both", "count(CASE WHEN bucket = 'PHONE' THEN 1 END) > 0"))
def _(t):
    return channels.channel_migration(t.ord, _members(t), PHONE, PARTNER, "both")
