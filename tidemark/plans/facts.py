"""Task fact, consultation fact, changed keys, turnaround and upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import facts, refresh
from tidemark.operators.queries import check_unique
from tidemark.plans.registry import query
from tidemark.session import checkpointed
from tidemark.plans.views import EVENTS_AS_OF
from tidemark.sources import sinks


@query("a74_task_fact", "SELECT * FROM fact")
def _(t):
    return t.fact


ENTITY_RANGE = 16  # cases in one range of a written log or fact, at least
REFRESHED_ON = "2024-01-25"


@query("a74_task_fact_refresh", "SELECT * FROM fact")
def _(t):
    """The fact of an earlier log, brought up to date after the rows of the last days have come in."""
    by, day = refresh.key_ranges(t.task_log, "case_id", ENTITY_RANGE), F.to_date("made_at")
    log_path, fact_path = (sinks.fresh_path(t.spark, n) for n in ("task-log", "task-fact"))
    since = F.lit(REFRESHED_ON).cast("date")
    sinks.create_partitioned(t.task_log.filter(day < since), log_path, by)
    sinks.create_partitioned(t.fact_of(t.spark.read.parquet(log_path).drop(sinks.PART)), fact_path, by)
    new = t.task_log.filter(day >= since)
    refresh.append_log(new, log_path, by)
    changed = checkpointed(new.select("case_id").distinct())
    refresh.refresh(t.spark, log_path, fact_path, changed, "case_id", by, t.fact_of)
    return t.spark.read.parquet(fact_path).drop(sinks.PART)


@query("a75_changed_tasks", """
    SELECT task_id FROM task_log GROUP BY 1 HAVING min(made_at::DATE) >= DATE '2024-01-15'""")
def _(t):
    return facts.changed_tasks(t.task_log, "2024-01-15")


@query("a76_check_unique", """
    SELECT count(task_id) AS rows_counted, count(DISTINCT task_id) AS distinct_keys FROM fact""")
def _(t):
    return check_unique(t.fact, "task_id")


# fixed values: sources of a case, and the reasons that are the customer's
SOURCES = {1: "Offline Panel", 2: "Order Without Prescription", 3: "Help Me", 4: "Centralize Calling",
           5: "Consumer App Doctor Push", 6: "Order Without Prescription (Consumer App)", 7: "Tech Bot",
           8: "Subscription", 9: "Order On Call", 10: "Order Rejected"}
CUSTOMER_REASONS = ["Order Cancelled by user", "Order Cancelled By Moderator", "Customer not receiving call"]
PARTNERS = [1, 2]
_REASONS = ["Order Cancelled by user", "Unclear image", "Order Cancelled By Moderator", "Dose not given"]

_CASES = """
    cases AS (
        SELECT entity_id, entity_id % 50 AS customer_id, min(made_at) AS placed_at,
               max(made_at) AS updated_at, arg_max(code, id) AS last_code,
               CASE WHEN entity_id % 7 <> 6 THEN entity_id % 7 END AS staff, entity_id % 12 AS source,
               entity_id % 3 AS kind, min(made_at) + INTERVAL 10 MINUTE AS requested_at
        FROM status_log GROUP BY 1)"""
_STAFF = f"""
    rejections AS (SELECT entity_id, max_by(reason, (made_at, reason)) AS rejection_reason FROM (
        SELECT entity_id, made_at, ({_REASONS!r})[(id % 4 + 1)::INT] AS reason FROM status_log WHERE code = 3) GROUP BY 1),
    refusals AS (SELECT entity_id, max_by(reason, (made_at, reason)) AS refuse_reason FROM (
        SELECT entity_id, made_at, 'refused ' || (id % 5) AS reason FROM status_log WHERE code = 1 AND id % 4 = 0) GROUP BY 1)"""
_CHANGED = """
    changed AS (
        SELECT DISTINCT c.entity_id FROM cases c
        LEFT JOIN (SELECT DISTINCT entity_id FROM status_log WHERE code = 4 AND made_at < DATE '2024-01-05') f
          ON c.entity_id = f.entity_id
        WHERE c.updated_at::DATE >= DATE '2024-01-30' - 3 OR f.entity_id IS NULL)"""


def _cases(t):
    return t.status_log.groupBy("entity_id").agg(
        F.min("made_at").alias("placed_at"), F.max("made_at").alias("updated_at"),
        F.max_by("code", "id").alias("last_code")).withColumns({
            "customer_id": F.col("entity_id") % 50, "kind": F.col("entity_id") % 3,
            "staff": F.when(F.col("entity_id") % 7 != 6, F.col("entity_id") % 7),
            "source": F.col("entity_id") % 12, "requested_at": F.timestamp_add("MINUTE", F.lit(10), "placed_at")})


def staff(t):
    return t.spark.range(6).select(F.col("id").alias("staff"), F.concat(F.lit("Dr "), "id").alias("staff_name"))


def _rejections(t):
    names = F.array(*map(F.lit, _REASONS))
    return t.status_log.filter("code = 3").select(
        "entity_id", "made_at", F.element_at(names, (F.col("id") % 4 + 1).cast("int")).alias("reason"))


def _refusals(t):
    return t.status_log.filter("code = 1 and id % 4 = 0").select(
        "entity_id", "made_at", F.concat(F.lit("refused "), (F.col("id") % 5).cast("string")).alias("reason"))


def _changed(t):
    known = t.status_log.filter((F.col("code") == 4)
                                & (F.to_date("made_at") < F.lit("2024-01-05").cast("date")))
    return facts.changed_orders(_cases(t), known, EVENTS_AS_OF)


@query("a77_changed_orders", f"WITH {_CASES}, {_CHANGED} SELECT * FROM changed")
def _(t):
    return _changed(t)


def office_sql(start, end):
    """The office-hours rule as SQL, in seconds, for 08:30 to 23:00."""
    day = f"date_diff('day', {start}::DATE, {end}::DATE)"
    tail = (f"(date_diff('second', {end}::DATE + INTERVAL '08:30:00' HOUR TO SECOND, {end})"
            f" + ({day} - 1) * 52200)")
    clock = f"strftime({start}, '%H:%M:%S')"
    return f"""CASE WHEN {day} = 0 THEN
            CASE WHEN {clock} < '08:30:00'
                 THEN date_diff('second', {end}::DATE + INTERVAL '08:30:00' HOUR TO SECOND, {end})
                 ELSE date_diff('second', {start}, {end}) END
        WHEN {clock} <= '08:30:00' THEN 52200 + {tail}
        WHEN {clock} < '23:00:00' THEN
             date_diff('second', {start}, {start}::DATE + INTERVAL '23:00:00' HOUR TO SECOND) + {tail}
        ELSE {tail} END""".replace("INTERVAL '08:30:00' HOUR TO SECOND", "INTERVAL 30600 SECOND").replace(
        "INTERVAL '23:00:00' HOUR TO SECOND", "INTERVAL 82800 SECOND")


@query("a78_office_minutes", f"""
    SELECT id, made_at, next_at, ({office_sql('made_at', 'next_at')})::BIGINT AS office_seconds,
           ({office_sql('made_at', 'next_at')}) / 60 AS office_minutes
    FROM step WHERE next_at IS NOT NULL""")
def _(t):
    return facts.turnaround(t.status_log)


def _consultation_sql(changed):
    return f"""
    WITH {_CASES}, {changed}, {_STAFF},
    acts AS (
        SELECT entity_id, min(made_at) FILTER (code IN (1, 2)) AS first_moved_at,
               min(made_at) FILTER (code = 2) AS first_assigned_at, max(made_at) FILTER (code = 2) AS last_assigned_at,
               min(made_at) FILTER (code IN (3, 4, 5)) AS resp, max(made_at) FILTER (code IN (3, 4, 5)) AS last_any_response_at,
               min(made_at) FILTER (code = 4) AS first_done_at, max(made_at) FILTER (code = 4) AS last_done_at,
               max(made_at) FILTER (code = 3) AS rejected_at, count(*) FILTER (code = 5) AS holds,
               count(*) FILTER (code IN (3, 4, 5)) AS attempts
        FROM status_log GROUP BY 1),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS a,
               row_number() OVER (PARTITION BY entity_id ORDER BY id DESC) AS d
        FROM status_log WHERE code IN (3, 4, 5)),
    ends AS (
        SELECT entity_id, min(CASE WHEN a = 1 THEN code END) AS first_response,
               min(CASE WHEN d = 1 THEN code END) AS last_response,
               min(CASE WHEN d = 1 THEN made_at END) AS last_response_at FROM ordered GROUP BY 1),
    coarse AS (
        SELECT entity_id, code, made_at, lead(code) OVER (PARTITION BY entity_id ORDER BY id) AS next_code,
               lead(made_at) OVER (PARTITION BY entity_id ORDER BY id) AS next_at,
               row_number() OVER (PARTITION BY entity_id, code = 1 ORDER BY id) AS n,
               row_number() OVER (PARTITION BY entity_id, code = 1 ORDER BY id DESC) AS nd
        FROM status_log WHERE code IN (1, 3, 4)),
    visits AS (SELECT entity_id, count(*) AS instances, max(made_at) FILTER (nd = 1) AS last_moved_at
               FROM coarse WHERE code = 1 GROUP BY 1),
    won AS (SELECT customer_id, min(entity_id) AS won FROM cases WHERE last_code = 4 GROUP BY 1),
    wide AS (
        SELECT c.entity_id, c.customer_id, c.placed_at, c.staff, c.source, c.kind, c.requested_at, c.last_code,
               r.rejection_reason, f.refuse_reason, a.* EXCLUDE (entity_id), e.* EXCLUDE (entity_id),
               v.instances, v.last_moved_at, w.won,
               coalesce(k.next_code = 3 AND (date_diff('second', a.resp, k.next_at) < 40 OR a.resp IS NULL), false) AS canned
        FROM changed JOIN cases c USING (entity_id) JOIN acts a USING (entity_id) LEFT JOIN ends e USING (entity_id)
        JOIN visits v USING (entity_id) LEFT JOIN coarse k ON k.entity_id = c.entity_id AND k.code = 1 AND k.n = 1
        LEFT JOIN won w ON w.customer_id = c.customer_id LEFT JOIN rejections r ON r.entity_id = c.entity_id
        LEFT JOIN refusals f ON f.entity_id = c.entity_id),
    timed AS (
        SELECT *, ({office_sql('first_moved_at', 'resp')}) / 60 AS frt,
               ({office_sql('first_moved_at', 'first_done_at')}) / 60 AS fdo,
               ({office_sql('first_moved_at', 'last_done_at')}) / 60 AS ldo FROM wide)
    SELECT entity_id, customer_id, placed_at, 'Dr ' || staff AS staff_name,
           CASE WHEN staff IN (1, 2) THEN 'Third_Party' WHEN staff IS NULL THEN 'Not Applicable' ELSE 'House' END AS staff_category,
           CASE source {" ".join(f"WHEN {k} THEN '{v}'" for k, v in SOURCES.items())} END AS order_source, requested_at,
           last_code AS latest_status, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS issue_flag, refuse_reason, rejection_reason,
           CASE WHEN rejection_reason IN ({", ".join(f"'{r}'" for r in CUSTOMER_REASONS)}) THEN 'customer/other'
                WHEN rejection_reason IS NOT NULL THEN 'staff' END AS rejected_by,
           CASE WHEN entity_id > won THEN 'Repeat' ELSE 'First Time' END AS consultation_type,
           CASE WHEN canned THEN 1 END AS cancelled_before_response, instances, attempts, holds,
           first_moved_at, first_assigned_at, first_response,
           CASE WHEN NOT canned THEN resp END AS first_response_at, last_response, last_response_at,
           first_done_at, last_moved_at, last_assigned_at, last_done_at, last_any_response_at, rejected_at,
           CASE WHEN NOT canned THEN date_diff('second', first_moved_at, resp) / 60 END AS response_minutes,
           CASE WHEN NOT canned THEN frt END AS response_office_minutes,
           date_diff('second', first_moved_at, first_done_at) / 60 AS first_done_minutes,
           CASE WHEN first_done_at IS NOT NULL THEN fdo END AS first_done_office_minutes,
           date_diff('second', first_moved_at, last_done_at) / 60 AS last_done_minutes,
           CASE WHEN last_done_at IS NOT NULL THEN ldo END AS last_done_office_minutes,
           CASE WHEN frt > 90 THEN 1 ELSE 0 END AS internal_breach,
           CASE WHEN frt > 120 THEN 1 ELSE 0 END AS committed_breach,
           CASE WHEN first_done_at IS NOT NULL THEN CASE WHEN fdo > 120 THEN 1 ELSE 0 END END AS overall_breach
    FROM timed"""


def _consultations(log, changed, t):
    """The consultation fact of the changed entities from a status log that holds their customers' entities."""
    rows = Logged(t.spark, log)
    return facts.consultation_fact(
        changed, _cases(rows), log, log.filter("code in (1, 3, 4)"), staff(t),
        _rejections(rows), _refusals(rows), stage=1, cancelled=3, moved=[1, 2], assigned=2, responses=[3, 4, 5],
        done=4, rejected=3, held=5, sources=SOURCES, partners=PARTNERS, customer_reasons=CUSTOMER_REASONS)


class Logged:
    """A status log in the place of the bound one."""

    def __init__(self, spark, log):
        self.spark, self.status_log = spark, log


@query("a79_consultation_fact", _consultation_sql(_CHANGED))
def _(t):
    return _consultations(t.status_log, _changed(t), t)


@query("a79_consultation_fact_refresh", _consultation_sql("changed AS (SELECT entity_id FROM cases)"))
def _(t):
    """The fact of all cases of an earlier log, brought up to date: cases with new rows, and those of their customers,
    whose first success may be another now."""
    by, day = refresh.key_ranges(t.status_log, "entity_id", ENTITY_RANGE), F.to_date("made_at")
    log_path, fact_path = (sinks.fresh_path(t.spark, n) for n in ("status-log", "consultations"))
    since = F.lit(REFRESHED_ON).cast("date")
    sinks.create_partitioned(t.status_log.filter(day < since), log_path, by)
    old = t.spark.read.parquet(log_path).drop(sinks.PART)
    sinks.create_partitioned(_consultations(old, old.select("entity_id").distinct(), t), fact_path, by)
    new = t.status_log.filter(day >= since)
    refresh.append_log(new, log_path, by)
    members = t.spark.read.parquet(log_path).select("entity_id").distinct().withColumn("customer_id", F.col("entity_id") % 50)
    changed = checkpointed(refresh.touched_groups(new.select("entity_id"), members, "entity_id", "customer_id"))
    refresh.refresh(t.spark, log_path, fact_path, changed, "entity_id", by,
                    lambda log: _consultations(log, changed, t))
    return t.spark.read.parquet(fact_path).drop(sinks.PART)


@query("a80_upsert", """
    WITH old AS (SELECT entity_id, count(*) AS steps, max(made_at) AS last_at FROM status_log
                 WHERE made_at::DATE < DATE '2024-01-28' GROUP BY 1),
    batch AS (SELECT entity_id, count(*) AS steps, max(made_at) AS last_at FROM status_log
              GROUP BY 1 HAVING max(made_at::DATE) >= DATE '2024-01-28')
    SELECT * FROM old WHERE entity_id NOT IN (SELECT entity_id FROM batch) UNION ALL SELECT * FROM batch""")
def _(t):
    log, cut = t.status_log, F.lit("2024-01-28").cast("date")
    grown = lambda df: df.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("steps"), F.max("made_at").alias("last_at"))
    path, by = sinks.fresh_path(t.spark, "fact"), refresh.key_ranges(log, "entity_id", ENTITY_RANGE)
    sinks.create_partitioned(grown(log.filter(F.to_date("made_at") < cut)), path, by)
    batch = grown(log).filter(F.to_date("last_at") >= cut)
    sinks.upsert_partitions(t.spark, path, batch, "entity_id", by)
    return t.spark.read.parquet(path).drop(sinks.PART)
