"""Stage visits, dwell times, re-entries and function health over the event history.

Code 3 plays the stage under audit, 4 the confirmation, 5 the cancellation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cohorts, lifecycle as lc
from tidemark.operators.queries import count_between, filtered, rows_since
from tidemark.plans.registry import query
from tidemark.plans.views import EVENTS_AS_OF, Bound
from tidemark.session import checkpointed
from tidemark.sources import functions as fn, sinks

STAGE, CONFIRMED, CANCELLED = 3, 4, 5
FINAL = {4: "Fulfilled", 5: "Cancelled", 3: "Rejected"}
LATEST = {4: "fulfilled", 5: "cancelled", 3: "rejected"}
GROUPS = {1: "intake", 2: "consult", 3: "care", 4: "store"}
NAMES = {1: "signup", 2: "view", 3: "error", 4: "purchase", 5: "click"}
MARKS = {"sent_at": "Sent out", "removed_at": "Deleted", "coded_at": "Code added"}
PROBS = {"p05": .05, "p10": .1, "p15": .15, "p20": .2, "p25": .25, "p30": .3, "median": .5}

_VISIT = """
    visit AS (
        SELECT entity_id, made_at AS in_at, prev_code, next_code, next_at AS out_at, next2_at
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS n
              FROM step WHERE code = 3) WHERE n = 1)"""

_FLOW = """CASE WHEN item_code IS NOT NULL AND NOT printed THEN '{}'
    WHEN item_code IS NOT NULL AND printed THEN '{}' WHEN deleted THEN '{}' END"""


@query("a40_verification_items", f"""
    WITH {_VISIT},
    ok AS (SELECT entity_id, min(made_at) AS first_accepted_at FROM status_log WHERE code = 4 GROUP BY 1)
    SELECT c.item_row, c.entity_id, c.item_code, c.created_at, ok.first_accepted_at, v.in_at, v.out_at,
           {_FLOW.format('TeamMapped', 'FieldMapped', 'Deleted')} AS flow,
           date_diff('second', v.in_at, v.out_at) AS in_stage_seconds
    FROM custom_item c JOIN visit v USING (entity_id) LEFT JOIN ok USING (entity_id)
    WHERE ok.first_accepted_at IS NULL OR c.created_at < ok.first_accepted_at""")
def _(t):
    return lc.verification_items(t.status_log, t.custom_item, STAGE, CONFIRMED)


@query("a41_count_between", """
    SELECT count(*) AS n FROM custom_item
    WHERE created_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def _(t):
    return count_between(t.custom_item, "created_at", "2024-01-05", "2024-01-20")


_DWELL = """dwell AS (
    SELECT entity_id, sum(date_diff('second', made_at, next_at))::BIGINT AS in_stage_seconds,
           count(*) AS visits FROM step WHERE code = 3 GROUP BY 1)"""


@query("a42_stage_dwell", f"WITH {_DWELL} SELECT * FROM dwell")
def _(t):
    return lc.stage_dwell(t.status_log, STAGE)


@query("p05_operators_in_text", f"""
    WITH {_DWELL}, kept AS (SELECT * FROM dwell WHERE visits >= 3),
    born AS (SELECT customer_id, min(year(placed_at) * 12 + month(placed_at)) AS m FROM ord GROUP BY 1)
    SELECT 'visits ' || visits AS label, count(*) AS n, sum(in_stage_seconds)::BIGINT AS total FROM kept GROUP BY 1
    UNION ALL SELECT 'month ' || m, count(*), m::BIGINT FROM born WHERE m BETWEEN 1995 * 12 + 3 AND 1995 * 12 + 8 GROUP BY m""")
def _(t):
    """Two operators called from one stored text, with a session variable between them."""
    fn.publish(lc.stage_dwell(t.status_log, STAGE), "stage_dwell", {"least": "BIGINT"}, "visits >= least")
    fn.publish(cohorts.retention_cohorts(t.ord), "retention", {"since": "BIGINT", "until": "BIGINT"},
               "acquisition_month BETWEEN since AND until")
    fn.set_variable(t.spark, "least_visits", "BIGINT", 3)
    return t.spark.sql("""
        SELECT concat('visits ', visits) AS label, count(*) AS n, sum(in_stage_seconds) AS total
        FROM stage_dwell(least_visits) GROUP BY visits
        UNION ALL SELECT concat('month ', acquisition_month), customers_acquired, acquisition_month
        FROM retention(1995 * 12 + 3, 1995 * 12 + 8)""")


_NOTED = ",\n".join(
    f"CASE WHEN position('{m}' IN remark) > 14 THEN TRY_CAST('2024-' || "
    f"substr(remark, position('{m}' IN remark)::BIGINT - 14, 11) || ':00' AS TIMESTAMP) END AS {n}"
    for n, m in MARKS.items())
_DETAIL = f"""
    met AS (
        SELECT * FROM (
            SELECT c.*, s.made_at AS in_at, s.next_at AS out_at, s.remark,
                   rank() OVER (PARTITION BY c.item_row ORDER BY s.id) AS r
            FROM custom_item c JOIN step s ON c.entity_id = s.entity_id AND s.code = 3
             AND c.created_at < s.made_at) WHERE r = 1),
    detail AS (
        SELECT item_row, entity_id, item_code, created_at, updated_at, in_at, out_at, printed, deleted,
               CASE WHEN deleted THEN CASE WHEN item_row % 4 = 0 THEN 'Custom Medicine Deleted' ELSE 'reason ' || (item_row % 4) END END AS delete_reason,
               CASE WHEN deleted THEN created_at + INTERVAL 3 HOUR END AS deleted_at,
               CASE WHEN deleted AND item_row % 5 < 4 THEN 'agent ' || (item_row % 5) END AS deleted_by,
               CASE WHEN deleted AND item_row % 5 < 4 THEN CASE WHEN item_row % 5 % 2 = 0 THEN 'care' ELSE 'desk' END END AS deleted_by_role,
               CASE WHEN created_at::DATE <= listed_at::DATE THEN 'aNewly Mapped'
                    WHEN created_at::DATE > listed_at::DATE THEN 'bAlready Mapped'
                    ELSE 'cDeleted' END AS mapping,
               {_FLOW.format('cTeamMapped', 'aFieldMapped', 'bDeleted')} AS flow,
               date_diff('second', in_at, out_at) AS in_stage_seconds, {_NOTED}
        FROM met LEFT JOIN code_catalog USING (item_code))"""


def _detail(t: Bound):
    i = F.col("item_row")
    gone = t.custom_item.filter("deleted").select(
        "item_row", F.when(i % 4 == 0, "Custom Medicine Deleted").otherwise(
            F.concat(F.lit("reason "), (i % 4).cast("string"))).alias("delete_reason"),
        F.timestamp_add("HOUR", F.lit(3), "created_at").alias("deleted_at"), (i % 5).alias("person"))
    people = t.spark.range(4).select(
        F.col("id").alias("person"), F.concat(F.lit("agent "), F.col("id").cast("string")).alias("deleted_by"),
        F.when(F.col("id") % 2 == 0, "care").otherwise("desk").alias("deleted_by_role"))
    return lc.stage_item_detail(t.stage_log, t.custom_item, t.code_catalog, gone, people, STAGE, 2024, MARKS)


@query("a43_stage_item_detail", f"WITH {_DETAIL} SELECT * FROM detail")
def _(t):
    return _detail(t)


@query("a44_rows_since",
       "SELECT * FROM code_catalog WHERE listed_at >= TIMESTAMP '2024-01-01 12:00:00'")
def _(t):
    return rows_since(t.code_catalog.withColumnRenamed("created_at", "listed_at"), "listed_at",
                      "2024-01-01 12:00:00")


_STATUS = """
    final AS (
        SELECT entity_id, arg_max(code, id) AS last_code, arg_max(owner, id) AS last_owner,
               max(made_at) AS last_at, min(made_at) AS placed_at FROM status_log GROUP BY 1),
    labelled AS (
        SELECT *, CASE last_code WHEN 4 THEN 'Fulfilled' WHEN 5 THEN 'Cancelled'
                  WHEN 3 THEN 'Rejected' ELSE 'Under Process' END AS order_status FROM final)"""


def _status(t):
    return lc.latest_status(t.status_log, FINAL, "Under Process")


@query("a45_stage_order_summary", f"""
    WITH {_DETAIL}, {_DWELL}, {_STATUS}
    SELECT entity_id, l.placed_at, w.visits, l.order_status, count(d.item_code) AS custom_items,
           min(mapping) AS mapping, min(flow) AS flow, min(deleted::INT) AS all_deleted,
           w.in_stage_seconds / 60 AS in_stage_minutes, w.in_stage_seconds / 3600 AS in_stage_hours
    FROM detail d LEFT JOIN dwell w USING (entity_id) LEFT JOIN labelled l USING (entity_id)
    GROUP BY entity_id, l.placed_at, w.visits, l.order_status, w.in_stage_seconds""")
def _(t):
    return lc.stage_order_summary(_detail(t).drop("in_stage_seconds"),
                                  lc.stage_dwell(t.status_log, STAGE), _status(t))


_FINAL = f"""
    {_DETAIL}, {_DWELL}, {_STATUS},
    in_stage AS (SELECT DISTINCT entity_id FROM step WHERE code = 3 AND next_code = 5),
    total AS (SELECT entity_id, count(DISTINCT item_row) AS total_items FROM stage_item GROUP BY 1),
    marked AS (
        SELECT d.*, l.placed_at, l.order_status, l.last_code, l.last_owner, l.last_at,
               CASE WHEN printed THEN 'aField' ELSE 'bTeam' END AS path,
               CASE WHEN deleted THEN 'bDeleted' WHEN item_code IS NOT NULL THEN 'aMapped&Retained' END AS act,
               s.entity_id IS NOT NULL AS hit
        FROM detail d LEFT JOIN labelled l USING (entity_id) LEFT JOIN in_stage s USING (entity_id)),
    summary AS (
        SELECT m.entity_id, placed_at, order_status, count(DISTINCT m.item_row) AS custom_items,
               min(mapping) AS mapping, min(path) AS flow, min(act) AS action,
               min(CASE WHEN updated_at > last_at THEN 'aClosed' ELSE 'bLive' END) AS flow_status,
               min(CASE WHEN last_code = 5 AND hit THEN CASE WHEN printed THEN 'aInField' ELSE 'bInTeam' END
                        ELSE act END) AS in_stage_action,
               max(CASE WHEN deleted THEN 0 ELSE 1 END) AS retained,
               any_value(w.in_stage_seconds) AS in_stage_seconds, any_value(w.visits) AS visits,
               any_value(total_items) AS total_items,
               CASE WHEN order_status <> 'Under Process' THEN 'R' || last_owner END AS reason,
               any_value(w.in_stage_seconds) / 60 AS in_stage_minutes,
               any_value(w.in_stage_seconds) / 3600 AS in_stage_hours
        FROM marked m LEFT JOIN dwell w USING (entity_id) LEFT JOIN total USING (entity_id)
        GROUP BY m.entity_id, placed_at, order_status, last_owner)"""


def _final(t):
    return lc.stage_order_final(_detail(t), t.status_log, lc.stage_dwell(t.status_log, STAGE),
                                _status(t), t.stage_item, STAGE, CANCELLED)


@query("a46_stage_order_final", f"WITH {_FINAL} SELECT * FROM summary")
def _(t):
    return _final(t)


@query("a47_probe_filter", "SELECT * FROM stage_item WHERE deleted")
def _(t):
    return filtered(t.stage_item, F.col("deleted"))


@query("a48_cancelled_from_stage",
       "SELECT DISTINCT entity_id FROM step WHERE code = 3 AND next_code = 5")
def _(t):
    return lc.cancelled_from_stage(t.status_log, STAGE, CANCELLED)


_OUTCOME = {4: "won", 3: "closed", 5: "closed"}


@query("a49_repeat_new_items", f"""
    WITH {_DETAIL}, {_DWELL},
    fresh AS (SELECT entity_id, item_code, max(CASE WHEN deleted THEN 0 ELSE 1 END) AS retained
              FROM detail WHERE mapping = 'aNewly Mapped' AND item_code IS NOT NULL GROUP BY 1, 2),
    ends AS (SELECT entity_id, CASE last_code WHEN 4 THEN 'won' WHEN 3 THEN 'closed' WHEN 5 THEN 'closed' ELSE 'open' END AS outcome,
                    placed_at FROM program),
    bought AS (SELECT i.entity_id AS other, item_code, outcome, max(CASE WHEN deleted THEN 0 ELSE 1 END) AS kept
               FROM custom_item i LEFT JOIN ends e ON e.entity_id = i.entity_id WHERE item_code IS NOT NULL GROUP BY 1, 2, 3)
    SELECT f.entity_id, p.placed_at, count(DISTINCT f.item_code) AS new_items, max(retained) AS retained,
           count(DISTINCT other) AS times_ordered,
           count(DISTINCT CASE WHEN kept = 1 THEN other END) AS times_ordered_and_retained,
           count(CASE WHEN b.outcome = 'won' THEN 1 END) AS won_lines, count(CASE WHEN b.outcome = 'closed' THEN 1 END) AS closed_lines,
           count(CASE WHEN b.outcome = 'open' THEN 1 END) AS open_lines, w.in_stage_seconds, w.visits
    FROM fresh f LEFT JOIN bought b ON f.item_code = b.item_code AND b.other <> f.entity_id
    LEFT JOIN dwell w ON f.entity_id = w.entity_id LEFT JOIN ends p ON p.entity_id = f.entity_id
    GROUP BY f.entity_id, p.placed_at, w.in_stage_seconds, w.visits""")
def _(t):
    code = F.create_map(*[F.lit(x) for pair in _OUTCOME.items() for x in pair])
    outcomes = t.program.select("entity_id", "placed_at", F.coalesce(code[F.col("last_code")], F.lit("open")).alias("outcome"))
    return lc.repeat_new_items(_detail(t).drop("in_stage_seconds"), t.custom_item, outcomes,
                               lc.stage_dwell(t.status_log, STAGE))


# interpolated hours are given to six places
_QUANTILES = ",\n".join(f"round(quantile_cont(in_stage_seconds, {p}) / 3600, 6) AS {n}"
                        for n, p in PROBS.items())


def _hours(df):
    return df.withColumns({n: F.round(n, 6) for n in [*PROBS, "avg_hours"]})


_DIMS = ["order_status", "reason", "flow", "in_stage_action"]


@query("a50_dwell_percentiles", f"""
    WITH {_FINAL}
    SELECT {", ".join(_DIMS)}, count(flow) AS orders, round(avg(in_stage_seconds) / 3600, 6) AS avg_hours,
           {_QUANTILES} FROM summary GROUP BY 1, 2, 3, 4""")
def _(t):
    return _hours(lc.dwell_percentiles(checkpointed(_final(t)), _DIMS, PROBS))


@query("a51_dwell_percentiles_other_items", f"""
    WITH {_FINAL}
    SELECT {", ".join(_DIMS)}, count(flow) AS orders, round(avg(in_stage_seconds) / 3600, 6) AS avg_hours,
           {_QUANTILES} FROM summary
    WHERE entity_id IN (SELECT entity_id FROM custom_item WHERE item_code IS NULL)
    GROUP BY 1, 2, 3, 4""")
def _(t):
    other = t.custom_item.filter("item_code is null").select("entity_id").distinct()
    rows = _final(t).join(other, "entity_id", "left_semi")
    return _hours(lc.dwell_percentiles(checkpointed(rows), _DIMS, PROBS))


# marks of a case, each for every n-th
CASE_MARKS = {"prescribed": 2, "custom": 3, "comment": 4, "call_request": 5, "issue": 6, "staff_comment": 7, "infusion": 9}


def _audit_sql(match, minimal):
    if match == "prescribed":
        mid_name = "items_during"
        mid = """SELECT b.entity_id, count(DISTINCT s.k) AS n FROM base b JOIN stage_log s
                 ON s.entity_id = b.entity_id AND s.code = 2 AND s.made_at BETWEEN b.in_at AND b.out_at
                 GROUP BY 1"""
    else:
        mid_name = "items_catered"
        mid = f"""SELECT i.entity_id, count(*) AS n FROM stage_item i JOIN base b USING (entity_id)
                 WHERE {{before}} AND EXISTS (SELECT 1 FROM stage_log s WHERE s.entity_id = i.entity_id
                   AND s.code = 2 AND s.k = i.item_code AND s.made_at <= b.next2_at) GROUP BY 1"""
    before = ("((NOT i.deleted AND i.created_at < b.out_at) OR "
              "(i.deleted AND i.deleted_at > b.out_at))")
    mid = mid.replace("{before}", before)
    marks = ", ".join(f"CASE WHEN b.entity_id % {n} = 0 THEN 1 ELSE 0 END AS {c}_flag" for c, n in CASE_MARKS.items())
    extra = "" if minimal else f""", b.confirmed_at, CASE WHEN b.entity_id % 7 <> 6 THEN 'Dr ' || (b.entity_id % 7) END AS staff_name, {marks},
           CASE WHEN b.source = 6 OR (b.source = 7 AND (b.prev_code = 1 OR b.prev_code IS NULL))
                THEN 1 ELSE 0 END AS straight_flag"""
    return f"""
    WITH {_VISIT},
    ok AS (SELECT entity_id, min(made_at) AS confirmed_at FROM status_log WHERE code = 4 GROUP BY 1),
    base AS (SELECT * FROM program LEFT JOIN visit USING (entity_id) LEFT JOIN ok USING (entity_id)),
    counted AS (
        SELECT i.entity_id, count(DISTINCT CASE WHEN {before} THEN i.item_code END) AS items_before,
               count(DISTINCT CASE WHEN NOT i.deleted OR i.deleted_at > b.confirmed_at
                              THEN i.item_code END) AS items_after
        FROM stage_item i JOIN base b USING (entity_id) GROUP BY 1),
    mid AS ({mid})
    SELECT b.entity_id, b.in_at AS first_in_at, b.out_at AS first_out_at,
           CASE b.last_code WHEN 4 THEN 'fulfilled' WHEN 5 THEN 'cancelled' WHEN 3 THEN 'rejected'
                ELSE 'under process' END AS latest_status,
           CASE WHEN b.next_code = 4 THEN 1 ELSE 0 END AS skipped_flag,
           CASE WHEN b.confirmed_at IS NOT NULL THEN 1 ELSE 0 END AS confirmed_flag,
           coalesce(c.items_before, 0) AS items_before, coalesce(m.n, 0) AS {mid_name},
           coalesce(c.items_after, 0) AS items_after{extra}
    FROM base b LEFT JOIN counted c USING (entity_id) LEFT JOIN mid m USING (entity_id)"""


def _audit(t, **options):
    answered = t.stage_log.filter("code = 2").select(
        "entity_id", F.col("k").alias("item_code"), F.col("made_at").alias("answered_at"))
    i = F.col("entity_id")
    program = t.program.withColumns({
        "staff_name": F.when(i % 7 != 6, F.concat(F.lit("Dr "), (i % 7).cast("string"))),
        **{c: i % n == 0 for c, n in CASE_MARKS.items()}})
    return lc.stage_visit_audit(program, t.status_log, t.stage_item, answered, STAGE, CONFIRMED,
                                LATEST, **options)


@query("a18_stage_visit_audit", _audit_sql("prescribed", False))
def _(t):
    return _audit(t)


@query("a19_stage_visit_audit_digitised", _audit_sql("digitised", False))
def _(t):
    return _audit(t, match="digitised")


@query("a20_stage_visit_superset", _audit_sql("prescribed", True))
def _(t):
    path = sinks.fresh_path(t.spark, "mismatch_superset")
    _audit(t, minimal=True).write.parquet(path)
    return t.spark.read.parquet(path)


_AFFECTED = f"""
    WITH {_VISIT},
    entry AS (SELECT p.*, coalesce(p.source = 7 AND v.prev_code = 1, false) AS affected
              FROM program p LEFT JOIN visit v USING (entity_id))"""


@query("a21_direct_entry_monthly", f"""{_AFFECTED}
    SELECT year(placed_at) AS year, month(placed_at) AS month, count(*) AS total_orders,
           count(CASE WHEN affected THEN 1 END) AS affected_orders FROM entry GROUP BY 1, 2""")
def _(t):
    return lc.direct_entry_monthly(t.program, t.status_log, STAGE, 1, 7)


@query("a22_direct_entry_list", f"""{_AFFECTED}
    SELECT DISTINCT entity_id, placed_at FROM entry WHERE affected""")
def _(t):
    return lc.direct_entry_list(t.program, t.status_log, STAGE, 1, 7)


_GROUP = "CASE {} " + " ".join(f"WHEN {c} THEN '{g}'" for c, g in GROUPS.items()) + " END"
_BUCKET = f"coalesce({_GROUP.format('code')}, 'unexpected')"
_GROUP_DWELL = f"""group_dwell AS (
    SELECT entity_id, {_BUCKET} AS bucket,
           sum(date_diff('second', made_at, next_at))::BIGINT AS seconds FROM step GROUP BY 1, 2)"""


@query("a55_stage_dwell_by_function", f"""
    WITH {_GROUP_DWELL} SELECT *, seconds / 60 AS minutes FROM group_dwell""")
def _(t):
    return lc.dwell_by_group(t.status_log, GROUPS, "unexpected")


_SHORT = {g: f"in_{g}" for g in [*GROUPS.values(), "unexpected"]}
_PIVOT = ",\n".join(f"sum(CASE WHEN bucket = '{g}' THEN seconds END)::BIGINT AS {s}"
                    for g, s in _SHORT.items())


@query("a56_function_health", f"""
    WITH {_GROUP_DWELL}, {_STATUS},
    wide AS (SELECT entity_id, {_PIVOT} FROM group_dwell GROUP BY 1),
    base AS (
        SELECT l.entity_id, l.placed_at, l.order_status, g.segment,
               l.placed_at + INTERVAL 3 DAY AS due_at,
               max(CASE WHEN s.code = 4 THEN s.made_at END) AS done_at,
               sum(round(e.value * 100)::BIGINT)::BIGINT AS value, count(*) AS lines, count(*) FILTER (s.id % 3 > 0) AS lines_delivered
        FROM labelled l JOIN geo g ON l.entity_id = g.customer_id
        JOIN status_log s ON s.entity_id = l.entity_id JOIN events e ON e.event_id = s.id
        GROUP BY 1, 2, 3, 4),
    kept AS (
        SELECT *, CASE WHEN due_at::DATE = done_at::DATE THEN '2) On Committed'
                       WHEN due_at::DATE > done_at::DATE THEN '1) Before Committed'
                       WHEN due_at::DATE < done_at::DATE THEN '3) After Committed'
                       ELSE '4) NA' END AS delivery_status
        FROM base JOIN wide USING (entity_id)
        WHERE due_at::DATE BETWEEN DATE '2024-01-30' - 60 AND DATE '2024-01-30' - 1
           OR done_at::DATE BETWEEN DATE '2024-01-30' - 60 AND DATE '2024-01-30' - 1)
    SELECT placed_at::DATE AS placed_date, coalesce(done_at::DATE, due_at::DATE) AS delivery_date,
           delivery_status, order_status, segment,
           {", ".join(f"sum({s})::BIGINT / 60 AS total_{s}, count({s}) AS count_{s}" for s in _SHORT.values())},
           sum(lines)::BIGINT AS total_lines, sum(lines_delivered)::BIGINT AS total_lines_delivered,
           sum(value)::BIGINT AS total_value, count(*) AS order_count
    FROM kept GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    paid = t.events.groupBy(F.col("user_id").alias("entity_id")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("event_id") % 3 > 0, 1)).alias("lines_delivered"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("done_at"))
    place = t.geo.select(F.col("customer_id").alias("entity_id"), "segment")
    orders = (_status(t).join(paid, "entity_id").join(place, "entity_id")
              .withColumn("due_at", F.timestamp_add("DAY", F.lit(3), "placed_at")))
    dwell = lc.dwell_by_group(t.status_log, GROUPS, "unexpected")
    return lc.function_health(orders, dwell, _SHORT, EVENTS_AS_OF, 60, ["order_status", "segment"])


@query("a95_reentry_instances", f"""
    WITH numbered AS (
        SELECT *, CASE WHEN prev_code = 2 THEN row_number() OVER (PARTITION BY entity_id, prev_code = 2 ORDER BY id) END AS n2,
               CASE WHEN prev_code = 3 THEN row_number() OVER (PARTITION BY entity_id, prev_code = 3 ORDER BY id) END AS n3,
               CASE WHEN code = 5 THEN row_number() OVER (PARTITION BY entity_id, code = 5 ORDER BY id) END AS nv
        FROM step),
    again AS (
        SELECT *, code = 5 AND coalesce(n2, 0) <> 1 AND coalesce(n3, 0) <> 1 AND coalesce(nv, 0) <> 1 AS hit
        FROM numbered),
    inst AS (
        SELECT entity_id, prev_code, prev_at, made_at, owner,
               row_number() OVER (PARTITION BY entity_id ORDER BY id) AS instance,
               {_GROUP.format('prev_code')} AS responsible
        FROM again WHERE hit)
    SELECT * FROM inst WHERE responsible IS NOT NULL AND entity_id IN (
        SELECT entity_id FROM inst WHERE responsible IS NOT NULL AND made_at::DATE = DATE '2024-01-29')""")
def _(t):
    return lc.reentry_instances(t.status_log, 5, GROUPS, EVENTS_AS_OF, [2, 3])


@query("a96_reentry_summary", f"""
    WITH past AS (SELECT * FROM status_log WHERE made_at::DATE < DATE '2024-01-30'),
    hit AS (SELECT entity_id FROM past WHERE code = 5 AND made_at::DATE = DATE '2024-01-29'),
    looked AS (SELECT *, lag(code) OVER (PARTITION BY entity_id ORDER BY id) AS prev
               FROM past WHERE entity_id IN (SELECT entity_id FROM hit)),
    visits AS (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS nv,
               CASE WHEN prev = 2 THEN row_number() OVER (PARTITION BY entity_id, prev = 2 ORDER BY id) END AS n2
        FROM looked WHERE code = 5)
    SELECT {_GROUP.format('prev')} AS responsible,
           CASE prev {" ".join(f"WHEN {c} THEN '{n}'" for c, n in NAMES.items())} END AS status_before,
           count(DISTINCT CASE WHEN made_at::DATE = DATE '2024-01-29' THEN entity_id END) AS same_day_orders,
           count(CASE WHEN made_at::DATE = DATE '2024-01-29' THEN entity_id END) AS same_day_instances,
           count(entity_id) AS total_instances
    FROM visits WHERE nv <> 1 AND coalesce(n2, 0) <> 1 GROUP BY 1, 2""")
def _(t):
    return lc.reentry_summary(t.status_log, 5, GROUPS, NAMES, EVENTS_AS_OF, 2)
