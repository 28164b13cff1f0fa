"""Sessions, handling efficiency and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timefn import month_index
from tidemark.operators import people as pp
from tidemark.plans.registry import query
from tidemark.plans.views import EVENTS_AS_OF

_SESSIONS = """
    online AS (SELECT owner, min(made_at) AS online_start, max(made_at) AS online_end FROM stage_log GROUP BY owner, made_at::DATE),
    blocked AS (SELECT owner, made_at AS blocked_at FROM stage_log WHERE code = 3 AND k >= 90),
    approved AS (
        SELECT b.owner, b.blocked_at, min(s.made_at) AS approved_at FROM blocked b
        LEFT JOIN stage_log s ON s.owner = b.owner AND s.code = 1 AND s.k >= 30 AND b.blocked_at <= s.made_at GROUP BY 1, 2),
    kept AS (
        SELECT o.* FROM online o WHERE NOT EXISTS (
            SELECT 1 FROM approved p WHERE p.owner = o.owner AND o.online_start >= p.blocked_at
             AND (o.online_end <= p.approved_at OR p.approved_at IS NULL)))"""


def _span(a, b, cond="true"):
    return f"sum(CASE WHEN {cond} THEN date_diff('second', {a}, {b}) END)::BIGINT"


@query("a57_session_utilisation", f"""
    WITH {_SESSIONS},
    joined AS (SELECT owner, min(actioned_at::DATE) AS joined_on FROM fact WHERE action = 'Done' GROUP BY 1),
    per AS (
        SELECT f.owner, j.joined_on, CASE WHEN date_diff('day', j.joined_on, f.assigned_at::DATE) >= 30 THEN 'Old' ELSE 'New' END AS owner_type,
               k.online_start, k.online_end, count(*) AS total_tasks, count(*) FILTER (action = 'Done') AS done,
               count(*) FILTER (action = 'Hold') AS held, count(*) FILTER (action = 'Reassigned') AS reassigned,
               count(*) FILTER (action = 'Rescheduled') AS rescheduled, count(*) FILTER (action = 'Rejected') AS rejected,
               count(*) FILTER (action = 'Hold' AND attempts = 0) AS held_without_call,
               count(*) FILTER (task_type = 'New') AS new_tasks, count(*) FILTER (task_type = 'Hold') AS hold_tasks,
               min(assigned_at) AS first_assigned_at, max(detached_at) AS last_detached_at,
               sum(inactive_flag)::BIGINT AS inactive, sum(notified)::BIGINT AS notified, sum(issue_flag)::BIGINT AS issues,
               count(*) FILTER (first_call_at < last_hangup_at) AS hung_up, count(actioned_at) AS actioned,
               count(*) FILTER (first_call_at < last_hangup_at AND action = 'Done') AS done_hung_up,
               {_span('assigned_at', 'first_call_at')} AS time_to_call, {_span('first_call_at', 'last_hangup_at')} AS call_time,
               {_span('last_hangup_at', 'actioned_at')} AS time_to_action, {_span('assigned_at', 'actioned_at')} AS handling_time,
               {_span('assigned_at', 'actioned_at', "action = 'Done'")} AS done_handling_time,
               {_span('assigned_at', 'detached_at')} AS attached_time
        FROM kept k JOIN fact f ON f.owner = k.owner AND f.assigned_at BETWEEN k.online_start AND k.online_end
        LEFT JOIN joined j ON j.owner = f.owner
        WHERE (action IS NOT NULL OR inactive_flag = 1) AND k.online_start::DATE >= DATE '2023-07-01' GROUP BY 1, 2, 3, 4, 5)
    SELECT *, date_diff('second', online_start, online_end) AS online_seconds,
           CASE WHEN last_detached_at >= online_end THEN last_detached_at ELSE online_end END AS actual_end,
           date_diff('second', online_start, CASE WHEN last_detached_at >= online_end THEN last_detached_at ELSE online_end END) AS actual_seconds
    FROM per""")
def _(t):
    log = t.stage_log
    sessions = log.groupBy("owner", F.to_date("made_at").alias("d")).agg(
        F.min("made_at").alias("online_start"), F.max("made_at").alias("online_end")).drop("d")
    blocks = log.filter("code = 3 and k >= 90").select("owner", F.col("made_at").alias("blocked_at"))
    ok = log.filter("code = 1 and k >= 30").select("owner", F.col("made_at").alias("approved_at"))
    return pp.session_utilisation(sessions, blocks, ok, t.fact, EVENTS_AS_OF)


_EFF = f"""count(*) AS tasks, sum(issue_flag)::BIGINT AS issues, sum(attempts)::BIGINT AS attempts, sum(hangups)::BIGINT AS hangups,
    sum(notified)::BIGINT AS notified, count(first_call_at) AS called, count(first_hangup_at) AS hung_up, count(actioned_at) AS actioned,
    {_span('assigned_at', 'first_call_at')} AS time_to_call, {_span('first_call_at', 'first_hangup_at')} AS first_call_time,
    {_span('last_call_at', 'last_hangup_at')} AS last_call_time, {_span('first_call_at', 'last_hangup_at')} AS call_time,
    {_span('last_hangup_at', 'actioned_at')} AS time_to_action, {_span('assigned_at', 'actioned_at')} AS handling_time,
    {_span('assigned_at', 'detached_at')} AS attached_time"""
_OUTCOME = "CASE WHEN action IS NULL AND inactive_flag = 1 THEN 'Inactive' ELSE action END"
OLD = {"Done": 180, "Hold": 60, "Rescheduled": 120, "Rejected": 75, "Reassigned": 0, "Inactive": 0}


@query("a58_task_efficiency", f"""
    WITH g AS (
        SELECT owner, assigned_at::DATE AS day, hour(assigned_at) AS hour, task_type, {_OUTCOME} AS outcome, {_EFF}
        FROM fact WHERE assigned_at::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-29' GROUP BY 1, 2, 3, 4, 5)
    SELECT *, tasks * CASE outcome WHEN 'Done' THEN 180 WHEN 'Hold' THEN 60 WHEN 'Reassigned' THEN 0 WHEN 'Inactive' THEN 0 END AS expected_time FROM g""")
def _(t):
    return pp.task_efficiency(t.fact, "2024-01-03", EVENTS_AS_OF, OLD)


@query("a59_task_efficiency_latest", f"""
    WITH answers AS (SELECT entity_id AS case_id, count(*) AS n FROM status_log WHERE code = 4 GROUP BY 1)
    SELECT f.owner, f.assigned_at::DATE AS day, hour(f.assigned_at) AS hour, f.task_type, CASE WHEN f.action IS NULL AND f.inactive_flag = 1 THEN 'Inactive' ELSE f.action END AS outcome,
           CASE WHEN f.next_task_id IS NULL THEN 'last_task' ELSE 'intermediate_task' END AS task_stage,
           {_EFF.replace("(issue_flag", "(f.issue_flag").replace("attempts)", "f.attempts)").replace("(hangups", "(f.hangups").replace("(notified", "(f.notified").replace("first_call_at", "f.first_call_at").replace("first_hangup_at", "f.first_hangup_at").replace("actioned_at", "f.actioned_at").replace("assigned_at", "f.assigned_at").replace("last_call_at", "f.last_call_at").replace("last_hangup_at", "f.last_hangup_at").replace("detached_at", "f.detached_at").replace("AS f.", "AS ")},
           sum(f.expected_seconds)::BIGINT AS expected_time,
           count(CASE WHEN f.action = 'Done' AND f2.issue_flag = 1 THEN 1 END) AS issues_after,
           sum(CASE WHEN f.next_task_id IS NULL THEN a.n END)::BIGINT AS answers
    FROM fact f LEFT JOIN fact f2 ON f.next_task_id = f2.task_id LEFT JOIN answers a ON a.case_id = f.case_id
    WHERE (f.action IN ('Done', 'Hold', 'Reassigned') OR f.inactive_flag = 1) AND f.assigned_at::DATE BETWEEN DATE '2023-07-01' AND DATE '2024-01-29'
    GROUP BY 1, 2, 3, 4, 5, 6""")
def _(t):
    answers = t.status_log.filter("code = 4").groupBy(F.col("entity_id").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n"))
    return pp.task_efficiency(t.fact, "2023-07-01", EVENTS_AS_OF, None, True, answers)


GRADES_AS_OF = "2001-08-01 00:00:00"
_PEOPLE = """
    people AS (
        SELECT l_suppkey AS person, year(l_shipdate) * 12 + month(l_shipdate) AS month,
               count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_shipdate END) AS days,
               count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS done, count(*) AS lines,
               count(CASE WHEN l_returnflag = 'R' THEN 1 END)::DOUBLE / count(*) AS issue,
               count(CASE WHEN l_linestatus = 'O' THEN 1 END)::DOUBLE / count(*) AS inactive,
               sum(l_linenumber)::DOUBLE / count(*) AS notified,
               sum(round(l_quantity)::BIGINT)::DOUBLE / sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS efficiency
        FROM lineitem WHERE l_shipdate::DATE >= DATE '{since}' GROUP BY 1, 2)"""


def _people(t, since):
    kept = F.col("l_returnflag") != "R"
    one = F.count(F.lit(1))
    return (t.lineitem.filter(F.to_date("l_shipdate") >= F.lit(since).cast("date"))
            .groupBy(F.col("l_suppkey").alias("person"), month_index("l_shipdate").alias("month")).agg(
        F.count_distinct(F.when(kept, F.col("l_shipdate"))).alias("days"),
        F.count(F.when(kept, 1)).alias("done"), one.alias("lines"),
        (F.count(F.when(~kept, 1)) / one).alias("issue"),
        (F.count(F.when(F.col("l_linestatus") == "O", 1)) / one).alias("inactive"),
        (F.sum("l_linenumber") / one).alias("notified"),
        (F.sum(F.round("l_quantity").cast("long"))
         / F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))).alias("efficiency")))


def _graded(since, cuts, labels):
    case = " ".join(f"WHEN score_percentile >= {c} THEN {g!r}" for c, g in zip(cuts, labels))
    return f"""{_PEOPLE.replace("{since}", since)},
    pr AS (
        SELECT *, percent_rank() OVER (PARTITION BY month ORDER BY days, done) AS online_percentile,
               percent_rank() OVER (PARTITION BY month ORDER BY done, days) AS consult_percentile,
               percent_rank() OVER (PARTITION BY month ORDER BY efficiency, done, days) AS efficiency_percentile,
               percent_rank() OVER (PARTITION BY month ORDER BY issue DESC, done, days) AS issue_percentile,
               percent_rank() OVER (PARTITION BY month ORDER BY inactive DESC, done, days) AS inactive_percentile,
               percent_rank() OVER (PARTITION BY month ORDER BY notified DESC, done, days) AS notified_percentile
        FROM people),
    scored AS (
        SELECT *, online_percentile * 0.2::DOUBLE + consult_percentile * 0.5::DOUBLE + efficiency_percentile * 0.2::DOUBLE
                  + issue_percentile * 0.0334::DOUBLE + inactive_percentile * 0.0334::DOUBLE + notified_percentile * 0.0334::DOUBLE AS score,
               percent_rank() OVER (PARTITION BY month ORDER BY online_percentile * 0.2::DOUBLE + consult_percentile * 0.5::DOUBLE
                  + efficiency_percentile * 0.2::DOUBLE + inactive_percentile * 0.05::DOUBLE + notified_percentile * 0.05::DOUBLE) AS score_percentile
        FROM pr),
    graded AS (SELECT *, CASE WHEN days <> 0 THEN CASE {case} ELSE {labels[-1]!r} END END AS grade FROM scored)"""


@query("a60_monthly_grades", f"""
    WITH {_graded('1999-01-01', (.8, .5, .2), (1, 2, 3, 4))}
    SELECT g.*, p.grade AS prev_grade_1, r.grade AS prev_grade_2 FROM graded g
    LEFT JOIN graded p ON p.person = g.person AND g.month = p.month + 1
    LEFT JOIN graded r ON r.person = g.person AND g.month = r.month + 2""")
def _(t):
    return pp.monthly_grades(_people(t, "1999-01-01"), (.8, .5, .2), (1, 2, 3, 4))


def _wide_sql():
    cols = []
    for k in range(7):
        at = lambda c: f"min(CASE WHEN age = {k} THEN {c} END) AS m{k}_{c}"  # noqa: E731,B023
        if k < 3:
            cols += [at(c) for c in ("days", "done", "efficiency", "inactive", "notified", "issue")]
        if k == 0:
            cols.append(at("score_percentile"))
        cols.append(at("grade"))
    return ", ".join(cols)


@query("a61_monthly_grades_wide", f"""
    WITH {_graded('2001-02-01', (.9, .7, .4), ('A', 'B', 'C', 'D'))},
    aged AS (SELECT *, 2001 * 12 + 8 - month AS age FROM graded WHERE 2001 * 12 + 8 - month BETWEEN 0 AND 6)
    SELECT person, {_wide_sql()} FROM aged GROUP BY 1""")
def _(t):
    return pp.monthly_grades(_people(t, "2001-02-01"), (.9, .7, .4), ("A", "B", "C", "D"),
                             wide_from=GRADES_AS_OF)
