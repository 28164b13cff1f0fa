"""Task and consultation facts, their incremental keys, and the office-hours turnaround."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timefn import boundary_diff, epoch, moment, office_seconds
from tidemark.operators.lifecycle import first_visit, steps
from tidemark.operators.ordered import KeyedSequence

# fixed values: seconds a task of each outcome is expected to take
BENCHMARKS = {"Done": 180, "Hold": 60, "Rescheduled": 120, "Rejected": 75, "Reassigned": 80,
              "Inactive": 0}

#: a case has few tasks: lanes of 64 days leave most cases in one or two
CASE_LANE = 64 * 86400


def _label(mapping: Mapping, column: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[column]


def task_fact(case_log: DataFrame, profiles: DataFrame, actions: Mapping[int, str], call: int, answered: int,
              hangup: int, inactive: int, done: int, start: str, as_of: str,
              benchmarks: Mapping[str, int] = BENCHMARKS) -> DataFrame:
    """One row per task of a case log: call times, outcome, reason, counts, neighbours within the case.

    The log has the order of the case and the reason of a rejection; `profiles`
    gives the profile of an owner.
    """
    c, at = F.col("code"), F.col("made_at")
    on = lambda *codes: F.when(c.isin(*codes), at)
    ended = [*actions, hangup]
    first_done = case_log.filter(c == done).groupBy("case_id").agg(F.min(at).alias("_first_done"))
    # one row for each code and time of a task, so that counting times needs no copies of the log; dealt once by task
    # and put in order once, and both aggregates read along that order
    task = ["task_id", "order_id", "case_id", "task_type"]
    log = case_log.repartition(*task).groupBy(*task, "code", "made_at").agg(
        F.max("owner").alias("owner"), F.max("reason").alias("reason"))
    tasks = log.groupBy(*task).agg(
        F.max("owner").alias("owner"), F.min(at).alias("assigned_at"),
        F.min(on(call)).alias("first_call_at"), F.max(on(call)).alias("last_call_at"),
        F.min(on(hangup)).alias("first_hangup_at"), F.max(on(hangup)).alias("last_hangup_at"),
        F.max(on(*actions)).alias("actioned_at"), F.max(on(*ended)).alias("detached_at"),
        F.max(_label(actions, c)).alias("action"), F.max("reason").alias("reject_reason"),
        F.count(on(call)).alias("attempts"), F.count(on(answered)).alias("connected"),
        F.count(on(hangup)).alias("hangups"), F.count(on(inactive)).alias("notified"),
        F.max(F.when(c == inactive, 1).otherwise(0)).alias("inactive_flag"), F.max(at).alias("_last"))
    names = tasks.columns[:-1]
    tasks = tasks.join(first_done, "case_id", "left").select(
        *names, F.when(F.col("_first_done") <= F.col("_last"), 1).otherwise(0).alias("issue_flag"))
    day = F.to_date("assigned_at")
    kept = tasks.filter(day.between(F.to_date(F.lit(start)), F.date_sub(F.to_date(moment(as_of)), 1)))
    seq = KeyedSequence(kept, ["case_id"], [F.col("assigned_at"), F.col("task_id")],
                        F.floor(epoch("assigned_at") / F.lit(CASE_LANE)))
    linked = seq.shift({"previous_task_id": ("task_id", -1), "next_task_id": ("task_id", 1)}).frame()
    return linked.join(profiles, "owner", "left").withColumn(
        "expected_seconds", _label(benchmarks, F.col("action")).cast("long"))


def changed_tasks(case_log: DataFrame, since: str) -> DataFrame:
    """Tasks whose first log row is on or after a date."""
    return (case_log.groupBy("task_id").agg(F.min(F.to_date("made_at")).alias("d"))
            .filter(F.col("d") >= F.to_date(F.lit(since))).select("task_id"))


def changed_orders(program: DataFrame, fact: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Orders touched in the last days or not yet in the fact."""
    known = fact.select("entity_id").distinct().withColumn("_in", F.lit(True))
    since = F.date_sub(F.to_date(moment(as_of)), days)
    return (program.join(known, "entity_id", "left")
            .filter((F.to_date("updated_at") >= since) | F.col("_in").isNull())
            .select("entity_id").distinct())


def latest_reason(log: DataFrame, name: str) -> DataFrame:
    """The reason given last for each entity; of equal times the greater reason."""
    return log.groupBy("entity_id").agg(F.max_by("reason", F.struct("made_at", "reason")).alias(name))


def staff_category(staff: Column, partners: Sequence[int]) -> Column:
    return F.when(staff.isin(*partners), "Third_Party").when(staff.isNull(), "Not Applicable").otherwise("House")


def cancelled_first(first_response: str, next_code: str, out_at: str, cancelled: int, grace: int) -> Column:
    """The first stay ended in a cancellation before anyone answered, or within `grace` seconds of the answer."""
    quick = boundary_diff("second", first_response, out_at) < grace
    return F.coalesce((F.col(next_code) == cancelled) & (quick | F.col(first_response).isNull()), F.lit(False))


def consultation_fact(changed: DataFrame, program: DataFrame, history: DataFrame,
                      order_history: DataFrame, staff: DataFrame, rejections: DataFrame,
                      refusals: DataFrame, stage: int, cancelled: int, moved: Sequence[int],
                      assigned: int, responses: Sequence[int], done: int, rejected: int, held: int,
                      sources: Mapping[int, str], partners: Sequence[int], customer_reasons: Sequence[str],
                      issue_type: int = 2, sla: tuple[int, int] = (90, 120), grace: int = 40) -> DataFrame:
    """One row per changed order: who and why, responses, turnaround over the clock and office hours, SLA flags.

    `program` has the case's staff id, source, type, requested time and last
    code; `rejections` and `refusals` are logs of (entity_id, made_at, reason),
    of which the latest counts.
    """
    c, at = F.col("code"), F.col("made_at")
    on = lambda *codes: F.when(c.isin(*codes), at)
    ids = changed.select("entity_id")
    hist = history.join(ids, "entity_id", "left_semi")
    act = hist.groupBy("entity_id").agg(
        F.min(on(*moved)).alias("first_moved_at"), F.min(on(assigned)).alias("first_assigned_at"),
        F.max(on(assigned)).alias("last_assigned_at"), F.min(on(*responses)).alias("_first_resp"),
        F.max(on(*responses)).alias("last_any_response_at"), F.min(on(done)).alias("first_done_at"),
        F.max(on(done)).alias("last_done_at"), F.max(on(rejected)).alias("rejected_at"),
        F.count(on(held)).alias("holds"), F.count(on(*responses)).alias("attempts"),
        F.min_by("code", F.when(c.isin(*responses), F.col("id"))).alias("first_response"),
        F.max_by("code", F.when(c.isin(*responses), F.col("id"))).alias("last_response"),
        F.max_by("made_at", F.when(c.isin(*responses), F.col("id"))).alias("last_response_at"))
    stays = order_history.join(ids, "entity_id", "left_semi")
    visits = stays.filter(c == stage).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("instances"), F.max_by("made_at", "id").alias("last_moved_at"))
    first = first_visit(stays, stage).select("entity_id", "next_code", "out_at")
    won = program.filter(F.col("last_code") == done).groupBy("customer_id").agg(
        F.min("entity_id").alias("_won"))
    wide = (program.join(ids, "entity_id", "left_semi").join(act, "entity_id")
            .join(visits, "entity_id").join(first, "entity_id", "left")
            .join(won, "customer_id", "left").join(staff, "staff", "left")
            .join(latest_reason(rejections, "rejection_reason"), "entity_id", "left")
            .join(latest_reason(refusals, "refuse_reason"), "entity_id", "left"))
    wide = wide.withColumn("_canned", cancelled_first("_first_resp", "next_code", "out_at", cancelled, grace))
    by = F.when(F.col("rejection_reason").isin(*customer_reasons), "customer/other").when(
        F.col("rejection_reason").isNotNull(), "staff")
    over = lambda end: (epoch(end) - epoch("first_moved_at")) / 60
    office = lambda end: office_seconds("first_moved_at", end) / 60
    live = lambda e: F.when(~F.col("_canned"), e)
    late = lambda e, m: F.when(e > m, 1).otherwise(0)
    frt = office("_first_resp")
    return wide.select(
        "entity_id", "customer_id", "placed_at", "staff_name",
        staff_category(F.col("staff"), partners).alias("staff_category"),
        _label(sources, F.col("source")).alias("order_source"), "requested_at",
        F.col("last_code").alias("latest_status"),
        F.when(F.col("entity_id") > F.col("_won"), "Repeat").otherwise("First Time")
        .alias("consultation_type"),
        F.when(F.col("kind") == issue_type, 1).otherwise(0).alias("issue_flag"), "refuse_reason",
        "rejection_reason", by.alias("rejected_by"),
        F.when(F.col("_canned"), 1).alias("cancelled_before_response"), "instances", "attempts",
        "holds", "first_moved_at", "first_assigned_at", "first_response",
        live(F.col("_first_resp")).alias("first_response_at"), "last_response", "last_response_at",
        "first_done_at", "last_moved_at", "last_assigned_at", "last_done_at",
        "last_any_response_at", "rejected_at",
        live(over("_first_resp")).alias("response_minutes"), live(frt).alias("response_office_minutes"),
        over("first_done_at").alias("first_done_minutes"),
        office("first_done_at").alias("first_done_office_minutes"),
        over("last_done_at").alias("last_done_minutes"),
        office("last_done_at").alias("last_done_office_minutes"),
        late(frt, sla[0]).alias("internal_breach"), late(frt, sla[1]).alias("committed_breach"),
        F.when(F.col("first_done_at").isNotNull(), late(office("first_done_at"), sla[1]))
        .alias("overall_breach"))


def turnaround(history: DataFrame, **hours) -> DataFrame:
    """Office-hours time from each status to the next."""
    rows = steps(history).shift({"next_at": ("made_at", 1)}).frame().filter("next_at is not null")
    secs = office_seconds("made_at", "next_at", **hours)
    return rows.select("id", "made_at", "next_at", secs.alias("office_seconds"),
                       (secs / 60).alias("office_minutes"))
