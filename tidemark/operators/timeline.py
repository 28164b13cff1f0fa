"""Responses and attempts along a case: who acted when, before and after a booking or a cut-off."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.textfn import note_action
from tidemark.functions.timefn import at_time, boundary_diff, moment, time_of_day
from tidemark.operators.lifecycle import first_visit, snapshot_at, steps
from tidemark.operators.ordered import KeyedSequence, asof, hour_lane


def response_timeline(case_log: DataFrame, history: DataFrame, stage: int, done: int,
                      dropped: int, patterns: Sequence[str], json_path: str = "$.k",
                      hold_markers: bool = False) -> DataFrame:
    """One row per response during the first stage visit of its case.

    The two log rows before a response are its call start and call end. All
    windows run over one ordering of the case, with predicates instead of
    repeated filtered windows.
    """
    visit = first_visit(history, stage).select("entity_id", "in_at", "out_at",
                                               F.col("next_code").alias("then_code"))
    opened = case_log.groupBy("entity_id").agg(F.min("made_at").alias("case_at"))
    log = case_log.join(visit, "entity_id").join(opened, "entity_id")
    wanted = F.lit(False)
    for p in patterns:
        wanted = wanted | F.col("note").like(p)
    keep = F.coalesce(wanted & F.col("made_at").between(F.col("in_at"), F.col("out_at")),
                      F.lit(False))
    refused = F.when(F.col("then_code") == dropped, "CustomerRejected").otherwise("StaffRejected")
    action = (F.when(F.col("code") == done, "Done").when(F.col("note").like("%Reassign%"), "Reassigned")
              .when(F.col("note").like("%Rejected%"), refused).otherwise(note_action(F.col("note"))))
    log = log.withColumns({"keep": keep, "action": action})
    seq = steps(log).shift({"call_started_at": ("made_at", -2), "call_ended_at": ("made_at", -1),
                            "prev_props": ("props", -1)})
    numbers = {"response_number": F.col("keep")}
    if hold_markers:
        numbers["hold_number"] = F.col("keep") & (F.col("action") == "Hold:")
    seq.number_where(numbers)
    extra = []
    if hold_markers:
        seq.fill({"_kept": F.when(F.col("keep"), F.struct("hold_number"))})
        seq.shift({"_before": ("_kept", -1)})
        prior = F.col("_before.hold_number")
        extra = ["hold_number", F.when(prior == 1, 1).alias("response_after_hold"),
                 F.when(prior.isNotNull(), F.col("response_number")).alias("responses_after_hold")]
    rows = seq.total({"n": F.when(F.col("keep"), 1).otherwise(0)}).frame().filter("keep")
    first, last = F.col("response_number") == 1, F.col("response_number") == F.col("n")
    # fixed values: names of a response by its place
    kind = (F.when(first & last, "FirstLast_response").when(first, "First_response")
            .when(last, "Last_response").otherwise("Intermediate_response"))
    return rows.select(
        F.col("entity_id").alias("case_id"), F.col("id").alias("log_id"), "owner",
        "response_number", kind.alias("response_type"), "action", "note", "call_started_at",
        "call_ended_at", F.col("made_at").alias("actioned_at"),
        boundary_diff("second", "call_started_at", "call_ended_at").alias("dial_seconds"),
        F.when(first, boundary_diff("minute", "case_at", "call_started_at"))
        .alias("minutes_to_first_attempt"),
        F.get_json_object("prev_props", json_path).alias("call_value"), *extra)


def nearest_attempts(attempts: DataFrame, bookings: DataFrame) -> DataFrame:
    """First and last attempt on each side of every booking, strictly before or after it."""
    cols = ["attempt", "attempt_at"]
    tries = attempts.select("entity_id", "id", F.col("action").alias("attempt"),
                            F.col("made_at").alias("attempt_at"))
    def pick(side):
        near = asof(bookings, tries, ["entity_id"], "booked_at", "attempt_at", cols, side=side,
                    tie="id", count="n")
        return near.select("booking_id", F.col("attempt").alias(f"{side}_near"),
                           F.col("attempt_at").alias(f"{side}_near_at"), F.col("n").alias(f"{side}_n"))
    ends = tries.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.min_by(F.struct(*cols), F.struct("attempt_at", "id")).alias("lo"),
        F.max_by(F.struct(*cols), F.struct("attempt_at", "id")).alias("hi"))
    rows = (bookings.join(pick("before"), "booking_id").join(pick("after"), "booking_id")
            .join(ends, "entity_id", "left"))
    has_before, has_after = F.col("before_near_at").isNotNull(), F.col("after_near_at").isNotNull()
    return rows.select(
        "entity_id", "booking_id", "booked_at",
        F.when(has_before, F.col("lo.attempt")).alias("before_first"),
        F.when(has_before, F.col("lo.attempt_at")).alias("before_first_at"),
        F.col("before_near").alias("before_last"),
        F.when(has_before, F.col("before_n")).alias("before_last_number"),
        F.col("before_near_at").alias("before_last_at"), F.col("after_near").alias("after_first"),
        F.when(has_after, F.col("total") - F.col("after_n") + 1).alias("after_first_number"),
        F.col("after_near_at").alias("after_first_at"),
        F.when(has_after, F.col("hi.attempt")).alias("after_last"),
        F.when(has_after, F.col("total")).alias("after_last_number"),
        F.when(has_after, F.col("hi.attempt_at")).alias("after_last_at"))


def slot_utilisation(slots: DataFrame, bookings: DataFrame, start: str, end: str) -> DataFrame:
    """Live bookings and last booking per slot; the slot start is built from date and time text."""
    live = F.col("deleted_at").isNull()
    per = bookings.groupBy("slot_id").agg(
        F.count(F.when(live, F.col("booking_id"))).alias("total_bookings"),
        F.max(F.when(live, F.col("booked_at"))).alias("last_booking_at"))
    begins = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format("slot_date", "yyyy-MM-dd"), "start_time"))
    return (slots.filter(F.col("slot_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
            .withColumn("slot_start_at", begins).join(per, "slot_id", "left")
            .withColumn("total_bookings", F.coalesce("total_bookings", F.lit(0))))


def attempts_before_cutoff(orders: DataFrame, tasks: DataFrame, holds: Sequence[str],
                           noon: str = "12:00:00", cutoff: str = "14:00:00") -> DataFrame:
    """Attempts per order inside its first stay, and those before the promise cut-off.

    Orders placed before noon are due at the cut-off of the same day, others of
    the next day.
    """
    t = tasks.filter("action is not null").join(orders, "case_id")
    inside = F.col("assigned_at").between(F.col("in_at"), F.col("last_response_at"))
    limit = F.when(time_of_day("placed_at") < noon, at_time("placed_at", cutoff)).otherwise(
        at_time(F.date_add(F.to_date("placed_at"), 1), cutoff))
    early = F.col("assigned_at") < limit
    held = F.col("action").isin(*holds)
    when = lambda p, c: F.when(p, F.col(c))
    key = F.struct("assigned_at", "task_id")
    agg = t.groupBy("case_id").agg(
        F.min(when(inside, "assigned_at")).alias("first_task_at"),
        F.min_by("action", F.when(inside, key)).alias("first_response"),
        F.count(when(inside, "task_id")).alias("attempts"),
        F.count(when(inside & held, "task_id")).alias("hold_attempts"),
        F.max(when(inside, "assigned_at")).alias("last_task_at"),
        F.max_by("action", F.when(inside, key)).alias("last_response"),
        F.count(when(early, "task_id")).alias("early_attempts"),
        F.count(when(early & held, "task_id")).alias("early_hold_attempts"),
        F.max(when(early, "assigned_at")).alias("early_last_task_at"),
        F.max_by("action", F.when(early, key)).alias("early_last_response"))
    zero = ["attempts", "hold_attempts", "early_attempts", "early_hold_attempts"]
    return orders.join(agg, "case_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in zero})


def attempt_training_set(tasks: DataFrame, orders: DataFrame, flags: DataFrame,
                         outcomes: Mapping[str, int]) -> DataFrame:
    """Called attempts with an outcome: success flag, next attempt, ordinal from both ends."""
    success = F.create_map(*[F.lit(x) for pair in outcomes.items() for x in pair])
    t = (tasks.join(orders, "case_id")
         .filter(F.col("assigned_at").between(F.col("in_at"), F.col("out_at")))
         .join(flags, "task_id", "left")
         .withColumn("keep", F.coalesce((F.col("call_started") == 1)
                                        & F.col("action").isNotNull(), F.lit(False))))
    seq = KeyedSequence(t, ["case_id"], [F.col("assigned_at"), F.col("task_id")],
                        hour_lane("assigned_at"))
    seq.shift({"next_assigned_at": ("assigned_at", 1)}).number_where(
        {"attempt_number": F.col("keep")}).total({"n": F.when(F.col("keep"), 1).otherwise(0)})
    return seq.frame().filter("keep").select(
        "case_id", "task_id", "assigned_at", "action", success[F.col("action")].alias("success"),
        "next_assigned_at", "attempt_number",
        (F.col("n") - F.col("attempt_number") + 1).alias("attempt_number_last"),
        "call_started", "call_answered")


def snapshot_attempts(history: DataFrame, tasks: DataFrame, flags: DataFrame, stage: int, at: str,
                      outcomes: Mapping[str, int]) -> DataFrame:
    """Entities in a stage at an instant with their attempts so far."""
    success = F.create_map(*[F.lit(x) for pair in outcomes.items() for x in pair])
    called = F.col("call_started") == 1
    so_far = (tasks.filter(F.col("assigned_at") < moment(at)).join(flags, "task_id", "left")
              .groupBy(F.col("case_id").alias("entity_id")).agg(
        F.count(F.when(called & F.col("action").isNotNull(), 1)).alias("total_attempts"),
        F.count(F.when(called & (success[F.col("action")] == 0), 1)).alias("unsuccessful_attempts"),
        F.count(F.when(called & (success[F.col("action")] == 1), 1)).alias("successful_attempts")))
    zero = ["total_attempts", "unsuccessful_attempts", "successful_attempts"]
    return snapshot_at(history, stage, at).join(so_far, "entity_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in zero})
