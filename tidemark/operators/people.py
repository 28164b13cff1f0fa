"""Staff sessions, handling efficiency and monthly grades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.timefn import boundary_diff, epoch, moment, months_back
from tidemark.operators.facts import BENCHMARKS
from tidemark.operators.ordered import (KeyedSequence, asof, hour_lane, id_lane, percent_ranks)
from tidemark.operators.orders import lookup


def approved_sessions(sessions: DataFrame, blocks: DataFrame, approvals: DataFrame) -> DataFrame:
    """Sessions not inside a blocked span; a block ends at the next approval or never.

    The latest block before a session has the latest end, so it alone decides.
    """
    ended = asof(blocks, approvals, ["owner"], "blocked_at", "approved_at", ["approved_at"],
                 side="after", strict=False)
    met = asof(sessions, ended, ["owner"], "online_start", "blocked_at",
               ["blocked_at", "approved_at"], strict=False)
    inside = F.col("blocked_at").isNotNull() & (
        F.col("approved_at").isNull() | (F.col("online_end") <= F.col("approved_at")))
    return met.filter(~inside).select(*sessions.columns)


def session_utilisation(sessions: DataFrame, blocks: DataFrame, approvals: DataFrame,
                        tasks: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Tasks, outcomes and times per approved session; a person's sessions do not overlap."""
    kept = approved_sessions(sessions, blocks, approvals).filter(
        F.to_date("online_start") >= months_back(F.to_date(moment(as_of)), months))
    joined = tasks.filter("action = 'Done'").groupBy("owner").agg(
        F.min(F.to_date("actioned_at")).alias("joined_on"))
    work = tasks.filter(F.col("action").isNotNull() | (F.col("inactive_flag") == 1))
    placed = asof(work, kept, ["owner"], "assigned_at", "online_start", ["online_start", "online_end"],
                  strict=False).filter(F.col("assigned_at") <= F.col("online_end"))
    rows = placed.join(joined, "owner", "left")
    old = F.datediff(F.to_date("assigned_at"), F.col("joined_on")) >= 30
    is_ = lambda a: F.col("action") == a
    n = lambda c: F.count(F.when(c, 1))
    span = lambda a, b: F.sum(boundary_diff("second", a, b))
    done_span = lambda a, b: F.sum(F.when(is_("Done"), boundary_diff("second", a, b)))
    hung = F.col("first_call_at") < F.col("last_hangup_at")
    out = rows.groupBy("owner", "joined_on", F.when(old, "Old").otherwise("New").alias("owner_type"),
                       "online_start", "online_end").agg(
        F.count(F.lit(1)).alias("total_tasks"), n(is_("Done")).alias("done"),
        n(is_("Hold")).alias("held"), n(is_("Rescheduled")).alias("rescheduled"),
        n(is_("Reassigned")).alias("reassigned"), n(is_("Rejected")).alias("rejected"),
        n(is_("Hold") & (F.col("attempts") == 0)).alias("held_without_call"),
        n(F.col("task_type") == "New").alias("new_tasks"),
        n(F.col("task_type") == "Hold").alias("hold_tasks"),
        F.min("assigned_at").alias("first_assigned_at"), F.max("detached_at").alias("last_detached_at"),
        F.sum("inactive_flag").alias("inactive"), F.sum("notified").alias("notified"),
        F.sum("issue_flag").alias("issues"), n(hung).alias("hung_up"),
        F.count("actioned_at").alias("actioned"), n(hung & is_("Done")).alias("done_hung_up"),
        span("assigned_at", "first_call_at").alias("time_to_call"),
        span("first_call_at", "last_hangup_at").alias("call_time"),
        span("last_hangup_at", "actioned_at").alias("time_to_action"),
        span("assigned_at", "actioned_at").alias("handling_time"),
        done_span("assigned_at", "actioned_at").alias("done_handling_time"),
        span("assigned_at", "detached_at").alias("attached_time"))
    late = F.coalesce(F.col("last_detached_at") >= F.col("online_end"), F.lit(False))
    end = F.when(late, F.col("last_detached_at")).otherwise(F.col("online_end"))
    return out.withColumns({
        "online_seconds": boundary_diff("second", "online_start", "online_end"),
        "actual_end": end, "actual_seconds": epoch(end) - epoch("online_start")})


def task_efficiency(tasks: DataFrame, start: str, as_of: str, benchmarks: Mapping[str, int] | None,
                    next_task_issues: bool = False, answers: DataFrame | None = None) -> DataFrame:
    """Actual against expected seconds per person, day, hour, type and outcome.

    With `next_task_issues` a done task counts as an issue when the task after
    it is one, and `answers` (case_id, n) are credited to the last task of a case.
    """
    day = F.to_date("assigned_at")
    outcome = F.when(F.col("action").isNull() & (F.col("inactive_flag") == 1), "Inactive").otherwise(
        F.col("action"))
    rows = tasks
    dims, extra = [], []
    if next_task_issues:
        rows = KeyedSequence(rows, ["case_id"], [F.col("assigned_at"), F.col("task_id")],
                             hour_lane("assigned_at")).shift({"next_issue": ("issue_flag", 1)}).frame()
        rows = rows.filter(F.col("action").isin(*BENCHMARKS) | (F.col("inactive_flag") == 1))
        rows = rows.join(answers, "case_id", "left")
        last = F.col("next_task_id").isNull()
        dims = [F.when(last, "last_task").otherwise("intermediate_task").alias("task_stage")]
        extra = [F.count(F.when((F.col("action") == "Done") & (F.col("next_issue") == 1), 1))
                 .alias("issues_after"), F.sum(F.when(last, F.col("n"))).alias("answers")]
    rows = rows.filter(day.between(F.to_date(F.lit(start)), F.date_sub(F.to_date(moment(as_of)), 1)))
    span = lambda a, b: F.sum(boundary_diff("second", a, b))
    out = rows.groupBy("owner", day.alias("day"), F.hour("assigned_at").alias("hour"), "task_type",
                       outcome.alias("outcome"), *dims).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("issue_flag").alias("issues"),
        F.sum("attempts").alias("attempts"), F.sum("hangups").alias("hangups"),
        F.sum("notified").alias("notified"), F.count("first_call_at").alias("called"),
        F.count("first_hangup_at").alias("hung_up"), F.count("actioned_at").alias("actioned"),
        span("assigned_at", "first_call_at").alias("time_to_call"),
        span("first_call_at", "first_hangup_at").alias("first_call_time"),
        span("last_call_at", "last_hangup_at").alias("last_call_time"),
        span("first_call_at", "last_hangup_at").alias("call_time"),
        span("last_hangup_at", "actioned_at").alias("time_to_action"),
        span("assigned_at", "actioned_at").alias("handling_time"),
        span("assigned_at", "detached_at").alias("attached_time"),
        F.sum("expected_seconds").alias("_expected"), *extra)
    if benchmarks is None:
        return out.withColumnRenamed("_expected", "expected_time")
    return out.withColumn("expected_time", F.col("tasks") * lookup(benchmarks, F.col("outcome"))).drop(
        "_expected")


# fixed values: metric, sign of its first sort key, share of the shown score, share of the ranking
METRICS = {"online": (1, .2, .2), "consult": (1, .5, .5), "efficiency": (1, .2, .2),
           "issue": (-1, .0334, None), "inactive": (-1, .0334, .05), "notified": (-1, .0334, .05)}


def monthly_grades(rows: DataFrame, cuts: Sequence[float], labels: Sequence, lags: int = 2,
                   wide_from: str | None = None, wide_months: int = 7) -> DataFrame:
    """Grades per person and month from weighted percentile ranks within the month.

    The six rankings run as one: rows are turned into one row per metric, ranked
    by month and metric, and turned back.
    """
    first = {"online": ("days", "done"), "consult": ("done", "days"),
             "efficiency": ("efficiency", "done", "days"), "issue": ("issue", "done", "days"),
             "inactive": ("inactive", "done", "days"), "notified": ("notified", "done", "days")}
    entries = F.array(*[F.struct(
        F.lit(m).alias("metric"), (F.col(first[m][0]) * F.lit(float(sign))).alias("s1"),
        F.col(first[m][1]).cast("double").alias("s2"),
        (F.col(first[m][2]) if len(first[m]) > 2 else F.lit(0)).cast("double").alias("s3"))
        for m, (sign, _, _) in METRICS.items()])
    long = rows.select("person", "month", F.inline(entries))
    ranked = percent_ranks(long, ["month", "metric"], [F.col("s1"), F.col("s2"), F.col("s3")],
                           F.floor(F.col("s1") * 4096), "pr")
    back = ranked.groupBy("person", "month").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("pr"))).alias(m + "_percentile") for m in METRICS])
    scored = rows.join(back, ["person", "month"])

    def weighted(part):
        total = None
        for m, shares in METRICS.items():
            if shares[part] is not None:
                term = F.col(m + "_percentile") * F.lit(shares[part])
                total = term if total is None else total + term
        return total

    scored = scored.withColumns({"score": weighted(1), "_rank_by": weighted(2)})
    final = percent_ranks(scored, ["month"], [F.col("_rank_by")], F.floor(F.col("_rank_by") * 4096),
                          "score_percentile").drop("_rank_by")
    p, grade = F.col("score_percentile"), F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        grade = F.when(p >= cut, F.lit(label)).otherwise(grade)
    graded = final.withColumn("grade", F.when(F.col("days") != 0, grade))
    if wide_from is not None:
        return _wide(graded, wide_from, wide_months)
    if not lags:
        return graded
    seq = KeyedSequence(graded, ["person"], [F.col("month")], id_lane("month", 1200))
    seq.shift({f"_m{i}": ("month", -i) for i in range(1, lags + 1)}
              | {f"_g{i}": ("grade", -i) for i in range(1, lags + 1)})
    out = seq.frame()
    for k in range(1, lags + 1):
        value = F.lit(None)
        for i in range(1, k + 1):
            value = F.when(F.col(f"_m{i}") == F.col("month") - k, F.col(f"_g{i}")).otherwise(value)
        out = out.withColumn(f"prev_grade_{k}", value)
    return out.drop(*[f"_{x}{i}" for x in "mg" for i in range(1, lags + 1)])


def _wide(graded: DataFrame, as_of: str, months: int) -> DataFrame:
    """One row per person with the grades, and the figures of the latest months, side by side."""
    day = moment(as_of)
    age = (F.year(day) * 12 + F.month(day)) - F.col("month")
    cols = []
    for k in range(months):
        at = lambda c: F.min(F.when(age == k, F.col(c)))  # noqa: E731,B023
        if k < 3:
            cols += [at(c).alias(f"m{k}_{c}") for c in
                     ("days", "done", "efficiency", "inactive", "notified", "issue")]
        if k == 0:
            cols.append(at("score_percentile").alias("m0_score_percentile"))
        cols.append(at("grade").alias(f"m{k}_grade"))
    return graded.filter(age.between(0, months - 1)).groupBy("person").agg(*cols).orderBy(
        F.col("m0_score_percentile").desc_nulls_last())
