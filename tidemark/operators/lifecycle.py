"""Status histories: visits to a stage, time spent in it, and what surrounded it.

A history has columns id, entity_id, code, made_at; ids rise with time inside
an entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.textfn import note_time
from tidemark.functions.timefn import boundary_diff, moment
from tidemark.operators.distinct import distinct_in_unions
from tidemark.operators.ordered import KeyedSequence, asof, exact_percentiles, id_lane
from tidemark.session import checkpointed


def steps(history: DataFrame) -> KeyedSequence:
    """The history of each entity in id order."""
    return KeyedSequence(history, ["entity_id"], [F.col("id")], id_lane("id"))


def with_next(history: DataFrame) -> DataFrame:
    """Adds the next status and when it came."""
    return steps(history).shift({"next_code": ("code", 1), "next_at": ("made_at", 1)}).frame()


def first_visit(history: DataFrame, stage: int) -> DataFrame:
    """First visit to a stage per entity with the statuses around it."""
    seen = steps(history).shift({
        "prev_code": ("code", -1), "next_code": ("code", 1), "out_at": ("made_at", 1),
        "next2_code": ("code", 2), "next2_at": ("made_at", 2)}).frame()
    cols = ["made_at", "prev_code", "next_code", "out_at", "next2_code", "next2_at"]
    return (seen.filter(F.col("code") == stage).groupBy("entity_id")
            .agg(F.min_by(F.struct(*cols), "id").alias("v"))
            .select("entity_id", F.col("v.made_at").alias("in_at"),
                    *[F.col("v." + c).alias(c) for c in cols[1:]]))


def first_at(history: DataFrame, code: int, name: str) -> DataFrame:
    return history.filter(F.col("code") == code).groupBy("entity_id").agg(
        F.min("made_at").alias(name))


def stage_dwell(history: DataFrame, stage: int) -> DataFrame:
    """Total seconds in a stage and number of visits per entity."""
    left = with_next(history).filter(F.col("code") == stage)
    return left.groupBy("entity_id").agg(
        F.sum(boundary_diff("second", "made_at", "next_at")).alias("in_stage_seconds"),
        F.count(F.lit(1)).alias("visits"))


def flow_label(team: str, field: str, dropped: str) -> Column:
    return (F.when(F.col("item_code").isNotNull() & ~F.col("printed"), team)
            .when(F.col("item_code").isNotNull() & F.col("printed"), field)
            .when(F.col("deleted"), dropped))


def verification_items(history: DataFrame, custom_items: DataFrame, stage: int,
                       accepted: int) -> DataFrame:
    """Items of entities that visited a stage, created before the first acceptance."""
    visit = first_visit(history, stage).select("entity_id", "in_at", "out_at")
    ok = first_at(history, accepted, "first_accepted_at")
    return (custom_items.join(visit, "entity_id").join(ok, "entity_id", "left")
            .filter(F.col("first_accepted_at").isNull()
                    | (F.col("created_at") < F.col("first_accepted_at")))
            .select("item_row", "entity_id", "item_code", "created_at", "first_accepted_at",
                    "in_at", "out_at", flow_label("TeamMapped", "FieldMapped", "Deleted")
                    .alias("flow"),
                    boundary_diff("second", "in_at", "out_at").alias("in_stage_seconds")))


def stage_item_detail(history: DataFrame, custom_items: DataFrame, catalog: DataFrame, deletions: DataFrame,
                      people: DataFrame, stage: int, year: int, markers: Mapping[str, str]) -> DataFrame:
    """Items with the first stage visit after their creation, the times noted in it, and who deleted them why."""
    visits = with_next(history).filter(F.col("code") == stage).select(
        "entity_id", "id", F.col("made_at").alias("in_at"), F.col("next_at").alias("out_at"),
        "remark")
    met = asof(custom_items, visits, ["entity_id"], "created_at", "in_at",
               ["in_at", "out_at", "remark"], side="after").filter(F.col("in_at").isNotNull())
    known = catalog.select("item_code", F.col("created_at").alias("listed_at"))
    listed = met.join(known, "item_code", "left").join(deletions, "item_row", "left").join(people, "person", "left")
    created, listed_on = F.to_date("created_at"), F.to_date("listed_at")
    return listed.select(
        "item_row", "entity_id", "item_code", "created_at", "updated_at", "in_at", "out_at",
        "printed", "deleted", "delete_reason", "deleted_at", "deleted_by", "deleted_by_role",
        F.when(created <= listed_on, "aNewly Mapped").when(created > listed_on, "bAlready Mapped")
        .otherwise("cDeleted").alias("mapping"),
        flow_label("cTeamMapped", "aFieldMapped", "bDeleted").alias("flow"),
        boundary_diff("second", "in_at", "out_at").alias("in_stage_seconds"),
        *[note_time(F.col("remark"), mark, year).alias(name) for name, mark in markers.items()])


def latest_status(history: DataFrame, labels: Mapping[int, str], other: str) -> DataFrame:
    label = F.lit(other)
    for code, text in labels.items():
        label = F.when(F.col("last_code") == code, text).otherwise(label)
    return history.groupBy("entity_id").agg(
        F.max_by("code", "id").alias("last_code"), F.max_by("owner", "id").alias("last_owner"),
        F.max("made_at").alias("last_at"), F.min("made_at").alias("placed_at")
    ).withColumn("order_status", label)


def stage_order_summary(detail: DataFrame, dwell: DataFrame, status: DataFrame) -> DataFrame:
    """One row per entity: time in stage and the best label over its items."""
    return (detail.join(dwell, "entity_id", "left").join(status, "entity_id", "left")
            .groupBy("entity_id", "placed_at", "visits", "order_status", "in_stage_seconds")
            .agg(F.count("item_code").alias("custom_items"),
                 F.min("mapping").alias("mapping"), F.min("flow").alias("flow"),
                 F.min(F.col("deleted").cast("int")).alias("all_deleted"))
            .withColumn("in_stage_minutes", F.col("in_stage_seconds") / 60)
            .withColumn("in_stage_hours", F.col("in_stage_seconds") / 3600)
            .drop("in_stage_seconds"))


def cancelled_from_stage(history: DataFrame, stage: int, cancelled: int) -> DataFrame:
    """Entities cancelled straight from a stage."""
    return with_next(history).filter(
        (F.col("code") == stage) & (F.col("next_code") == cancelled)).select("entity_id").distinct()


def stage_order_final(detail: DataFrame, history: DataFrame, dwell: DataFrame, status: DataFrame,
                      lines: DataFrame, stage: int, cancelled: int,
                      dims: Sequence[str] = ()) -> DataFrame:
    """The summary with flow, outcome in the stage, live or closed, and all line items counted."""
    in_stage = cancelled_from_stage(history, stage, cancelled).withColumn("_in", F.lit(True))
    kept = (F.when(F.col("deleted"), "bDeleted")
            .when(F.col("item_code").isNotNull(), "aMapped&Retained"))
    flow = F.when(F.col("printed"), "aField").otherwise("bTeam")
    live = (F.when((F.col("last_code") == cancelled) & F.col("_in"),
                   F.when(F.col("printed"), "aInField").otherwise("bInTeam")).otherwise(kept))
    total = lines.groupBy("entity_id").agg(F.count_distinct("item_row").alias("total_items"))
    rows = (detail.join(status, "entity_id", "left").join(in_stage, "entity_id", "left")
            .withColumn("_in", F.coalesce("_in", F.lit(False))))
    agg = rows.groupBy("entity_id", "placed_at", "order_status", "last_owner").agg(
        F.count_distinct("item_row").alias("custom_items"), F.min("mapping").alias("mapping"),
        F.min(flow).alias("flow"), F.min(kept).alias("action"),
        F.min(F.when(F.col("updated_at") > F.col("last_at"), "aClosed").otherwise("bLive"))
        .alias("flow_status"),
        F.min(live).alias("in_stage_action"),
        F.max(F.when(F.col("deleted"), 0).otherwise(1)).alias("retained"))
    return (agg.join(dwell, "entity_id", "left").join(total, "entity_id", "left")
            .withColumn("reason", F.when(F.col("order_status") != "Under Process",
                                         F.concat(F.lit("R"), F.col("last_owner").cast("string"))))
            .withColumn("in_stage_minutes", F.col("in_stage_seconds") / 60)
            .withColumn("in_stage_hours", F.col("in_stage_seconds") / 3600)
            .drop("last_owner"))


def repeat_new_items(detail: DataFrame, lines: DataFrame, outcomes: DataFrame, dwell: DataFrame) -> DataFrame:
    """Per entity, how often the items it introduced were ordered by other entities, and how those ended.

    `outcomes` gives each entity's time of placing and its outcome: won, closed
    or open. Items keep one row per buyer. What buyers of an item add up to is
    counted per item and summed over an entity's items; distinct buyers need the
    buyers of a set of items only where an entity introduced several items, once
    for all entities with that set. An entity buys what it introduces, which is
    taken off again.
    """
    fresh = checkpointed(detail.filter("mapping = 'aNewly Mapped' and item_code is not null")
                         .groupBy("entity_id", "item_code")
                         .agg(F.max(F.when(F.col("deleted"), 0).otherwise(1)).alias("retained")))
    ends = outcomes.select("entity_id", "outcome")
    # both are read several times
    bought = checkpointed(lines.filter("item_code is not null").groupBy("entity_id", "item_code").agg(
        F.max(F.when(F.col("deleted"), 0).otherwise(1)).alias("kept")).join(ends, "entity_id", "left"))
    kinds = {"won_lines": "won", "closed_lines": "closed", "open_lines": "open"}
    is_ = lambda kind: F.when(F.col("outcome") == kind, 1).otherwise(0)
    per = bought.groupBy("item_code").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("kept").alias("_kept"),
        *[F.sum(is_(kind)).alias("_" + name) for name, kind in kinds.items()])
    own = checkpointed(fresh.join(bought, ["entity_id", "item_code"]).join(per, "item_code").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("new_items"), F.max("retained").alias("retained"), F.max("kept").alias("_own"),
        F.sum(F.col("_n") - 1).alias("_n"), F.sum(F.col("_kept") - F.col("kept")).alias("_kept"),
        *[F.sum(F.col("_" + name) - is_(kind)).alias(name) for name, kind in kinds.items()]))
    several = checkpointed(fresh.join(own.filter("new_items > 1").select("entity_id", "_own"), "entity_id")
                           .groupBy("entity_id", "_own").agg(F.sort_array(F.collect_set("item_code")).alias("_items")))
    met = distinct_in_unions(several, bought.withColumn("_is_kept", F.col("kept") == 1), "_items", "item_code", "entity_id",
                             "_is_kept", ("_buyers", "_keepers"))
    met = several.join(met, "_items").select(
        "entity_id", (F.col("_buyers") - 1).alias("_buyers"), (F.col("_keepers") - F.col("_own")).alias("_keepers"))
    one = F.col("new_items") == 1
    count = lambda own, all_: F.when(one, F.col(own)).otherwise(F.coalesce(F.col(all_), F.lit(0)))
    return (own.join(met, "entity_id", "left").join(outcomes.select("entity_id", "placed_at"), "entity_id", "left")
            .select("entity_id", "placed_at", "new_items", "retained", count("_n", "_buyers").alias("times_ordered"),
                    count("_kept", "_keepers").alias("times_ordered_and_retained"), *kinds)
            .join(dwell, "entity_id", "left"))


def dwell_percentiles(summary: DataFrame, dims: Sequence[str], probs: Mapping[str, float],
                      value: str = "in_stage_seconds") -> DataFrame:
    """Count, mean and exact percentiles of hours in stage per group."""
    base = summary.groupBy(*dims).agg(
        F.count("flow").alias("orders"), F.avg(value).alias("_avg"))
    pct = exact_percentiles(summary, dims, value, probs)
    cond = F.lit(True)
    for d in dims:
        cond = cond & F.col("b." + d).eqNullSafe(F.col("p." + d))
    return (base.alias("b").join(pct.alias("p"), cond, "left")
            .select(*[F.col("b." + d).alias(d) for d in dims], "orders",
                    (F.col("_avg") / 3600).alias("avg_hours"),
                    *[(F.col(n) / 3600).alias(n) for n in probs]))


def dwell_by_group(history: DataFrame, groups: Mapping[int, str], other: str) -> DataFrame:
    """Minutes per entity and group of statuses."""
    label = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return (with_next(history)
            .groupBy("entity_id", F.coalesce(label[F.col("code")], F.lit(other)).alias("bucket"))
            .agg(F.sum(boundary_diff("second", "made_at", "next_at")).alias("seconds"))
            .withColumn("minutes", F.col("seconds") / 60))


def stage_visit_audit(program: DataFrame, history: DataFrame, items: DataFrame,
                      answered: DataFrame | None, stage: int, confirmed: int, labels: Mapping,
                      match: str = "prescribed", minimal: bool = False) -> DataFrame:
    """First stage visit per program entity with its items before, during and after it.

    `match` prescribed counts answers inside the visit; digitised counts items
    whose answer came no later than the status after next.
    """
    visit = first_visit(history, stage)
    ok = first_at(history, confirmed, "confirmed_at")
    base = (program.join(visit, "entity_id", "left").join(ok, "entity_id", "left"))
    slim = base.select("entity_id", "in_at", "out_at", "confirmed_at", "next2_at")
    it = items.join(slim, "entity_id")
    before = ((~F.col("deleted") & (F.col("created_at") < F.col("out_at")))
              | (F.col("deleted") & (F.col("deleted_at") > F.col("out_at"))))
    after = ~F.col("deleted") | (F.col("deleted_at") > F.col("confirmed_at"))
    counts = it.groupBy("entity_id").agg(
        F.count_distinct(F.when(before, F.col("item_code"))).alias("items_before"),
        F.count_distinct(F.when(after, F.col("item_code"))).alias("items_after"))
    if match == "prescribed":
        during = answered.join(slim, "entity_id").filter(
            F.col("answered_at").between(F.col("in_at"), F.col("out_at")))
        mid = during.groupBy("entity_id").agg(F.count_distinct("item_code").alias("items_during"))
        extra = "items_during"
    else:
        seen = answered.groupBy("entity_id", "item_code").agg(F.min("answered_at").alias("a"))
        mid = (it.filter(before).join(seen, ["entity_id", "item_code"])
               .filter(F.col("a") <= F.col("next2_at")).groupBy("entity_id")
               .agg(F.count(F.lit(1)).alias("items_catered")))
        extra = "items_catered"
    out = base.join(counts, "entity_id", "left").join(mid, "entity_id", "left")
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    straight = (F.col("source") == 6) | (
        (F.col("source") == 7) & ((F.col("prev_code") == 1) | F.col("prev_code").isNull()))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("items_before", extra, "items_after")]
    cols = ["entity_id", F.col("in_at").alias("first_in_at"), F.col("out_at").alias("first_out_at"),
            F.coalesce(label[F.col("last_code")], F.lit("under process")).alias("latest_status"),
            F.when(F.coalesce(F.col("next_code") == confirmed, F.lit(False)), 1).otherwise(0)
            .alias("skipped_flag"),
            F.when(F.col("confirmed_at").isNotNull(), 1).otherwise(0).alias("confirmed_flag")]
    if not minimal:
        # what else is known of the case: who saw it, and marks that arrive with the program rows
        cols += ["confirmed_at", F.when(F.coalesce(straight, F.lit(False)), 1).otherwise(0)
                 .alias("straight_flag"), "staff_name",
                 *[F.when(F.coalesce(F.col(c), F.lit(False)), 1).otherwise(0).alias(f"{c}_flag")
                   for c in ("prescribed", "custom", "comment", "call_request", "issue", "staff_comment", "infusion")]]
    return out.select(*cols, *zero)


def direct_entries(program: DataFrame, history: DataFrame, stage: int, from_code: int,
                   source: int) -> DataFrame:
    """Program rows with a flag for those whose first stage visit came straight from a status."""
    visit = first_visit(history, stage).select("entity_id", "prev_code")
    hit = (F.col("source") == source) & (F.col("prev_code") == from_code)
    return program.join(visit, "entity_id", "left").withColumn(
        "affected", F.coalesce(hit, F.lit(False)))


def direct_entry_monthly(*args, **kwargs) -> DataFrame:
    rows = direct_entries(*args, **kwargs)
    return rows.groupBy(F.year("placed_at").alias("year"), F.month("placed_at").alias("month")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count(F.when(F.col("affected"), 1)).alias("affected_orders"))


def direct_entry_list(*args, **kwargs) -> DataFrame:
    return (direct_entries(*args, **kwargs).filter("affected").select("entity_id", "placed_at")
            .distinct().orderBy("placed_at", "entity_id"))


def _not_first(name: str) -> Column:
    return (F.col(name) != 1) | F.col(name).isNull()


def reentry_instances(history: DataFrame, status: int, groups: Mapping[int, str], as_of: str,
                      skip_after: Sequence[int]) -> DataFrame:
    """Returns to a status, leaving out first visits and first returns from some statuses.

    Only entities with a return on the day before `as_of` are kept.
    """
    seq = steps(history).shift({"prev_code": ("code", -1), "prev_at": ("made_at", -1)})
    firsts = {f"_n{c}": F.coalesce(F.col("prev_code") == c, F.lit(False)) for c in skip_after}
    seq.number_where({**firsts, "_visit": F.col("code") == status})
    again = F.col("code") == status
    for name in [*firsts, "_visit"]:
        again = again & _not_first(name)
    seq.number_where({"instance": again})
    label = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    rows = seq.frame().filter("instance is not null").select(
        "entity_id", "prev_code", "prev_at", "made_at", "instance", "owner",
        label[F.col("prev_code")].alias("responsible")).filter("responsible is not null")
    yesterday = F.date_sub(F.to_date(moment(as_of)), 1)
    recent = rows.filter(F.to_date("made_at") == yesterday).select("entity_id").distinct()
    return rows.join(recent, "entity_id", "left_semi")


def reentry_summary(history: DataFrame, status: int, groups: Mapping[int, str],
                    names: Mapping[int, str], as_of: str, skip_after: int) -> DataFrame:
    """Returns by responsible function and previous status, on the day before and in all."""
    today = F.to_date(moment(as_of))
    past = history.filter(F.to_date("made_at") < today)
    hit = past.filter((F.col("code") == status)
                      & (F.to_date("made_at") == F.date_sub(today, 1))).select("entity_id").distinct()
    seq = steps(past.join(hit, "entity_id", "left_semi")).shift({"prev_code": ("code", -1)})
    seq.number_where({"_visit": F.col("code") == status,
                      "_n": (F.col("code") == status)
                      & F.coalesce(F.col("prev_code") == skip_after, F.lit(False))})
    rows = seq.frame().filter((F.col("code") == status) & (F.col("_visit") != 1)
                              & _not_first("_n"))
    group = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    recent = F.to_date("made_at") == F.date_sub(today, 1)
    return rows.groupBy(group[F.col("prev_code")].alias("responsible"),
                        name[F.col("prev_code")].alias("status_before")).agg(
        F.count_distinct(F.when(recent, F.col("entity_id"))).alias("same_day_orders"),
        F.count(F.when(recent, 1)).alias("same_day_instances"),
        F.count(F.lit(1)).alias("total_instances"))


def function_health(orders: DataFrame, dwell: DataFrame, buckets: Mapping[str, str], as_of: str,
                    days: int, dims: Sequence[str]) -> DataFrame:
    """Dwell per function pivoted to columns, promise kept or not, and value, per date and dims."""
    wide = dwell.groupBy("entity_id").agg(
        *[F.sum(F.when(F.col("bucket") == label, F.col("seconds"))).alias(short)
          for label, short in buckets.items()])
    today = F.to_date(moment(as_of))
    due, done = F.to_date("due_at"), F.to_date("done_at")
    inside = lambda d: d.between(F.date_sub(today, days), F.date_sub(today, 1))
    kept = orders.filter(F.coalesce(inside(due), F.lit(False))
                         | F.coalesce(inside(done), F.lit(False)))
    promise = (F.when(due == done, "2) On Committed").when(due > done, "1) Before Committed")
               .when(due < done, "3) After Committed").otherwise("4) NA"))
    rows = kept.join(wide, "entity_id", "left").select(
        F.to_date("placed_at").alias("placed_date"), F.coalesce(done, due).alias("delivery_date"),
        promise.alias("delivery_status"), *dims, "value", "lines", "lines_delivered", *buckets.values())
    return rows.groupBy("placed_date", "delivery_date", "delivery_status", *dims).agg(
        *[(F.sum(s) / 60).alias(f"total_{s}") for s in buckets.values()],
        *[F.count(s).alias(f"count_{s}") for s in buckets.values()],
        F.sum("lines").alias("total_lines"), F.sum("lines_delivered").alias("total_lines_delivered"),
        F.sum("value").alias("total_value"), F.count(F.lit(1)).alias("order_count"))


def snapshot_at(history: DataFrame, stage: int, at: str) -> DataFrame:
    """Entities whose stay in a stage covers an instant, with that stay."""
    now = moment(at)
    stays = with_next(history).filter(
        (F.col("code") == stage) & now.between(F.col("made_at"), F.col("next_at")))
    return stays.groupBy("entity_id").agg(F.min("made_at").alias("in_at"),
                                          F.max("next_at").alias("out_at"))
