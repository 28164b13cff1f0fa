"""Live and daily dashboards: hour comparison, open cases, tracker, funnel, phone orders, trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timefn import boundary_diff, epoch, moment, office_seconds
from tidemark.operators.facts import cancelled_first, staff_category
from tidemark.operators.lifecycle import first_visit, steps
from tidemark.operators.orders import done, flag, lookup
from tidemark.operators.ordered import first_by

RESPONSES = (3, 4, 5)


def category(owner: Column, groups: Mapping[str, Sequence[int]], none: str, other: str) -> Column:
    out = F.when(owner.isNull(), none)
    for label, members in groups.items():
        out = out.when(owner.isin(*members), label)
    return out.otherwise(other)


def hour_comparator(history: DataFrame, entities: DataFrame, labels: Mapping[int, str],
                    groups: Mapping, as_of: str, offsets: Sequence[int] = (0, 1, 7, 14)) -> DataFrame:
    """Actions per hour of day now, on earlier days, and on the last four same weekdays."""
    today = F.to_date(moment(as_of))
    back = F.datediff(today, F.to_date("made_at"))
    rows = history.filter(F.col("code").isin(*labels)).drop("owner").join(entities, "entity_id")
    return rows.groupBy(
        F.hour("made_at").alias("hour"), lookup(labels, F.col("code")).alias("category"),
        "segment", category(F.col("owner"), groups, "NotAssigned", "House").alias("owner_category")
    ).agg(*[F.count(F.when(back == d, 1)).alias(f"back_{d}") for d in offsets],
          F.count(F.when(back.isin(7, 14, 21, 28), 1)).alias("same_weekday_sum"),
          (F.count(F.when(back.isin(7, 14, 21, 28), 1)) / 4).alias("same_weekday_avg"))


def action_times(history: DataFrame) -> DataFrame:
    """First and last times of each kind of action per entity."""
    c, at = F.col("code"), F.col("made_at")
    on = lambda *codes: F.when(c.isin(*codes), at)
    return history.groupBy("entity_id").agg(
        F.min(on(1, 2)).alias("moved_at"), F.min(on(2)).alias("assigned_at"),
        F.min(on(*RESPONSES)).alias("first_response_at"),
        F.max(on(*RESPONSES)).alias("last_response_at"), F.min(on(4)).alias("first_done_at"),
        F.max(on(4)).alias("last_done_at"), F.max(on(3)).alias("rejected_at"),
        F.count_distinct(on(5)).alias("holds"), F.count_distinct(on(*RESPONSES)).alias("attempts"))


def second_latest(history: DataFrame, column: str, name: str) -> DataFrame:
    """A column of the second latest row per entity; the row limit is cut before the shuffle."""
    w = Window.partitionBy("entity_id").orderBy(F.col("id").desc())
    top = history.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    return top.groupBy("entity_id").agg(F.min(F.when(F.col("_n") == 2, F.col(column))).alias(name))


def open_cases(program: DataFrame, history: DataFrame, promises: DataFrame, stage: int,
               groups: Mapping, sources: Mapping[int, str]) -> DataFrame:
    """Cases now in a stage with their action times; the owner falls back to the one before."""
    owner = F.col("owner")
    prior = second_latest(history, "owner", "prior_owner")
    first_promise = first_by(promises, ["entity_id"], ["promised_on"], ["id"])
    rows = (program.filter(F.col("last_code") == stage).join(action_times(history), "entity_id")
            .join(prior, "entity_id", "left").join(first_promise, "entity_id", "left"))
    house = category(owner, groups, "", "House")
    cat = F.when(owner.isNull(), category(F.col("prior_owner"), groups, "Not Applicable", "House")
                 ).otherwise(house)
    return rows.select("entity_id", "placed_at", F.col("promised_on").alias("original_promise"),
                       flag(F.col("courier")).alias("courier_flag"), cat.alias("owner_category"), "requested_at",
                       F.col("last_code").alias("latest_action"),
                       flag(F.col("kind") == 2).alias("issue_flag"),
                       lookup(sources, F.col("source")).alias("case_source"), "moved_at", "assigned_at", "first_response_at",
                       "last_response_at", "first_done_at", "last_done_at", "rejected_at", "holds",
                       "attempts")


DAY_LABELS = {0: "today", 1: "yesterday", 2: "day_before", 7: "today_last_week",
              8: "yesterday_last_week", 14: "today_last_last_week", 15: "yesterday_last_last_week"}


def recent_actions(history: DataFrame, as_of: str, names: Mapping[int, str],
                   quiet_seconds: int = 2) -> DataFrame:
    """Actions of the compared days, without those replaced within a moment."""
    now = moment(as_of)
    seq = steps(history).shift({"next_at": ("made_at", 1)}).number("action_rank")
    gap = boundary_diff("second", "made_at", "next_at")
    age = boundary_diff("minute", "made_at", now)
    bucket = (F.when(age <= 1440, 1).when((age > 1440) & (age <= 2880), 2)
              .when((age > 11520) & (age <= 12960), 9).when((age > 21600) & (age <= 23040), 16))
    day = lookup(DAY_LABELS, F.datediff(F.to_date(now), F.to_date("made_at")))
    rows = seq.frame().select(
        "entity_id", F.col("id").alias("action_id"), lookup(names, F.col("code")).alias("action"),
        F.col("made_at").alias("changed_at"), day.alias("day_filter"), bucket.alias("hour24_filter"),
        "action_rank", gap.alias("_gap"))
    return rows.filter(((F.col("_gap") > quiet_seconds) | F.col("_gap").isNull())
                       & (F.col("day_filter").isNotNull() | F.col("hour24_filter").isNotNull())
                       ).drop("_gap")


def live_tracker(program: DataFrame, history: DataFrame, order_history: DataFrame, staff: DataFrame, stage: int,
                 cancelled: int, as_of: str, names: Mapping[int, str], states: Mapping[int, str],
                 sources: Mapping[int, str], partners: Sequence[int], done_code: int = 4, issue_type: int = 2,
                 sla_min: tuple[int, int] = (60, 120), grace: int = 40) -> DataFrame:
    """Who and what, turnaround, age so far and breach flags per case, with its recent actions.

    A case cancelled in its first stay before anyone answered, or within
    `grace` seconds of the answer, has no first response; its breach flags run
    to now. `program` has the customer, platform, place, order flags, staff id,
    source and type of the case.
    """
    now = moment(as_of)
    first = first_visit(order_history, stage).select("entity_id", "next_code", "out_at")
    won = program.filter(F.col("last_code") == done_code).groupBy("customer_id").agg(F.min("entity_id").alias("_won"))
    rows = (program.join(action_times(history), "entity_id").join(first, "entity_id", "left")
            .join(won, "customer_id", "left").join(staff, "staff", "left")
            .withColumn("_canned", cancelled_first("first_response_at", "next_code", "out_at", cancelled, grace)))
    rows = rows.withColumn("first_response_at", F.when(~F.col("_canned"), F.col("first_response_at")))
    overall = lambda e: (epoch(e) - epoch("moved_at")) / 60
    office = lambda e: office_seconds("moved_at", e) / 60
    frt = F.coalesce(office("first_response_at"), office(now))
    late = lambda e, m: F.when(e > m, 1).otherwise(0)
    number = (F.when(F.col("entity_id") == F.col("_won"), "First Successful Consultation")
              .when(F.col("entity_id") > F.col("_won"), "Repeat").otherwise("Zero Successful Consultations"))
    wide = rows.select(
        "entity_id", "customer_id", number.alias("consultation_number"), "placed_at",
        F.col("platform").alias("order_platform"), "place",
        F.coalesce(lookup(states, F.col("last_code")), F.lit("Under_Process")).alias("order_status"),
        *[flag(F.col(c)).alias(c) for c in ("new_customer", "cart", "chronic", "courier")], "staff_name",
        staff_category(F.col("staff"), partners).alias("staff_category"),
        lookup(names, F.col("last_code")).alias("final_action"),
        F.when(F.col("_canned"), 1).alias("cancelled_before_response"),
        flag(F.col("last_code") == stage).alias("in_stage"), "moved_at",
        "assigned_at", "first_response_at", "first_done_at", "last_done_at", "rejected_at", "holds",
        flag(F.col("kind") == issue_type).alias("issue_flag"), lookup(sources, F.col("source")).alias("case_source"),
        overall("last_done_at").alias("last_done_minutes"),
        office("last_done_at").alias("last_done_office_minutes"),
        overall("first_done_at").alias("first_done_minutes"),
        office("first_done_at").alias("first_done_office_minutes"),
        overall("first_response_at").alias("response_minutes"),
        office("first_response_at").alias("response_office_minutes"),
        office(now).alias("age_office_minutes"), late(frt, sla_min[0]).alias("internal_breach"),
        late(frt, sla_min[1]).alias("committed_breach"),
        F.when(F.col("first_done_at").isNotNull(), late(office("first_done_at"), sla_min[1]))
        .alias("overall_breach"))
    acts = recent_actions(history, as_of, names)
    return wide.join(acts, "entity_id", "left").filter(
        (F.col("in_stage") == 1) | F.col("action_id").isNotNull())


def program_funnel(fact: DataFrame, orders: DataFrame, answers: DataFrame, dims: Sequence[str],
                   own_reasons: Sequence[str], bounds: Sequence[int] = (30, 60, 90, 120)) -> DataFrame:
    """Totals per date, drop-off stage, response bucket, cancellation, rejection and the order's dims.

    `orders` has status, value, customer and the time and reason of a
    cancellation or rejection. A rejection for one of `own_reasons` counts as
    the office's or the customer's. A case without a status has no drop-off stage.
    """
    status, won = F.col("status"), F.col("latest_status") == 4
    drop = (F.when(won & done(), "1_Done Fulfilled").when(won, "2_Done")
            .when(F.col("first_response_at").isNotNull(), "3_Reached Out")
            .when(F.col("first_assigned_at").isNotNull(), "4_Assigned")
            .when(F.col("latest_status").isNotNull(), "5_Moved"))
    bucket, low = None, 0
    frt = F.col("response_office_minutes")
    for i, b in enumerate(bounds, 1):
        text = f"{i}) {low} to {b} mins"
        bucket = F.when(frt <= b, text) if bucket is None else bucket.when(frt <= b, text)
        low = b
    bucket = bucket.otherwise(f"{len(bounds) + 1}) > {low} mins")
    closed = F.when(status == 8, "Cancellation").when(status == 2, "Rejection")
    refused = F.when(F.col("rejection_reason").isin(*own_reasons), "Admin/User").when(
        F.col("rejection_reason").isNotNull(), "Staff")
    rows = fact.join(orders, "entity_id").join(answers, "entity_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    seconds = lambda c: F.sum(F.round(F.col(c) * 60).cast("long"))
    return rows.groupBy(
        F.to_date("placed_at").alias("placed_on"), "consultation_type", drop.alias("funnel_drop"),
        bucket.alias("response_bucket"), closed.alias("closed_bucket"), "closed_reason", "staff_category",
        F.col("order_source").alias("case_source"), "rejection_reason", refused.alias("rejection_bucket"),
        *dims).agg(
        F.count(F.lit(1)).alias("orders"), F.count("customer_id").alias("customers"), n(done()).alias("fulfilled"),
        n(status == 2).alias("rejected"), n(status == 8).alias("cancelled"),
        n(~status.isin(2, 8, 9, 10)).alias("open"), n(F.col("issue_flag") == 1).alias("issue_orders"),
        n(F.col("first_response_at").isNotNull()).alias("responded"),
        F.sum(F.when(F.col("first_response_at").isNotNull(), F.col("attempts"))).alias("attempts"),
        n(F.col("holds") > 0).alias("held_orders"), F.sum("holds").alias("holds"),
        F.sum("value").alias("value"), F.sum("answers").alias("answers"),
        F.sum(boundary_diff("minute", "first_moved_at", "closed_at")).alias("minutes_to_close"),
        n(F.col("first_done_at").isNotNull()).alias("done_orders"),
        F.sum("internal_breach").alias("internal_breaches"),
        F.sum("committed_breach").alias("committed_breaches"),
        F.sum("overall_breach").alias("overall_breaches"),
        seconds("response_office_minutes").alias("response_office_seconds"),
        seconds("first_done_office_minutes").alias("done_office_seconds"),
        seconds("last_done_office_minutes").alias("last_done_office_seconds"))


# fixed values: why an order was placed by phone, what staff did with a cancelled one
PLACEMENT = {1: "Normal Order", 2: "Replacement Order", 3: "Order Modification Requested", 4: "Health Savers",
             5: "Retention - cancelled order", 6: "Retention - App drop offs", 7: "Quantity capping", 8: "Test Order"}
CLOSING = {1: "Reassign", 2: "Reject", 3: "Move to DP"}


def phone_order_detail(orders: DataFrame, history: DataFrame, items: DataFrame, links: DataFrame, program: DataFrame,
                       closings: DataFrame, upload: int, outcomes: Mapping[int, str],
                       after_upload: Sequence[int], closed_code: int) -> DataFrame:
    """Phone orders: who placed and closed them, of what type, what followed the last upload stage, and item counts.

    `links` has when upload links were sent, `program` the program cases with
    their latest status, `closings` the log of staff's closing actions (entity,
    id, made_at, action, reason), of which the first explains an order closed
    right after its upload. The wait for an upload runs from the last link sent.
    """
    seen = steps(history).shift({"next_code": ("code", 1), "next_at": ("made_at", 1),
                                 "next2_code": ("code", 2), "next2_at": ("made_at", 2)}).frame()
    cols = ["made_at", "next_code", "next_at", "next2_code", "next2_at"]
    last = first_by(seen.filter(F.col("code") == upload), ["entity_id"], cols, ["id"], latest=True)
    counts = items.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(~F.col("deleted"), 1)).alias("items_delivered"),
        F.count(F.when(F.col("chronic"), 1)).alias("chronic_items"),
        F.count(F.when(~F.col("deleted") & F.col("chronic"), 1)).alias("chronic_delivered"))
    sent = links.groupBy("entity_id").agg(F.max("sent_at").alias("link_sent_at"))
    cases = program.groupBy("entity_id").agg(F.max("latest_status").alias("case_status"))
    closed = closings.groupBy("entity_id").agg(
        F.min_by(F.struct("action", "reason"), "id").alias("_first"),
        F.max(F.col("action") == 3).alias("_to_program"))
    rows = (orders.join(last.drop("made_at"), "entity_id", "left").join(counts, "entity_id", "left")
            .join(sent, "entity_id", "left").join(cases, "entity_id", "left").join(closed, "entity_id", "left"))
    wait = (F.unix_micros(F.col("next_at").cast("timestamp"))
            - F.unix_micros(F.col("link_sent_at").cast("timestamp"))) / 1_000_000
    linked, is_up = F.col("link_sent_at").isNotNull(), F.col("next_code") == min(outcomes)
    bins = (F.when(wait <= 900, "Within 15 mins").when(wait <= 3600, "15mins-1hour")
            .when(wait <= 7200, "1hour-2hours").when(wait <= 10800, "2hours-3hours")
            .when(wait > 10800, ">3hours"))
    status = (F.when(done(), "Fulfilled").when(F.col("status") == 8, "Cancelled")
              .when(F.col("status") == 2, "Rejected").otherwise("Under Process"))
    case = F.col("case_status").isNotNull()
    kind = (F.when(case & ~linked, "Chose program").when(linked, "Link option chosen")
            .when(~F.col("needs_rx"), "No item needs one").when(F.col("has_image"), "Attached from previous"))
    explained = F.col("next_code").isin(*after_upload) & (F.col("next2_code") == closed_code)
    return rows.select(
        "entity_id", "customer_id", "placed_at", F.to_date("placed_at").alias("placed_on"), "value",
        F.col("segment").alias("delivery_place"), F.col("hub").alias("supplier_place"), flag(case).alias("program_flag"),
        lookup(PLACEMENT, F.col("placement")).alias("placement_reason"), "agent", "agent_role",
        status.alias("order_status"), "cancel_reason", "cancelled_by", "cancelled_by_role",
        flag(F.col("phone_customer")).alias("acquired_by_phone"), kind.alias("order_type"),
        flag(F.col("case_status") == 4).alias("program_done_flag"),
        flag(F.col("_to_program")).alias("moved_to_program_flag"), flag(F.col("refill")).alias("refill_flag"),
        "next_code", "next_at", "next2_code", "next2_at",
        F.when(linked, lookup(outcomes, F.col("next_code"))).alias("upload_outcome"), "link_sent_at",
        F.when(is_up, F.col("next_at")).alias("uploaded_at"), F.when(is_up, bins).alias("upload_bin"),
        F.when(explained, F.col("_first.reason")).alias("closing_reason"),
        F.when(explained, lookup(CLOSING, F.col("_first.action"))).alias("closing_action"), "user_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("items", "items_delivered", "chronic_items", "chronic_delivered")])


def phone_order_summary(detail: DataFrame, dims: Sequence[str], as_of: str) -> DataFrame:
    """Orders, customers, value and items of phone orders by dims, up to the day before."""
    kept = detail.filter(F.col("placed_on") < F.to_date(moment(as_of)))
    # one row per dims and customer first, which leaves no distinct count
    sums = {"orders": F.count("entity_id"), "customers": F.count("customer_id"), "value": F.sum("value"),
            **{c: F.sum(c) for c in ("items", "items_delivered", "chronic_items", "chronic_delivered")}}
    per = kept.groupBy(*dims, "customer_id").agg(*[e.alias(c) for c, e in sums.items()])
    return per.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums],
                                  F.count("customer_id").alias("distinct_customers"))


def stage_trend(orders: DataFrame, customers: DataFrame, phone: str, start: str,
                as_of: str) -> DataFrame:
    """Daily counts of placed, rejected, cancelled, delivered and of new customers, stacked.

    One pass over the orders gives the four order rows of a day.
    """
    last = F.date_sub(F.to_date(moment(as_of)), 1)
    inside = lambda c: F.to_date(c).between(F.to_date(F.lit(start)), last)
    o = orders.filter((F.col("channel") == phone) & inside("placed_at"))
    state = (F.when(F.col("status") == 2, "Rejected").when(F.col("status") == 8, "Cancelled")
             .when(done(), "Delivered"))
    placed = o.select(F.to_date("placed_at").alias("day"), F.explode(F.array_compact(F.array(
        F.lit("Placed"), state))).alias("category")).groupBy("category", "day").agg(
        F.count(F.lit(1)).alias("n"))
    c = customers.filter(inside("registered_at"))
    first = first_by(orders, ["customer_id"], ["channel", "placed_at"], ["order_id"])
    own = c.join(first, "customer_id", "left")
    by_phone = F.coalesce(F.col("channel") == phone, F.lit(False))
    soon = by_phone & (boundary_diff("minute", "registered_at", "placed_at") <= 60)
    per = own.groupBy(F.to_date("registered_at").alias("day")).agg(
        F.count(F.lit(1)).alias("a"), F.count(F.when(by_phone, 1)).alias("b"),
        F.count(F.when(soon, 1)).alias("c"))
    people = per.select("day", F.inline(F.array(*[
        F.struct(F.lit(label).alias("category"), F.col(x).alias("n")) for x, label in
        (("a", "Registered"), ("b", "Registered and Placed"), ("c", "Registered and Placed At Once"))])))
    return placed.unionByName(people)


TREND = {"Placed": "placed", "Rejected": "rejected", "Cancelled": "cancelled",
         "Delivered": "delivered", "Registered": "registered",
         "Registered and Placed": "registered_and_placed",
         "Registered and Placed At Once": "registered_and_placed_at_once"}


def stage_trend_pivot(trend: DataFrame) -> DataFrame:
    """The stacked counts as one column per category, by year and month."""
    wide = trend.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).pivot(
        "category", list(TREND)).agg(F.sum("n"))
    return wide.select("year", "month", *[F.col(f"`{k}`").alias(v) for k, v in TREND.items()])


def geo_channel_counts(orders: DataFrame, geo: DataFrame, phone: str, exclude: Sequence[str],
                       start: str, as_of: str) -> DataFrame:
    """Orders per date and place, phone against the rest, without customers of other channels."""
    shunned = orders.filter(F.col("channel").isin(*exclude) | F.col("channel").isNull()).select(
        "customer_id").distinct()
    last = F.date_sub(F.to_date(moment(as_of)), 1)
    kept = orders.filter(F.to_date("placed_at").between(F.to_date(F.lit(start)), last)).join(
        shunned, "customer_id", "left_anti").join(geo, "customer_id", "left")
    on = F.col("channel") == phone
    n = lambda c: F.count(F.when(c, 1))
    return kept.groupBy(F.to_date("placed_at").alias("placed_on"), "city_id", "city", "hub").agg(
        n(on).alias("phone_placed"), n(~on).alias("web_placed"), n(on & done()).alias("phone_done"),
        n(~on & done()).alias("web_done"))
