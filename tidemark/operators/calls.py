"""Calls in the context of orders, items seen before, and who caused a wrong return.

Phone matches never form call x order pairs, and calls never meet orders on the
bare phone: order windows, and the fact that a phone has an order at all, are
intervals per phone and looked up by time in one sweep (see `intervals`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timefn import boundary_diff, epoch, moment
from tidemark.operators.intervals import covered
from tidemark.operators.ordered import KeyedSequence, alone, asof, key_buckets, spread_left
from tidemark.operators.orders import flag
from tidemark.session import checkpointed

FAR = "2100-01-01 00:00:00"
EVER = ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")
#: an order's history is short: lanes of 64 days leave most orders in one or two
HISTORY_LANE = 64 * 86400
#: actions on the orders of one bucket, about
HISTORY_ROWS = 1 << 18


def _stack(paths: Sequence[DataFrame], combine: str) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), paths)
    return rows.distinct() if combine == "union" else rows


def history_lane(c) -> Column:
    return F.floor(epoch(c) / F.lit(HISTORY_LANE))


def hold_intervals(history: DataFrame, held: int) -> DataFrame:
    """Spans in which the latest action of an order is a hold, from just after it to the next one.

    The history is read three times: hand in a written frame where it is costly.
    """
    order = [F.col("made_at"), F.col("id")]
    whole = alone(history, ["order_id"], key_buckets(history, history.count(), HISTORY_ROWS))
    short = history.filter(whole).withColumn(
        "next_at", F.lead("made_at").over(Window.partitionBy("order_id").orderBy(*order)))
    # an order of many actions is spread over time
    seq = KeyedSequence(history.filter(~whole), ["order_id"], order, history_lane("made_at"))
    rows = short.unionByName(seq.shift({"next_at": ("made_at", 1)}).frame()).filter(F.col("action") == held)
    return rows.select("order_id", F.timestamp_add("MICROSECOND", F.lit(1), "made_at").alias("hold_from"),
                       F.coalesce("next_at", moment(FAR)).alias("hold_to"))


def call_context(calls: DataFrame, paths: Sequence[DataFrame], combine: str = "union_all",
                 with_ids: bool = True, history: DataFrame | None = None,
                 held: int | None = None) -> DataFrame:
    """Flags per call: caller ever ordered, has a live order, in the program, in its live stage.

    Each path lists orders by the phone that leads to them, with columns phone,
    order_id, placed_at, closed_at, in_at, out_at, in_program. An order may give
    several live windows. With a history, also whether some program order was on
    hold at the call.
    """
    cols = ["phone", "order_id", "placed_at", "closed_at", "in_at", "out_at", "in_program"]
    spans = _stack([p.select(*cols) for p in paths], combine).withColumn(
        "program_id", F.when(F.col("in_program"), F.col("order_id")))
    pts = calls.select("call_id", F.col("caller").alias("phone"), "made_at")
    # one frame of intervals of all kinds, one lookup
    kinds = [spans.groupBy("phone").agg(F.max("order_id").alias("_any"), F.max("program_id").alias("_any_program"))
             .select("phone", moment(EVER[0]).alias("from_at"), moment(EVER[1]).alias("to_at"), "_any", "_any_program"),
             spans.select("phone", F.col("placed_at").alias("from_at"), F.col("closed_at").alias("to_at"),
                          F.col("order_id").alias("_live"), F.col("program_id").alias("_program")),
             spans.filter("in_program").select("phone", F.col("in_at").alias("from_at"),
                                               F.col("out_at").alias("to_at"), F.col("order_id").alias("_staged"))]
    found = {"any_order_id": ("max", "_any"), "live_order_id": ("max", "_live"), "live_program_order_id": ("max", "_staged")}
    found |= {"program_order_id": ("max", "_program")} if with_ids else {"any_program_id": ("max", "_any_program")}
    if history is not None:
        # dealt by order once, for the distinct rows and for the joins
        links = spans.filter("in_program and phone is not null").select("phone", "order_id").repartition("order_id").distinct()
        # the actions on these orders alone, computed once for the three that read them
        history = checkpointed(history.join(links.select("order_id").distinct(), "order_id", "left_semi"))
        began = history.groupBy("order_id").agg(F.min("made_at").alias("began_at"))
        first = links.join(began, "order_id").groupBy("phone").agg(F.min("began_at").alias("began_at"))
        kinds.append(first.select("phone", F.timestamp_add("MICROSECOND", F.lit(1), "began_at").alias("from_at"),
                                  moment(EVER[1]).alias("to_at"), F.lit(1).alias("_acted")))
        kinds.append(links.join(hold_intervals(history, held), "order_id").select(
            "phone", F.col("hold_from").alias("from_at"), F.col("hold_to").alias("to_at"),
            F.col("order_id").alias("_hold")))
        found |= {"acted": ("max", "_acted"), "hold_order_id": ("max", "_hold")}
    intervals = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    rows = covered(pts, intervals, ["phone"], "made_at", "from_at", "to_at", found)
    has = lambda c: flag(F.col(c).isNotNull())
    out = [F.col("call_id"), F.col("phone").alias("caller"), F.col("made_at"),
           has("any_order_id").alias("ordered_flag"), has("live_order_id").alias("live_order_flag"),
           has("program_order_id" if with_ids else "any_program_id").alias("program_flag"),
           has("live_program_order_id").alias("live_program_flag")]
    if with_ids:
        out += [F.col(c) for c in ("live_order_id", "program_order_id", "live_program_order_id")]
    if history is not None:
        out += [has("acted").alias("acted_flag"), has("hold_order_id").alias("on_hold_flag")]
    return rows.select(*out)


def state_before_call(context: DataFrame, history: DataFrame) -> DataFrame:
    """The last action on the live program order before the call; calls without one are kept.

    Only calls with such an order, and the history of these orders, are put in sequence.
    """
    context = checkpointed(context)  # read three times
    key = "live_program_order_id"
    wanted = context.filter(F.col(key).isNotNull()).select(key).distinct()
    past = history.select(F.col("order_id").alias("live_program_order_id"), "id",
                          F.col("made_at").alias("acted_at"), F.col("action").alias("state_before"))
    met = asof(context.filter(F.col(key).isNotNull()), past.join(wanted, key, "left_semi"), [key], "made_at", "acted_at",
               ["acted_at", "state_before"], tie="id", lane=history_lane)
    return met.unionByName(context.filter(F.col(key).isNull()), allowMissingColumns=True)


def hold_call_impact(context: DataFrame, orders: DataFrame, program: DataFrame,
                     stage: int) -> DataFrame:
    """What became of the order a customer called about while it was in the program."""
    facts = orders.select(F.col("order_id").alias("live_program_order_id"), "status", "closed_stage",
                          "cancelled_at", "closed_reason").join(
        program.select(F.col("order_id").alias("live_program_order_id"), "latest_status", "first_done_at",
                       "last_done_at", "rejection_reason", "refuse_reason"),
        "live_program_order_id", "left")
    rows = spread_left(context, facts, "live_program_order_id")
    held = F.col("on_hold_flag") == 1
    return rows.withColumns({
        "cancelled_in_stage": flag((F.col("status") == 8) & (F.col("closed_stage") == stage)),
        "minutes_wasted": F.when(held, boundary_diff("minute", "made_at", "last_done_at")),
        "minutes_to_cancel": F.when(F.col("status").isin(2, 8),
                                    boundary_diff("minute", "made_at", "cancelled_at"))})


def item_rx_base(orders: DataFrame, items: DataFrame, rx: DataFrame, custom: DataFrame,
                 start: str, end: str) -> DataFrame:
    """Order items with the prescriptions of the customer, one row each."""
    day = F.to_date("placed_at")
    kept = (orders.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
            .join(custom, "order_id", "left_anti"))
    return kept.join(items, "order_id").join(rx, "customer_id", "left").select(
        "order_id", "customer_id", "placed_at", "status", "item_id", "entered_by", "rx_count").distinct()


def flag_prefetch(base: DataFrame, seen: DataFrame) -> DataFrame:
    """Marks items the customer had on an earlier image: the first sighting decides."""
    first = seen.groupBy("customer_id", "item_id").agg(F.min("seen_at").alias("first_seen"))
    return base.join(first, ["customer_id", "item_id"], "left").withColumn(
        "prefetchable", flag(F.col("first_seen") < F.col("placed_at"))).drop("first_seen")


def prefetchable_items(base: DataFrame, seen: DataFrame) -> DataFrame:
    label = (F.when(F.col("status").isin(9, 10), "Fulfilled")
             .when(F.col("status").isin(2, 8), "Cancelled/Rejected").otherwise("Under Process"))
    return flag_prefetch(base, seen).groupBy(
        "order_id", "customer_id", "placed_at", label.alias("order_status")).agg(
        F.count("item_id").alias("line_items"),
        F.count(F.when(F.col("entered_by") == "caller", 1)).alias("entered_by_caller"),
        F.sum("prefetchable").alias("prefetchable"))


# fixed values: who entered an item, by source code
CUSTOMER_SOURCES, CARE_SOURCES, WAREHOUSE_SOURCE, PROGRAM_SOURCE = (1, 2, 3), (0, 5, 6, 7, 8, 10), 11, 4


def program_made(with_source: bool) -> Column:
    """The item was entered by the program: its image came after the order and the entry after the answer."""
    late = (F.col("image_at") > F.col("placed_at")) & (F.col("entered_at") >= F.col("answered_at"))
    if with_source:
        late = late | (F.col("source") == PROGRAM_SOURCE)
    return F.coalesce(F.col("in_program") & F.col("image").like("dp%") & late, F.lit(False))


# fixed values: who raised a return, by code
RAISED_BY = {1: "CMS", 2: "APP/Web-Customer"}


def return_attribution(returns: DataFrame, items: DataFrame, orders: DataFrame, catalog: DataFrame,
                       people: DataFrame, start: str, end: str, source4_rule: bool = False,
                       slice: str | None = None) -> DataFrame:
    """Wrong-item returns with the team that caused them, or one team's slice of them.

    A return names the invoiced, the delivered and the desired item; `people`
    gives the name and role of who raised it (where staff did) and who entered
    the item. Orders have the place, delivery, retailer, staff of the program.
    """
    day = F.to_date("raised_at")
    named = lambda key, name, *more: catalog.select(
        F.col("item_id").alias(key), F.col("name").alias(name), *more)
    person = lambda key, prefix: people.select(
        F.col("person").alias(key), F.col("name").alias(f"{prefix}_name"), F.col("role").alias(f"{prefix}_role"))
    rows = (returns.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
            .join(orders, "order_id", "left").join(items, ["order_id", "item_id"], "left")
            .join(named("item_id", "item_name"), "item_id", "left")
            .join(named("delivered_item", "delivered_name", F.col("price").alias("delivered_price")),
                  "delivered_item", "left")
            .join(named("desired_item", "desired_name"), "desired_item", "left")
            .withColumn("_raiser", F.when(F.col("raised_code") == 1, F.col("raiser")))
            .join(person("_raiser", "raised_by"), "_raiser", "left")
            .join(person("enterer", "entered_by"), "enterer", "left"))
    same = F.col("item_id") == F.col("desired_item")
    wrong = F.col("item_id") != F.col("desired_item")
    cause = F.when(F.col("desired_item").isNotNull(),
                   F.when(same, "Picker")
                   .when(F.col("source").isin(*CUSTOMER_SOURCES), "Entry-Customer")
                   .when(F.col("source") == WAREHOUSE_SOURCE, "Entry-Warehouse")
                   .when(program_made(source4_rule), "Entry-Program").otherwise("Entry-Care"))
    rows = rows.withColumns({
        "responsibility": cause,
        "raised_source": F.create_map(*[F.lit(x) for pair in RAISED_BY.items() for x in pair])[F.col("raised_code")],
        "entry_source": F.when(F.col("entered_by_name").isNull(), RAISED_BY[2]).otherwise(RAISED_BY[1])})
    base = ["order_id", "raised_at", "item_id", "delivered_item", "desired_item", "item_name", "delivered_name",
            "desired_name"]
    if slice is None:
        return rows.select(*base, "hub", "placed_at", "delivered_at", "raised_source", "raised_by_name",
                           "raised_by_role", "entry_source", "entered_by_name", "entered_by_role",
                           "source", "responsibility").dropDuplicates()
    if slice == "care":
        on_image = F.coalesce(F.col("image").like("dp%"), F.lit(False))
        early = (F.col("image_at") <= F.col("placed_at")) | (F.col("entered_at") < F.col("answered_at"))
        keep = wrong & F.col("source").isin(*CARE_SOURCES) & (
            ~F.coalesce(F.col("in_program"), F.lit(False)) | ~on_image | early)
        return rows.filter(keep).select(*base, "source", "entered_by_name", "entered_by_role").dropDuplicates()
    if slice == "program":
        keep = wrong & ~F.col("source").isin(1, 2, 3, 10) & program_made(True)
        return rows.filter(keep).select(*base, "source", "staff_category", "staff_name").dropDuplicates()
    if slice == "warehouse":
        keep = same | (wrong & (F.col("source") == WAREHOUSE_SOURCE))
        reason = F.when(same, "Picker").otherwise("Entry")
        return rows.filter(keep).groupBy(*base, "hub", "place", "retailer", "return_status", "delivered_price",
                                         reason.alias("error_reason")).agg(F.sum("qty").alias("quantity"))
    raise ValueError(f"unknown slice {slice}")


def attribution_summary(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("responsibility").agg(F.count("order_id").alias("returns"))
