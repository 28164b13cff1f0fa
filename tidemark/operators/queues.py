"""Subscription queue: task resolution, conversion, agent efficiency, loyalty matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timefn import epoch, moment, month_to_date
from tidemark.operators.intervals import covered
from tidemark.operators.ordered import (KeyedSequence, asof, band_join, hour_lane, id_lane,
                                        row_numbers)
from tidemark.operators.orders import flag, lookup

OPEN, FOLLOW_UP = 4, 5
SUCCESS = ("accept", "change-with-order", "move-to-program", "clone")
# fixed values: points an agent earns per class and action
POINTS = {
    "STC": {"accept": 7, "reject": 3, "clone": 9, "move": 8, "STC_Hold": 2, "CDD_inRange": 7,
            "CDD_other": 3},
    "SOH": {"accept": 7, "reject": 3, "clone": 9, "move": 8, "Hold_callBack": 3, "Hold_other": 1,
            "CDD_inRange": 7, "CDD_other": 3},
    "GTE": {"reject": 3, "clone": 6, "move": 5, "Hold_callBack": 2, "Hold_other": 1},
    "Refill_Details": {"move": 5, "clone": 6, "reject": 1},
    "CnR": {"Hold_callBack": 2, "Hold_other": 1},
}
POINTS_PER_EFFICIENCY = 9.6


def resolve_queue_task(tasks: DataFrame, task_log: DataFrame, actions: DataFrame, since: str,
                       hold_counts: bool = False) -> DataFrame:
    """Per opening task its first action, the follow-up task of a hold, and where it ended."""
    logged = task_log.filter(F.col("action_at") > moment(since)).groupBy("task_id").agg(
        F.max(F.col("status") == 2).alias("acted"))
    own = actions.groupBy("task_id").agg(F.max("action_name").alias("action"))
    first = (tasks.filter(F.col("type") == OPEN).join(logged, "task_id")
             .join(own, "task_id", "left")
             .select("entity_id", "task_id", F.col("created_at").alias("opened_at"),
                     F.when(F.col("acted"), F.col("action")).alias("action")))
    chain = KeyedSequence(tasks.filter(F.col("type").isin(OPEN, FOLLOW_UP)), ["entity_id"],
                          [F.col("task_id")], id_lane("task_id"))
    after = (chain.shift({"next_task": ("task_id", 1), "next_type": ("type", 1)}).frame()
             .filter((F.col("type") == OPEN) & (F.col("next_type") == FOLLOW_UP))
             .select("task_id", "next_task"))
    last = actions.groupBy(F.col("task_id").alias("next_task")).agg(
        F.max("id").alias("last_action_id"), F.max_by("action_name", "id").alias("last_action"),
        F.count(F.lit(1)).alias("n"))
    held = F.coalesce(F.col("action") == "hold", F.lit(False))
    rows = (first.join(after, "task_id", "left")
            .withColumn("next_task", F.when(held, F.col("next_task")))
            .join(last, "next_task", "left"))
    out = rows.select(
        "entity_id", "task_id", "opened_at", F.to_date("opened_at").alias("opened_on"), "action",
        "next_task", "last_action_id",
        F.when(held, F.col("next_task")).otherwise(F.col("task_id")).alias("final_task"),
        F.when(held, F.col("last_action")).otherwise(F.col("action")).alias("final_action"),
        F.when(held, F.when(F.col("last_action") == "hold", F.coalesce("n", F.lit(0)) + 1)
               .otherwise(F.coalesce("n", F.lit(0)))).alias("hold_counts"))
    return out if hold_counts else out.drop("hold_counts")


def resolved_with_subscription(resolved: DataFrame, subs: DataFrame, origin: DataFrame,
                               sub_orders: DataFrame, task_orders: DataFrame, sources: Mapping,
                               states: Mapping) -> DataFrame:
    """Resolved tasks with the subscription, its place, source and state, the order the task is for, and how many
    orders came before."""
    roots = origin.select("subscription_id", "root_id")
    numbered = row_numbers(
        sub_orders.join(roots, "subscription_id", "left")
        .withColumn("root", F.coalesce("root_id", "subscription_id")),
        ["root"], [F.col("order_id")], id_lane("order_id"), "rank")
    best = KeyedSequence(numbered, ["subscription_id"], [F.col("placed_at"), F.col("order_id")],
                         hour_lane("placed_at")).running({"rank_so_far": F.col("rank")}, "max").frame()
    seen = best.select(F.col("subscription_id").alias("entity_id"), "order_id", "placed_at",
                       "rank_so_far")
    ranked = asof(resolved, seen, ["entity_id"], "opened_at", "placed_at", ["rank_so_far"],
                  tie="order_id")
    is_clone = origin.select(F.col("subscription_id").alias("entity_id")).distinct().withColumn(
        "_clone", F.lit(True))
    has_clone = origin.select(F.col("parent_id").alias("entity_id")).distinct().withColumn(
        "_parent", F.lit(True))
    rows = (ranked.join(subs.withColumnRenamed("subscription_id", "entity_id"), "entity_id", "left")
            .join(is_clone, "entity_id", "left").join(has_clone, "entity_id", "left"))
    source = F.when(F.col("source") == 0, F.when(F.col("_clone"), "clone").otherwise("new")).otherwise(
        lookup(sources, F.col("source")))
    state = F.when(F.col("state") == 4, F.when(F.col("_parent"), "completed with clone")
                   .otherwise("completed without clone")).otherwise(lookup(states, F.col("state")))
    linked = task_orders.groupBy("task_id").agg(F.max("subscription_order_id").alias("subscription_order_id"))
    rows = rows.join(linked, "task_id", "left")
    return rows.select(*resolved.columns, "customer_id", F.col("created_at").alias("started_at"), "city",
                       F.col("hub").alias("supplier_place"), F.col("carrier").alias("courier_place"),
                       "subscription_order_id", F.coalesce("interval_days", F.lit(30)).alias("cycle_length"),
                       source.alias("subscription_source"), state.alias("current_state"),
                       F.coalesce("rank_so_far", F.lit(0)).alias("rank"))


def resolve_by_root(resolved: DataFrame, subs: DataFrame, origin: DataFrame,
                    root_since: str) -> DataFrame:
    """Resolved tasks with their root subscription, for roots started since a date."""
    start = subs.select("subscription_id", "created_at", "customer_id", "interval_days")
    rows = (resolved.join(start.withColumnRenamed("subscription_id", "entity_id"), "entity_id")
            .join(origin.select(F.col("subscription_id").alias("entity_id"), "root_id"), "entity_id")
            .join(start.select(F.col("subscription_id").alias("root_id"),
                               F.col("created_at").alias("root_started_at")), "root_id"))
    return rows.filter(F.col("root_started_at") >= moment(root_since)).select(
        *resolved.columns, "customer_id", "root_id", "root_started_at",
        F.col("created_at").alias("started_at"),
        F.coalesce("interval_days", F.lit(30)).alias("cycle_length"))


def conversion_by_cycle(by_root: DataFrame, success: Sequence[str] = SUCCESS, n: int = 5) -> DataFrame:
    """Roots entering and converting in each of their first n cycles."""
    ranked = row_numbers(by_root, ["root_id"], [F.col("opened_at"), F.col("task_id")],
                         hour_lane("opened_at"), "cycle")
    won = F.col("final_action").isin(*success)
    per_cycle = ranked.filter(F.col("cycle") <= n)
    return per_cycle.agg(
        F.count_distinct("root_id").alias("roots"),
        *[F.count(F.when(F.col("cycle") == k, 1)).alias(f"entered_{k}") for k in range(1, n + 1)],
        *[F.count(F.when((F.col("cycle") == k) & won, 1)).alias(f"converted_{k}")
          for k in range(1, n + 1)])


def _points(classes: Column, actions: Column) -> Column:
    table = {f"{c}/{a}": p for c, row in POINTS.items() for a, p in row.items()}
    return lookup(table, F.concat_ws("/", classes, actions))


def agent_efficiency(actions: DataFrame, cancels: DataFrame, changes: DataFrame,
                     sub_orders: DataFrame, system_user: int, as_of: str) -> DataFrame:
    """Actions, points and delivered orders per day, class, agent and action, month to date.

    The three logs are united as sets: an action logged twice counts once.
    """
    name, kind = F.col("action_name"), F.col("type")
    classes = F.coalesce(lookup({4: "STC", 5: "SOH", 6: "CnR", 7: "GTE"}, kind),
                         F.when(F.col("task_id").isNull(), F.lit("Refill_Details")))
    did = (F.when((name == "hold") & F.coalesce(kind == 4, F.lit(False)), "STC_Hold")
           .when((name == "hold") & (F.col("hold_reason") == 2), "Hold_callBack")
           .when(name == "hold", "Hold_other").when(name == "change-with-order", "CDD_inRange")
           .when(name == "change-without-order", "CDD_other").when(name == "move-to-program", "move")
           .otherwise(name))
    queue = (actions.select(classes.alias("class"), "entity_id", "order_id", "agent", "acted_at",
                            did.alias("action"), "delivered")
             .filter(F.col("class").isNotNull())
             .filter((F.col("class") != "Refill_Details")
                     | ~F.col("action").isin("CDD_inRange", "CDD_other"))
             .withColumn("points", _points(F.col("class"), F.col("action"))))
    none = F.lit(None).cast("long")
    undo = cancels.filter((F.col("agent") != system_user) & (F.col("agent") != F.col("cancelled_by")))
    undo = undo.select(
        F.lit("CnR").alias("class"), none.alias("entity_id"), "order_id", "agent", "acted_at",
        lookup({1: "reassign", 2: "reject", 3: "move"}, F.col("action")).alias("action"),
        F.when(F.col("action").isin(1, 3) & F.col("done"), 1).otherwise(0).alias("delivered"),
        lookup({1: 5, 2: 5, 3: 6}, F.col("action")).alias("points"))
    made = band_join(changes, sub_orders, ["entity_id"], epoch("acted_at"), epoch("created_at"), 0, 2)
    hit = made.filter((F.unix_micros(F.col("created_at").cast("timestamp"))
                       - F.unix_micros(F.col("acted_at").cast("timestamp"))).between(0, 2_000_000))
    matched = hit.select("change_id", "order_id", "done")
    moved = changes.join(matched, "change_id", "left")
    found = F.col("order_id").isNotNull()
    moved = moved.select(
        F.lit("Refill_Details").alias("class"), "entity_id", "order_id", "agent", "acted_at",
        F.when(found, "CDD_inRange").otherwise("CDD_other").alias("action"),
        F.when(found, F.when(F.col("done"), 1).otherwise(0)).alias("delivered"),
        F.when(found, 7).otherwise(1).alias("points"))
    rows = queue.unionByName(undo).unionByName(moved).distinct()
    month = rows.filter(month_to_date("acted_at", F.date_sub(F.to_date(moment(as_of)), 1)))
    out = month.groupBy(F.to_date("acted_at").alias("action_date"), "class", "agent", "action",
                        "points").agg(F.count("agent").alias("total_actions"),
                                      F.sum("delivered").alias("delivered_orders"))
    return out.withColumn("efficiency",
                          F.col("total_actions") * F.col("points") / F.lit(POINTS_PER_EFFICIENCY))


def loyalty_pairs(refills: DataFrame, refill_items: DataFrame, orders: DataFrame,
                  order_items: DataFrame, band_days: int = 10) -> DataFrame:
    """Refills with the fulfilled normal orders of the customer within the band and their overlap.

    Overlap is the larger of shared/refill items and shared/order items; codes
    of one character do not count in the denominators.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    pairs = band_join(refills, orders, ["customer_id"], day("due_on"), day("placed_on"),
                      band_days, band_days).select("refill_id", "order_id", "placed_on")
    size = lambda df, key, new: df.filter(F.length("code") > 1).groupBy(key).agg(
        F.count_distinct("code").alias(new))
    a = refill_items.select("refill_id", "code").distinct()
    b = order_items.select("order_id", "code").distinct()
    shared = (pairs.join(a, "refill_id").join(b, ["order_id", "code"])
              .groupBy("refill_id", "order_id").agg(F.count(F.lit(1)).alias("shared")))
    met = (pairs.join(shared, ["refill_id", "order_id"], "left")
           .join(size(a, "refill_id", "n_a"), "refill_id", "left")
           .join(size(b, "order_id", "n_b"), "order_id", "left")
           .withColumn("shared", F.coalesce("shared", F.lit(0))))
    ratio = F.greatest(F.try_divide("shared", "n_a"), F.try_divide("shared", "n_b"))
    return refills.join(met.select("refill_id", "order_id", "placed_on", ratio.alias("match")),
                        "refill_id", "left")


def shared_items(refills: DataFrame, refill_items: DataFrame, orders: DataFrame, order_items: DataFrame,
                 band_days: int = 10) -> DataFrame:
    """(refill_id, order_id, shared): refills and orders of a customer within the band that share an item at all.

    The join is on customer and item and within the band, so a customer of any number of refills and orders forms no
    pair that shares nothing, and its rows are dealt by item and time.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    left = refills.select("refill_id", "customer_id", "due_on").join(
        refill_items.select("refill_id", "code").distinct(), "refill_id")
    right = orders.select("order_id", "customer_id", "placed_on").join(
        order_items.select("order_id", "code").distinct(), "order_id")
    met = band_join(left, right, ["customer_id", "code"], day("due_on"), day("placed_on"), band_days, band_days)
    return met.groupBy("refill_id", "order_id").agg(F.count(F.lit(1)).alias("shared"))


def loyalty_refills(refills: DataFrame, refill_items: DataFrame, orders: DataFrame,
                    order_items: DataFrame, band_days: int = 10) -> DataFrame:
    """A row for each refill: its best match with a normal order of the customer within the band, and the latest-numbered
    such order (null without one). Whether there is an order is looked up in its band as an interval, without pairs."""
    size = lambda df, key, new: df.filter(F.length("code") > 1).groupBy(key).agg(
        F.count_distinct("code").alias(new))
    shared = shared_items(refills, refill_items, orders, order_items, band_days)
    ratio = F.greatest(F.try_divide("shared", "n_a"), F.try_divide("shared", "n_b"))
    best = (shared.join(size(refill_items, "refill_id", "n_a"), "refill_id", "left")
            .join(size(order_items, "order_id", "n_b"), "order_id", "left")
            .groupBy("refill_id").agg(F.max(ratio).alias("match")))
    at = lambda c, days: F.timestamp_add("DAY", F.lit(days), F.col(c).cast("timestamp_ntz"))
    bands = orders.select("customer_id", at("placed_on", -band_days).alias("from_at"),
                          at("placed_on", band_days).alias("to_at"), F.col("order_id").alias("_order"))
    near = covered(refills.withColumn("_due", at("due_on", 0)), bands, ["customer_id"], "_due", "from_at", "to_at",
                   {"order_id": ("max", "_order")}).drop("_due")
    return near.join(best, "refill_id", "left").withColumn(
        "match", F.when(F.col("order_id").isNotNull(), F.coalesce("match", F.lit(0.0))))


def loyalty_customers(pairs: DataFrame) -> DataFrame:
    """The best match per customer and how many of its refills were fulfilled."""
    # a refill may appear once per paired order, as does its flag in the sum: only whether it is 0 is looked at
    return pairs.groupBy("customer_id").agg(
        F.sum(flag(F.col("fulfilled"))).alias("fulfilled_refills"), F.max("match").alias("match"),
        F.count_distinct("refill_id").alias("refills"),
        F.max(F.col("order_id").isNotNull()).alias("has_order"),
        F.max_by(F.col("order_id").isNotNull(), F.struct(
            F.coalesce("match", F.lit(-1.0)), F.coalesce("order_id", F.lit(-1)))).alias("best_has_order"))


def loyalty_match(pairs: DataFrame, summary: bool = False) -> DataFrame:
    """Counts of customers without a fulfilled refill by what they ordered instead."""
    c = loyalty_customers(pairs)
    none = F.col("fulfilled_refills") == 0
    n = lambda cond: F.count(F.when(cond, 1))
    m = F.col("match")
    out = c.agg(
        F.count(F.lit(1)).alias("customers"), n(~none).alias("with_fulfilled_refill"),
        n(none).alias("without_refill"), n(none & ~F.col("best_has_order")).alias("without_any"),
        n(none & F.col("best_has_order")).alias("with_normal_order"),
        n(none & (m > 0)).alias("with_match"), n(none & (m > .75)).alias("match_76_100"),
        n(none & (m > .5) & (m <= .75)).alias("match_51_75"),
        n(none & (m > .25) & (m <= .5)).alias("match_26_50"),
        n(none & (m > 0) & (m <= .25)).alias("match_0_25"), n(none & (m == 1)).alias("match_exact"),
        F.sum("refills").alias("distinct_refills"))  # a refill has one customer
    return out if summary else out.drop("distinct_refills")


# fixed values: rows of the long report, in order
REPORT = [(1.0, "Distinct refills", "distinct_refills", False),
          (2.0, "Distinct customers", "customers", False),
          (2.5, "Customers with a fulfilled refill", "with_fulfilled_refill", True),
          (3.0, "Customers without a fulfilled refill", "without_refill", True),
          (4.0, "Without refill, no normal order in the band", "without_any", True),
          (5.0, "Without refill, a normal order in the band", "with_normal_order", True),
          (7.0, "Without refill, a normal order sharing an item", "with_match", True),
          (8.0, "Over 75% match", "match_76_100", True), (9.0, "Over 50% match", "match_51_75", True),
          (10.0, "Over 25% match", "match_26_50", True), (11.0, "Over 0% match", "match_0_25", True),
          (13.0, "Full match", "match_exact", True)]


def loyalty_report(pairs: DataFrame) -> DataFrame:
    """The counts as rows with a share of all customers."""
    wide = loyalty_match(pairs, summary=True)
    share = lambda c: F.round(F.try_divide(F.col(c) * 100, F.col("customers"))).cast("int")
    rows = F.array(*[F.struct(F.lit(no).alias("sr_no"), F.lit(text).alias("description"),
                              F.col(c).alias("count"),
                              (share(c) if pct else F.lit(None).cast("int")).alias("percent"))
                     for no, text, c, pct in REPORT])
    return wide.select(F.inline(rows))


def month_window(df: DataFrame, column: str, as_of: str, offset: int) -> DataFrame:
    """Rows of the calendar month `offset` months from the as-of date."""
    start = F.add_months(F.trunc(F.to_date(moment(as_of)), "MM"), offset)
    return df.filter(F.trunc(F.col(column), "MM") == start)
