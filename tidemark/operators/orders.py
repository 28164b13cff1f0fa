"""Order-level analytics: wide rows with flags, baskets, funnels, validation, matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.textfn import delimited_id
from tidemark.functions.timefn import boundary_diff, moment
from tidemark.operators.ordered import alone, first_by, hour_lane, key_buckets, row_numbers

DONE = (9, 10)
#: orders that a group of customers holds on average, where customers are counted by groups
ORDER_ROWS = 1 << 16


def done() -> Column:
    return F.col("status").isin(*DONE)


def lookup(mapping: Mapping, column: Column) -> Column:
    """A small fixed code map as a literal, so no join is needed."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[column]


def flag(column: Column) -> Column:
    return F.when(F.coalesce(column, F.lit(False)), 1).otherwise(0)


def between_days(column: str, start: str, end: str) -> Column:
    return F.to_date(F.col(column)).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def key_flags(rows: DataFrame, key: str, code: str, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """One row per key with a 0/1 column per group of codes, in one pass over the flag table."""
    wanted = [c for codes in groups.values() for c in codes]
    return (rows.filter(F.col(code).isin(*wanted)).groupBy(key)
            .agg(*[F.max(flag(F.col(code).isin(*codes))).alias(name)
                   for name, codes in groups.items()]))


def order_wide(orders: DataFrame, flags: DataFrame, items: DataFrame, customer_flags: DataFrame,
               geo: DataFrame, subs: DataFrame, tasks: DataFrame, groups: Mapping,
               channels: Mapping[str, str], web: Sequence[str], start: str, end: str) -> DataFrame:
    """Fulfilled orders with presence flags, channel bucket and ordinals per customer and phone."""
    kept = orders.filter(between_days("placed_at", start, end) & done())
    names = list(groups)
    marks = key_flags(flags, "order_id", "flag_id", groups)
    free = items.groupBy("order_id").agg((F.max(flag(F.col("needs_rx"))) == 0).alias("_free"))
    own = customer_flags.select("customer_id").distinct().withColumn("_chronic", F.lit(True))
    refill = subs.groupBy("order_id").agg(
        F.max(F.col("order_id") != F.col("template_order_id")).alias("_refill"))
    queued = tasks.select("order_id").distinct().withColumn("_queued", F.lit(True))
    wide = (kept.join(marks, "order_id", "left").join(free, "order_id", "left")
            .join(own, "customer_id", "left").join(refill, "order_id", "left")
            .join(queued, "order_id", "left").join(geo, "customer_id", "left"))
    cart = F.coalesce(F.col("cart_flag"), F.lit(0)) == 1
    refilled = F.coalesce(F.col("_refill"), F.lit(False))
    cols = wide.select(
        "order_id", "customer_id", "phone", F.col("placed_at").alias("placed_time"), "value", "city",
        "hub", flag(F.col("carrier")).alias("courier_flag"), F.col("channel").alias("platform"),
        lookup(channels, F.col("channel")).alias("source"),
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names],
        flag(F.col("_chronic")).alias("customer_chronic_flag"),
        flag(cart & F.col("_free")).alias("cart_without_rx_flag"),
        flag(F.col("_queued") & ~cart & ~refilled & F.col("channel").isin(*web)).alias("upload_flag"),
        flag(refilled).alias("refill_flag"),
        flag(F.col("_refill").isNotNull()).alias("subscription_flag"))
    # every joined side has one row per key, so an order still has one row
    order = [F.col("placed_time"), F.col("order_id")]
    lane = hour_lane("placed_time")
    return row_numbers(row_numbers(cols, ["customer_id"], order, lane, "customer_order_number"),
                       ["phone"], order, lane, "phone_order_number")


def any_flags(log: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """How far each key got in the log, with further aggregates of the same pass."""
    kind = F.col("log_type")
    return log.groupBy(*keys).agg(
        *more,
        F.min("created_at").alias("first_logged_at"), F.max(flag(kind == 1)).alias("offered"),
        F.max(flag(kind == 2)).alias("viewed"), F.max(flag(kind == 3)).alias("selected"))


def _all_small(df: DataFrame, key: str) -> bool:
    """Whether no key has so many rows that a task should not hold them whole."""
    df = df.select(key)
    return df.filter(~alone(df, [key], key_buckets(df, df.count(), ORDER_ROWS))).isEmpty()


def substitution_funnel(log: DataFrame, items: DataFrame, orders: DataFrame, reasons: Mapping,
                        start: str, end: str) -> DataFrame:
    """Per order, item and agent: how far a substitute got and what was ordered later.

    The later-order label needs only the last time the customer bought each
    item, so no pairs of orders are formed and no OR join is needed. What is
    known of an order's or a customer's items is looked up along windows over
    rows and lines laid together: where log and items come dealt by order, rows
    are sent once, by customer. Orders are counted first: if a customer has very
    many, rows are dealt by customer and item instead.
    """
    keys = ["order_id", "original", "agent"]
    inside = F.coalesce(between_days("created_at", start, end), F.lit(False))
    picked = F.coalesce(F.col("log_type") == 3, F.lit(False))
    dated = log.select(
        *keys, inside.alias("_in"), *[F.when(inside, F.col(c)).alias(n) for c, n in (
            ("created_at", "created_at"), ("log_type", "log_type"), ("substitute", "_offered"))],
        picked.alias("_picked"), F.when(picked, F.col("created_at")).alias("_at"), F.when(picked, F.col("substitute")).alias("_sub"))
    seen = any_flags(
        dated, keys, F.max("_offered").alias("offered_item"), F.bool_or("_in").alias("_in"), F.bool_or("_picked").alias("_picked"),
        F.max("_at").alias("_at"), F.when(F.max("_at").isNotNull(), F.max_by("_sub", "_at")).otherwise(F.max("_sub")).alias("_sub"))
    # the latest substitute chosen in the order, on any day
    latest = F.max(F.when(F.col("_picked"), F.struct("_at", "original", "_sub", "agent"))).over(Window.partitionBy("order_id"))
    chosen = F.col("order_id").isNotNull() & (F.col("original") == F.col("_latest.original")) & (F.col("agent") == F.col("_latest.agent"))
    rows = seen.withColumn("_latest", latest).filter("_in").select(
        *keys, "offered_item", F.when(chosen, F.col("_latest._sub")).alias("substitute"), "first_logged_at", "offered", "viewed",
        "selected", F.lit(False).alias("_line"))
    both = rows.unionByName(items.select(
        "order_id", F.col("item_id").alias("_item"), flag(~F.col("deleted")).alias("_kept"),
        F.coalesce("invoiced", F.lit(False)).alias("_sold"), F.col("returned").alias("_ret"),
        F.col("return_reason").alias("_reason"), F.lit(True).alias("_line")), allowMissingColumns=True)

    def beside(by: Sequence[str], key: str):
        """Rows by a key and lines by their item; rows without the key have no line beside them and are spread."""
        item = F.when(F.col("_line"), F.col("_item")).otherwise(F.col(key))
        return Window.partitionBy(*by, item, F.when(item.isNull(), F.pmod(F.xxhash64(*keys), F.lit(4096))))

    def lines(key: str, columns: Sequence[str], wanted: Column) -> Column:
        """Of a row, each line of its order with that item, or null if there is none; lines stay as they are."""
        usable = F.col("_line") & F.col("order_id").isNotNull() & F.col("_item").isNotNull() & wanted
        found = F.collect_list(F.when(usable, F.struct(*columns))).over(beside(["order_id"], key))
        return F.when(~F.col("_line"), found)

    both = both.withColumn("_cart", lines("offered_item", ["_kept"], F.lit(True))).withColumn("_cart", F.explode_outer("_cart"))
    both = both.withColumn("_bill", lines("substitute", ["_ret", "_reason"], F.col("_sold")))
    o = orders.select("order_id", "customer_id", "status", "placed_at")
    known = F.col("customer_id").isNotNull()
    buyer = ["customer_id", "_salt"]
    # rows without a customer are spread; of the lines those sold alone go on
    both = both.join(o, "order_id", "left").withColumn("_bill", F.explode_outer("_bill")).filter(
        ~F.col("_line") | (F.col("_sold") & F.col("_item").isNotNull() & known)).select(
        *keys, "substitute", "first_logged_at", "offered", "viewed", "selected", "_line", "_item",
        flag(F.col("_cart").isNotNull()).alias("in_cart"), F.coalesce("_cart._kept", F.lit(0)).alias("retained"),
        F.col("_bill._ret").alias("_ret"), F.col("_bill._reason").alias("return_reason"), "customer_id", "status", "placed_at",
        F.when(known, 0).otherwise(F.pmod(F.xxhash64(*keys), F.lit(4096)) + 1).cast("long").alias("_salt"))
    if _all_small(o.filter(known), "customer_id"):
        both = both.repartition(*buyer)
    bought = F.max(F.when(F.col("_line"), F.col("placed_at")))
    both = both.withColumn("sub_at", bought.over(beside(buyer, "substitute"))).withColumn(
        "orig_at", bought.over(beside(buyer, "original"))).filter(~F.col("_line"))
    last = (o.filter(known).withColumn("_salt", F.pmod(F.xxhash64("customer_id"), F.lit(1)))
            .groupBy(*buyer).agg(F.max("placed_at").alias("last_order")))
    rows = both.join(last, buyer, "left")
    later = lambda c: F.col(c) > F.col("placed_at")
    label = (F.when(later("sub_at"), "dSubstituteOrderedAgain")
             .when(later("orig_at"), "cOriginalOrderedAgain")
             .when(later("last_order"), "bNoneOrderedAgain").otherwise("aNeverOrderedAgain"))
    status = (F.when(done(), "fulfilled").when(F.col("status") == 2, "rejected")
              .when(F.col("status") == 8, "cancelled").otherwise("under process"))
    back = F.coalesce(F.col("_ret") == 1, F.lit(False))
    return rows.select(
        "order_id", "original", "agent", "substitute", status.alias("order_status"),
        "first_logged_at", "offered", "viewed", "selected",
        "in_cart", "retained", flag(back).alias("returned"),
        F.when(back, lookup(reasons, F.col("return_reason"))).alias("return_reason"),
        label.alias("reordered"))


def substitution_daily(log: DataFrame, items: DataFrame, as_of: str, kind: int) -> DataFrame:
    """Flags of one substitute kind for the day before the as-of date."""
    day = F.date_sub(F.to_date(moment(as_of)), 1)
    kept = log.filter((F.to_date("created_at") == day) & (F.col("substitute_kind") == kind))
    keys = ["order_id", "original", "agent"]
    in_cart = items.select("order_id", F.col("item_id").alias("substitute"),
                           flag(~F.col("deleted")).alias("_kept"), F.lit(1).alias("_in"))
    rows = kept.join(in_cart, ["order_id", "substitute"], "left")
    return any_flags(rows, keys, F.max(F.coalesce("_in", F.lit(0))).alias("in_cart"),
                     F.max(F.coalesce("_kept", F.lit(0))).alias("retained"))


def channel_basket(orders: DataFrame, lines: DataFrame, start: str, end: str) -> DataFrame:
    """Basket size, quantity, patients and age of the main patient, averaged per channel.

    Lines say whether they were deleted; orders whether they are chronic and
    need a prescription. Patients are averaged over the latter alone.
    """
    o = orders.filter(between_days("placed_at", start, end))
    per_order = ["order_id", "channel", "value", "chronic", "needs_rx"]
    people = (o.join(lines, "order_id", "left")
              .groupBy(*per_order, "patient_id", "age")
              .agg(F.count(F.when(~F.col("deleted"), F.col("item_id"))).alias("meds"),
                   F.count(F.when(F.col("deleted"), F.col("item_id"))).alias("deleted"), F.sum("qty").alias("qty"),
                   F.sum("gross").alias("gross"), F.sum("disc").alias("disc")))
    per = people.groupBy(*per_order).agg(
        F.sum("meds").alias("meds"), F.sum("deleted").alias("deleted"), F.sum("qty").alias("qty"),
        F.count("patient_id").alias("patients"), F.sum("gross").alias("gross"),
        F.sum("disc").alias("disc"),
        F.max_by("age", F.when(F.col("age").isNotNull(), F.struct("meds", -F.col("patient_id"))))
        .alias("main_age"))
    return per.groupBy("channel").agg(
        F.count(F.lit(1)).alias("total_orders"), F.avg("value").alias("avg_value"),
        F.try_divide(F.sum("disc"), F.sum("gross") * 100).alias("discount_share"),
        F.count(F.when(F.col("chronic"), 1)).alias("chronic_orders"),
        F.count(F.when(F.col("needs_rx"), 1)).alias("rx_orders"),
        F.avg("meds").alias("avg_line_items"), F.avg("deleted").alias("avg_deleted_items"),
        (F.sum("qty") / F.count(F.lit(1))).alias("quantity_per_order"),
        F.try_divide(F.sum("gross"), F.sum("meds")).alias("avg_product_value"),
        F.avg(F.when(F.col("needs_rx"), F.col("patients"))).alias("avg_patients"), F.avg("main_age").alias("avg_patient_age"))


def paired_channels(orders: DataFrame, lines: DataFrame, side_a: Sequence[str],
                    side_b: Sequence[str], eligible: DataFrame) -> DataFrame:
    """Customers with fulfilled orders on both sides, the sides next to each other.

    Order means weigh an order by its line items, as a join to the lines would.
    """
    o = orders.filter(done() & F.col("channel").isin(*side_a, *side_b)).join(
        eligible, "customer_id", "left_semi")
    per = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.count(F.when(~F.col("chronic"), 1)).alias("acute"))
    rows = o.join(per, "order_id", "left").withColumns({
        "w": F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)),
        "n": F.coalesce("n", F.lit(0)), "acute": F.coalesce("acute", F.lit(0))})

    def side(prefix, channels):
        on = lambda c: F.when(F.col("channel").isin(*channels), c)
        return [F.count(on(F.lit(1))).alias(f"{prefix}_orders"),
                (F.sum(on(F.col("value") * F.col("w"))) / F.sum(on(F.col("w")))).alias(f"{prefix}_value"),
                F.sum(on(F.col("n"))).alias(f"{prefix}_line_items"),
                F.sum(on(F.col("acute"))).alias(f"{prefix}_acute_items")]

    return rows.groupBy("customer_id").agg(*side("a", side_a), *side("b", side_b)).filter(
        "a_orders > 0 and b_orders > 0")


def queue_status_matrix(orders: DataFrame, flags: DataFrame, items: DataFrame, tasks: DataFrame,
                        subs: DataFrame, history: DataFrame, calls: DataFrame, cart: Sequence[int],
                        auto_user: int, start: str, end: str) -> DataFrame:
    """Orders per month by queue, called or not, and outcome."""
    o = orders.filter(between_days("placed_at", start, end))
    in_cart = key_flags(flags, "order_id", "flag_id", {"cart": cart})
    free = items.groupBy("order_id").agg((F.max(flag(F.col("needs_rx"))) == 0).alias("free"))
    firsts = subs.groupBy("subscription_id").agg(F.min("order_id").alias("first_order"))
    refill = subs.join(firsts, "subscription_id").groupBy("order_id").agg(
        F.max(F.col("order_id") > F.col("first_order")).alias("again"))
    queued = tasks.select("order_id").distinct().withColumn("queued", F.lit(True))
    auto = history.groupBy("order_id").agg(
        F.bool_and(F.col("updated_by") == auto_user).alias("all_auto"))
    called = calls.select(delimited_id(F.col("ref")).alias("order_id")).filter(
        "order_id is not null").distinct().withColumn("called", F.lit(True))
    rows = o
    for side in (in_cart, free, refill, queued, auto, called):
        rows = rows.join(side, "order_id", "left")
    carted = F.coalesce(F.col("cart") == 1, F.lit(False))
    queue = (F.when(F.col("again"), "refill")
             .when(F.col("queued"), F.when(carted, "cart").otherwise("non_cart"))
             .when(carted & F.col("free"), "no_rx"))
    state = F.when(done(), "fulfilled").when(F.col("status").isin(2, 8), "rejected")
    rows = rows.withColumns({"queue": queue, "state": state,
                             "called": F.coalesce("called", F.lit(False))})
    aggs = []
    for s in ("fulfilled", "rejected"):
        ok = F.col("state") == s
        aggs.append(F.count(F.when(F.col("queue").isNull() & ok, 1)).alias(f"blank_{s}"))
        for q in ("refill", "no_rx"):
            aggs.append(F.count(F.when((F.col("queue") == q) & ok, 1)).alias(f"{q}_{s}"))
        for q in ("cart", "non_cart"):
            for name, c in (("called", F.col("called")), ("not_called", ~F.col("called"))):
                aggs.append(F.count(F.when((F.col("queue") == q) & c & ok, 1))
                            .alias(f"{q}_{name}_{s}"))
    aggs.append(F.count(F.when(F.col("all_auto"), 1)).alias("auto_accepted"))
    return rows.groupBy(F.year("placed_at").alias("year"), F.month("placed_at").alias("month")).agg(*aggs)


def rx_validation(orders: DataFrame, lines: DataFrame, notes: DataFrame, fields: Sequence[str],
                  unit_days: Mapping[str, int], weights: Mapping[int, float], start: str,
                  end: str) -> DataFrame:
    """Per order: which prescription fields are present, shortest course in days, least dose and weight."""
    o = orders.filter(between_days("placed_at", start, end))
    rows = o.join(lines.filter("needs_rx"), "order_id").join(notes, ["order_id", "item_id"], "left")
    open_ended = F.when(F.col("chronic"), 3 * 365).otherwise(6 * 30)
    days = F.coalesce(F.col("duration") * lookup(unit_days, F.col("unit")),
                      F.when(F.col("unit").isin("lifetime", "not-mentioned"), open_ended))
    return rows.groupBy("order_id", "placed_at", "city", "hub", flag(F.col("in_program")).alias("program_flag")).agg(
        F.max(flag(F.col("unit").isNull())).alias("some_item_without_rx"),
        F.min("prescribed_at").alias("prescribed_at"),
        *[F.max(flag(F.col(f).isNotNull())).alias(f"{f}_flag") for f in fields],
        F.min(days).cast("long").alias("duration_days"),
        F.min(F.col("morning") + F.col("noon") + F.col("evening")).alias("dosage_per_day"),
        F.min(lookup(weights, F.col("frequency"))).alias("frequency_weight"))


def overdue_orders(orders: DataFrame, last_change: DataFrame, subs: DataFrame, direct: DataFrame,
                   geo: DataFrame, corporate: DataFrame, courier: DataFrame, stages: Mapping[int, str],
                   owners: Mapping[int, str], as_of: str, lag_minutes: int = 10) -> DataFrame:
    """Open orders placed noon to noon up to the as-of day, with promise, type, stage, owner and idle time.

    `corporate` and `courier` list order ids of those types; idle time runs to
    `lag_minutes` before the as-of time, the delay of the source's loading.
    """
    now = moment(as_of)
    loaded = F.timestamp_add("MINUTE", F.lit(-lag_minutes), now)
    noon = F.timestamp_add("HOUR", F.lit(12), F.to_date(now).cast("timestamp_ntz"))
    window = F.col("placed_at").between(F.timestamp_add("DAY", F.lit(-1), noon), noon)
    firsts = subs.groupBy("subscription_id").agg(F.min("order_id").alias("first_order"))
    refill = subs.join(firsts, "subscription_id").groupBy("order_id").agg(
        F.max(F.col("order_id") > F.col("first_order")).alias("again"))
    mark = lambda df, name: df.select("order_id").distinct().withColumn(name, F.lit(True))
    rows = (orders.filter(window & F.col("status").isin(*stages))
            .join(direct, "order_id", "left_anti").join(refill, "order_id", "left")
            .join(mark(corporate, "_corporate"), "order_id", "left")
            .join(mark(courier, "_courier"), "order_id", "left")
            .join(last_change, "order_id", "left").join(geo, "customer_id", "left"))
    return rows.select(
        "order_id", "placed_at", F.to_date("promised_at").alias("promised_on"), "hub",
        lookup(stages, F.col("status")).alias("current_status"),
        lookup(owners, F.col("status")).alias("responsible"),
        F.when(F.col("_corporate"), "corporate").when(F.col("again"), "refill").when(F.col("_courier"), "courier")
        .alias("order_type"),
        boundary_diff("minute", "changed_at", loaded).alias("minutes_since_change"),
        boundary_diff("hour", "changed_at", loaded).alias("hours_since_change"))


def subscription_matrix(orders: DataFrame, subs: DataFrame, dims: Sequence[str],
                        since: str) -> DataFrame:
    """Orders, value and customers per dims by delivered, refill and timeliness.

    Rows shrink to one per dims and customer first, which leaves no distinct count.
    """
    firsts = subs.groupBy("subscription_id").agg(F.min("order_id").alias("first_order"))
    s = subs.join(firsts, "subscription_id").select(
        "order_id", ((F.col("order_id") > F.col("first_order")) | F.col("clone")).alias("refill"))
    rows = orders.filter(F.col("placed_at") > moment(since)).join(s, "order_id")
    ok, refill = done(), F.col("refill")
    time = (F.when(F.col("due_on") == F.col("done_on"), "on_time")
            .when(F.col("due_on") > F.col("done_on"), "before_time").otherwise("after_time"))
    rows = rows.withColumn("_time", time)
    n = lambda c: F.count(F.when(c, 1))
    sums = {
        "total_orders": F.count(F.lit(1)), "delivered_orders": n(ok), "refill_orders": n(refill),
        "refill_delivered_orders": n(refill & ok),
        "refill_rejected_orders": n(refill & (F.col("status") == 2)),
        "refill_cancelled_orders": n(refill & (F.col("status") == 8)),
        **{f"refill_{t}_orders": n(refill & ok & (F.col("_time") == t))
           for t in ("on_time", "before_time", "after_time")},
        "refill_feedback": F.sum(F.when(refill & ok, F.col("feedback"))),
        "refill_feedbacks": F.count(F.when(refill & ok, F.col("feedback"))),
        "refill_value": F.sum(F.when(refill & ok, F.col("value"))),
        "refill_discounted_value": F.sum(F.when(refill & ok, F.col("discounted_value"))),
        "delivered_value": F.sum(F.when(ok, F.col("value"))),
        "delivered_discounted_value": F.sum(F.when(ok, F.col("discounted_value")))}
    per = rows.groupBy(*dims, "customer_id").agg(*[e.alias(k) for k, e in sums.items()])
    return per.groupBy(*dims).agg(
        *[F.sum(k).alias(k) for k in sums],
        F.count(F.lit(1)).alias("customers"),
        *[F.count(F.when(F.col(k) > 0, 1)).alias(f"customers_{k}")
          for k in ("delivered_orders", "refill_orders", "refill_delivered_orders")])


def order_phones(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each order with its contact number and the registered number of its customer."""
    return orders.select("order_id", "customer_id", F.col("phone").alias("contact_phone")).join(
        customers.select("customer_id", F.col("phone").alias("registered_phone")),
        "customer_id", "left")
