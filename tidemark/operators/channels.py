"""Customers who order through more than one channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.timefn import epoch
from tidemark.operators.ordered import KeyedSequence, id_lane

ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]
DONE = (9, 10)


def _done():
    return F.col("status").isin(*DONE)


def order_gap(orders: DataFrame, phone: str, web: Sequence[str],
              eligible: DataFrame | None = None) -> DataFrame:
    """Mean hours between consecutive fulfilled orders of customers using both channels.

    Hour boundaries between neighbours add up to the boundaries between the
    first and the last order, so an aggregate replaces the window.
    """
    kept = orders.filter(_done() & F.col("channel").isin(phone, *web))
    if eligible is not None:
        kept = kept.join(eligible, "customer_id", "left_semi")
    hour = F.floor(epoch("placed_at") / 3600)
    per = kept.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max(hour) - F.min(hour)).alias("span"),
        F.max(F.col("channel") == phone).alias("phone"),
        F.max(F.col("channel").isin(*web)).alias("web"))
    return per.filter("phone and web").select(
        "customer_id", F.try_divide("span", F.col("n") - 1).alias("order_frequency_in_hours"))


def channel_sequence(orders: DataFrame, phone: str, web: Sequence[str], exclude: Sequence[str],
                     n: int = 8, eligible: DataFrame | None = None) -> DataFrame:
    """Counts by channel and the channels of the first `n` fulfilled orders per customer."""
    kept = orders.filter(_done() & F.col("channel").isNotNull())
    if eligible is not None:
        kept = kept.join(eligible, "customer_id", "left_semi")
    on_phone = F.col("channel") == phone
    counts = kept.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count(F.when(on_phone, 1)).alias("phone_orders"),
        F.count(F.when(~on_phone, 1)).alias("web_orders"),
        F.max(F.col("channel").isin(*web)).alias("_web"),
        F.max(F.col("channel").isin(*exclude)).alias("_bad"))
    users = counts.filter((F.col("phone_orders") > 0) & F.col("_web") & ~F.col("_bad")).drop(
        "_web", "_bad")
    # a row_number limit is cut per map task before the shuffle, so a hot customer sends few rows
    w = Window.partitionBy("customer_id").orderBy("placed_at", "order_id")
    head = kept.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    bucket = F.when(on_phone, "PHONE").otherwise("WEB")
    wide = head.groupBy("customer_id").agg(
        *[F.max(F.when(F.col("k") == i + 1, bucket)).alias(f"{ORDINALS[i]}_order_source")
          for i in range(n)])
    return users.join(wide, "customer_id")


def _journey(prefix: str, number: str, phone_number: str, n: int):
    pick = [F.min(F.when(F.col(number) == i + 1, F.col("bucket")))
            .alias(f"{prefix}{ORDINALS[i]}_source") for i in range(n)]
    after = [F.min(F.when(F.col(phone_number) == i + 1, F.col("bucket")))
             .alias(f"{prefix}phone_{ORDINALS[i]}_source") for i in range(n)]
    start = F.col(phone_number) == 1
    return [F.max(F.when(start, 1).otherwise(0)).alias(f"{prefix}used_phone"),
            F.min(F.when(F.col(number) == 1, F.col("placed_at"))).alias(f"{prefix}first_at"),
            F.max_by("placed_at", F.when(F.col(number).isNotNull(), F.col(number)))
            .alias(f"{prefix}last_at"),
            F.min(F.when(start, F.col(number))).alias(f"{prefix}number_of_first_phone"),
            F.min(F.when(start, F.col("placed_at"))).alias(f"{prefix}phone_first_at"),
            *pick, *after]


def channel_migration(orders: DataFrame, customers: DataFrame, phone: str,
                      exclude: Sequence[str], basis: str = "placed", min_orders: int = 6,
                      n: int = 6) -> DataFrame:
    """Channels of the first orders, overall and from the first phone order on, per customer.

    `basis` placed numbers all orders, fulfilled only fulfilled ones, both gives
    the two side by side for customers with a phone order.
    """
    shunned = orders.filter(F.col("channel").isin(*exclude) | F.col("channel").isNull())
    on_phone = F.col("channel") == phone
    first = orders.groupBy("customer_id").agg(
        F.min(F.when(on_phone, F.col("placed_at"))).alias("_phone_at"),
        F.min(F.when(on_phone & _done(), F.col("placed_at"))).alias("_phone_done_at"))
    kept = (orders.join(shunned.select("customer_id").distinct(), "customer_id", "left_anti")
            .join(customers, "customer_id").join(first, "customer_id"))
    from_at = F.col("_phone_done_at") if basis == "both" else F.col("_phone_at")
    seq = KeyedSequence(kept, ["customer_id"], [F.col("order_id")], id_lane("order_id"))
    seq.number_where({
        "placed_no": F.lit(True),
        "placed_phone_no": F.coalesce(F.col("placed_at") >= F.col("_phone_at"), F.lit(False)),
        "done_no": _done(),
        "done_phone_no": F.coalesce(_done() & (F.col("placed_at") >= from_at), F.lit(False))})
    numbered = seq.frame().withColumn("bucket", F.when(on_phone, "PHONE").otherwise("WEB"))
    stats = []
    if basis in ("placed", "both"):
        stats += _journey("placed_", "placed_no", "placed_phone_no", n)
    if basis in ("fulfilled", "both"):
        stats += _journey("done_", "done_no", "done_phone_no", n)
    out = numbered.groupBy("customer_id", "acquired").agg(
        F.count(F.lit(1)).alias("orders_placed"),
        F.count(F.when(_done(), 1)).alias("orders_fulfilled"),
        F.count(F.when(on_phone, 1)).alias("phone_orders"),
        F.count(F.when(on_phone & _done(), 1)).alias("phone_orders_fulfilled"), *stats)
    if basis == "both":
        return out.filter("phone_orders > 0")
    limit = F.col("orders_placed" if basis == "placed" else "orders_fulfilled") >= min_orders
    return out.filter(limit)
