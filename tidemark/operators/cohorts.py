"""Retention and interaction cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.textfn import order_id_from_comment
from tidemark.functions.timefn import month_index
from tidemark.operators.ordered import first_by


def _month(c: str, mode: str):
    return F.month(c) if mode == "month_number" else month_index(c)


def retention_cohorts(orders: DataFrame, user: str = "customer_id", at: str = "placed_at",
                      horizon: int = 12, mode: str = "month_index") -> DataFrame:
    """Users by acquisition month and how many ordered 1..horizon months later (62 at most).

    One aggregate by user gives the first month and the set of months, which is
    a bit for each month after the first; no distinct rows, window or distinct
    count follows, only the grouping by month.
    """
    m = _month(at, mode).cast("long")
    seen = orders.groupBy(user).agg(F.min(m).alias("acquired"), F.collect_set(m).alias("months"))
    mask = F.expr(f"aggregate(months, 0L, (bits, x) -> CASE WHEN x - acquired <= {int(horizon)}"
                  " THEN bits | shiftleft(1L, cast(x - acquired as int)) ELSE bits END)")
    return seen.withColumn("mask", mask).groupBy(F.col("acquired").alias("acquisition_month")).agg(
        F.count("acquired").alias("customers_acquired"),
        *[F.count_if(F.getbit("mask", F.lit(k)) == 1).alias(f"m_{k}") for k in range(1, horizon + 1)])


def extract_order_id(df: DataFrame, comment: str = "comment", new: str = "order_id") -> DataFrame:
    return df.withColumn(new, order_id_from_comment(F.col(comment)))


def interaction_cohort(calls: DataFrame, orders: DataFrame, mode: str = "month_range",
                       horizon: int = 3) -> DataFrame:
    """Customers by month of first interaction, and how many ordered in the months after.

    `month_range` counts calendar months from the call; `month_number` compares
    bare month numbers with the month of the order the call was about.
    """
    about = extract_order_id(calls).select("call_id", "order_id", F.col("made_at").alias("call_at"))
    known = about.join(orders.select("order_id", "customer_id", "placed_at"), "order_id")
    first = first_by(known, ["customer_id"], ["call_at", "placed_at"], ["call_at", "call_id"])
    base = month_index("call_at") if mode == "month_range" else F.month("placed_at")
    active = orders.select("customer_id", _month(
        "placed_at", "month_number" if mode == "month_number" else "index").alias("m")).distinct()
    later = (first.withColumn("base", base).join(active, "customer_id")
             .groupBy("customer_id", F.month("call_at").cast("long").alias("month_of_interaction"))
             .agg(*[F.max(F.when(F.col("m") == F.col("base") + k, 1).otherwise(0)).alias(f"f{k}")
                    for k in range(1, horizon + 1)]))
    return later.groupBy("month_of_interaction").agg(
        F.count(F.lit(1)).alias("month0"),
        *[F.sum(f"f{k}").alias(f"month{k}") for k in range(1, horizon + 1)])
