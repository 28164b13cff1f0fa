"""One query per scalar function group, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import textfn as tx, timefn as tm
from tidemark.plans.primitives import add
from tidemark.plans.views import EVENTS_AS_OF

c = F.col
_STEP = "SELECT id, made_at AS a, next_at AS b FROM step WHERE next_at IS NOT NULL"


def _pairs(t):
    from tidemark.operators.lifecycle import with_next
    return with_next(t.status_log).filter("next_at is not null").select(
        "id", c("made_at").alias("a"), c("next_at").alias("b"))


add("f01_dateadd", """
    SELECT event_id, ts + INTERVAL 330 MINUTE AS local_at, ts + INTERVAL 3 DAY AS later, ts - INTERVAL 1 MONTH AS month_ago FROM events""",
    lambda t: t.events.select("event_id", tm.local_ts("ts", 330).alias("local_at"),
                              F.timestamp_add("DAY", F.lit(3), "ts").alias("later"),
                              F.timestamp_add("MONTH", F.lit(-1), "ts").alias("month_ago")))
add("f02_datediff", f"""
    SELECT id, date_diff('second', a, b) AS s, date_diff('minute', a, b) AS mi, date_diff('hour', a, b) AS h,
           date_diff('day', a, b) AS d, date_diff('month', a, b + INTERVAL 40 DAY) AS mo FROM ({_STEP})""",
    lambda t: _pairs(t).select(
        "id", *[tm.boundary_diff(u, "a", "b").alias(n) for u, n in
                (("second", "s"), ("minute", "mi"), ("hour", "h"), ("day", "d"))],
        tm.boundary_diff("month", c("a"), F.timestamp_add("DAY", F.lit(40), "b")).alias("mo")))
add("f03_date", "SELECT event_id, ts::DATE AS d FROM events",
    lambda t: t.events.select("event_id", F.to_date("ts").alias("d")))
add("f04_date_trunc_month", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders",
    lambda t: t.orders.select("o_orderkey", tm.month_start("o_orderdate").alias("m")))
add("f05_last_day", "SELECT o_orderkey, last_day(o_orderdate::DATE) AS e FROM orders",
    lambda t: t.orders.select("o_orderkey", F.last_day("o_orderdate").alias("e")))
add("f06_extract", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM events",
    lambda t: t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"),
                              F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h")))
add("f07_epoch_of_interval", f"SELECT id, (epoch_us(b) - epoch_us(a)) / 60000000 AS minutes FROM ({_STEP})",
    lambda t: _pairs(t).select("id", ((F.unix_micros(c("b").cast("timestamp")) - F.unix_micros(
        c("a").cast("timestamp"))) / 60_000_000).alias("minutes")))
add("f08_datepart", "SELECT o_orderkey, date_part('day', o_orderdate) AS d, date_part('month', o_orderdate) AS m FROM orders",
    lambda t: t.orders.select("o_orderkey", F.date_part(F.lit("day"), "o_orderdate").alias("d"),
                              F.date_part(F.lit("month"), "o_orderdate").alias("m")))
add("f09_to_date", "SELECT event_id, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS d FROM events",
    lambda t: t.events.select("event_id", F.to_date(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd").alias("d")))
add("f10_as_of", "SELECT event_id, date_diff('hour', ts, TIMESTAMP '2024-01-30 12:00:00') AS hours_old FROM events",
    lambda t: t.events.select("event_id", tm.boundary_diff("hour", c("ts"), tm.moment(EVENTS_AS_OF)).alias("hours_old")))
add("f11_date_arithmetic", "SELECT o_orderkey, o_orderdate::DATE + 7 AS next_week, DATE '2001-08-01' - o_orderdate::DATE AS days_old FROM orders",
    lambda t: t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 7).alias("next_week"),
                              F.datediff(F.lit("2001-08-01").cast("date"), "o_orderdate").alias("days_old")))
add("f12_timestamp_difference", f"SELECT id, date_diff('second', a, b) AS seconds FROM ({_STEP})",
    lambda t: _pairs(t).select("id", (tm.epoch("b") - tm.epoch("a")).alias("seconds")))
add("f13_interval_comparison", f"SELECT id, b - a <= INTERVAL 15 MINUTE AS quick FROM ({_STEP})",
    lambda t: _pairs(t).select("id", ((c("b") - c("a")) <= F.expr("interval 15 minutes")).alias("quick")))
add("f14_time_of_day", "SELECT event_id, strftime(ts, '%H:%M:%S') AS tod FROM events",
    lambda t: t.events.select("event_id", tm.time_of_day("ts").alias("tod")))
add("f15_date_time_text", "SELECT event_id, (ts::DATE || ' 14:00:00')::TIMESTAMP AS due FROM events",
    lambda t: t.events.select("event_id", tm.at_time("ts", "14:00:00").alias("due")))
add("f16_left_right", "SELECT c_custkey, left(c_name, 8) AS l, right(c_name, 4) AS r FROM customer",
    lambda t: t.customer.select("c_custkey", F.left("c_name", F.lit(8)).alias("l"), F.right("c_name", F.lit(4)).alias("r")))
add("f17_substring", "SELECT call_id, substring(comment, 2, 7) AS s FROM comment_log",
    lambda t: t.comment_log.select("call_id", F.substring("comment", 2, 7).alias("s")))
add("f18_position", "SELECT call_id, position('#' IN comment) AS at_mark, position('#' IN comment) > 0 AS marked FROM comment_log",
    lambda t: t.comment_log.select("call_id", F.instr("comment", "#").alias("at_mark"),
                                   (F.instr("comment", "#") > 0).alias("marked")))
add("f19_lower_initcap", """
    SELECT p_partkey, lower(p_type) AS l, upper(left(split_part(p_name, ' ', 1), 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' '
           || upper(left(split_part(p_name, ' ', 2), 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS i FROM part""",
    lambda t: t.part.select("p_partkey", F.lower("p_type").alias("l"), F.initcap("p_name").alias("i")))
add("f20_replace_trim", "SELECT call_id, trim(replace(comment, '#', ' ')) AS s FROM comment_log",
    lambda t: t.comment_log.select("call_id", F.trim(F.replace("comment", F.lit("#"), F.lit(" "))).alias("s")))
add("f21_regexp_instr", "SELECT call_id, regexp_matches(comment, '\\D') AS has_text FROM comment_log",
    lambda t: t.comment_log.select("call_id", (F.regexp_instr("comment", F.lit("\\D")) > 0).alias("has_text")))
add("f22_length", "SELECT p_partkey, length(p_name) AS n FROM part",
    lambda t: t.part.select("p_partkey", F.length("p_name").alias("n")))
add("f23_concat", "SELECT o_orderkey, year(o_orderdate) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS ym FROM orders",
    lambda t: t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym")))
add("f24_zero_pad", "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) <= 6 THEN lpad(p_partkey::VARCHAR, 6, '0') END AS code FROM part",
    lambda t: t.part.select("p_partkey", tx.pad_code(c("p_partkey").cast("string")).alias("code")))
add("f25_json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")))
add("f26_coalesce_nullif", """
    SELECT order_id, item_id, coalesce(desired_item, 0) AS d, nullif(source, 0) AS s FROM ret""",
    lambda t: t.ret.select("order_id", "item_id", F.nvl("desired_item", F.lit(0)).alias("d"),
                           F.nullif("source", F.lit(0)).alias("s")))
add("f27_round_floor", "SELECT order_id, round(value / 100)::BIGINT AS r, floor(value / 1000)::BIGINT AS f FROM ord",
    lambda t: t.ord.select("order_id", F.round(c("value") / 100).cast("long").alias("r"),
                           F.floor(c("value") / 1000).alias("f")))
add("f28_arithmetic", "SELECT order_id, item_id, gross * 100 - disc AS net, qty * 0.2::DOUBLE + returned * 0.5::DOUBLE AS weighted FROM item",
    lambda t: t.item.select("order_id", "item_id", (c("gross") * 100 - c("disc")).alias("net"),
                            (c("qty") * 0.2 + c("returned") * 0.5).alias("weighted")))
add("f29_casts", "SELECT call_id, TRY_CAST(comment AS BIGINT) AS id, call_id::VARCHAR AS s, call_id::DOUBLE AS f FROM comment_log",
    lambda t: t.comment_log.select("call_id", c("comment").try_cast("long").alias("id"),
                                   c("call_id").cast("string").alias("s"), c("call_id").cast("double").alias("f")))
add("f30_note_fields", """
    SELECT id, note[1:position(':' IN note)] AS action, CASE WHEN position('Deleted' IN remark) > 14
           THEN TRY_CAST('2024-' || substr(remark, position('Deleted' IN remark)::BIGINT - 14, 11) || ':00' AS TIMESTAMP) END AS deleted_at FROM stage_log""",
    lambda t: t.stage_log.select("id", tx.note_action(c("note")).alias("action"),
                                 tx.note_time(c("remark"), "Deleted", 2024).alias("deleted_at")))
