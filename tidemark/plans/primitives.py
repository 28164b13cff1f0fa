"""One query per relational primitive: sources, sinks, predicates, joins, aggregates, windows, sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefn import at_time, epoch, moment, month_to_date, months_back
from tidemark.operators import chains, distinct, ordered as od
from tidemark.operators.orders import flag, lookup
from tidemark.plans.registry import query
from tidemark.plans.views import EVENT_CODES, EVENTS_AS_OF, ORDERS_AS_OF, PHONE
from tidemark.sources import chunks, sinks
from tidemark.sources.tables import fill_template, read_csv, run_text

c = F.col


def add(name, sql, fn):
    query(name, sql)(fn)


def _date(text):
    return F.lit(text).cast("date")


# sources and sinks

add("p01_table_scan", "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    lambda t: t.supplier.select("s_suppkey", "s_name", "s_nationkey"))
add("p02_scan_inlined_filter", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    lambda t: t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey").distinct())


@query("p03_csv_source", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def _(t):
    path = sinks.fresh_path(t.spark, "orders-csv")
    sinks.write_csv(t.orders.select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderpriority"), path)
    raw = read_csv(t.spark, path, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    return raw.withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate"))


add("p04_query_result_source",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    lambda t: run_text(t.spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1",
                       orders=t.orders))


@query("p05_query_template", """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderdate < TIMESTAMP '1998-07-01 00:00:00' GROUP BY 1""")
def _(t):
    text = fill_template("SELECT $dim, count(*) AS n FROM {orders} "
                         "WHERE o_orderdate < to_timestamp_ntz(:month_date) GROUP BY 1", dim="o_orderpriority")
    return run_text(t.spark, text, {"month_date": "1998-07-01 00:00:00"}, orders=t.orders)


@query("p06_temp_table", """
    WITH big AS (SELECT * FROM ord WHERE value > 30000000)
    SELECT customer_id, n, channel, top FROM (SELECT customer_id, count(*) AS n FROM big GROUP BY 1)
    JOIN (SELECT customer_id, channel, max(value) AS top FROM big GROUP BY 1, 2) USING (customer_id)""")
def _(t):
    name = f"big_order_{uuid.uuid4().hex}"
    path = sinks.fresh_path(t.spark, "big_order")
    t.ord.filter("value > 30000000").write.parquet(path)
    t.spark.read.parquet(path).createOrReplaceTempView(name)
    big = t.spark.table(name)
    return big.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(
        big.groupBy("customer_id", "channel").agg(F.max("value").alias("top")), "customer_id")


@query("p07_drop_temp_table", "SELECT status, count(*) AS n FROM ord GROUP BY 1")
def _(t):
    name = f"order_copy_{uuid.uuid4().hex}"
    t.ord.createOrReplaceTempView(name)
    path = sinks.fresh_path(t.spark, "dropped")
    t.spark.table(name).groupBy("status").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    t.spark.catalog.dropTempView(name)
    return t.spark.read.parquet(path)


TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("case_id", T.LongType()),
    T.StructField("owner", T.LongType()), T.StructField("assigned_at", T.TimestampNTZType()),
    T.StructField("action", T.StringType()), T.StructField("attempts", T.LongType())])


@query("p08_typed_table", "SELECT task_id, case_id, owner, opened_at AS assigned_at, action, attempts FROM task")
def _(t):
    path = sinks.fresh_path(t.spark, "task")
    sinks.create_table(t.spark, path, TASK_SCHEMA)
    sinks.append(t.task.withColumn("assigned_at", c("opened_at")), path, TASK_SCHEMA)
    return t.spark.read.schema(TASK_SCHEMA).parquet(path)


@query("p09_append_sink", "SELECT order_id, status, value FROM ord")
def _(t):
    path = sinks.fresh_path(t.spark, "appended")
    rows = t.ord.select("order_id", "status", "value")
    sinks.append(rows.filter("status = 9"), path)
    sinks.append(rows.filter("status <> 9"), path)
    return t.spark.read.parquet(path)


ORDER_RANGE = 50_000  # ids kept in one range of a written table


@query("p10_upsert_sink", """
    SELECT order_id, CASE WHEN status = 8 THEN -value ELSE value END AS value FROM ord""")
def _(t):
    path = sinks.fresh_path(t.spark, "target")
    rows = t.ord.select("order_id", "status", "value")
    by = od.id_lane("order_id", ORDER_RANGE)
    sinks.create_partitioned(rows.select("order_id", "value"), path, by)
    batch = rows.filter("status = 8").select("order_id", (-c("value")).alias("value"))
    sinks.upsert_partitions(t.spark, path, batch, "order_id", by)
    return t.spark.read.parquet(path).drop(sinks.PART)


@query("p11_append_predictions", """
    SELECT o_custkey, count(*) / 10.0::DOUBLE AS predicted, TIMESTAMP '2001-08-01 00:00:00' AS created_at FROM orders GROUP BY 1""")
def _(t):
    path = sinks.fresh_path(t.spark, "predicted")
    scored = t.orders.groupBy("o_custkey").agg((F.count(F.lit(1)) / 10).alias("predicted"))
    rows = scored.withColumn("created_at", moment("2001-08-01 00:00:00"))
    chunks.append_chunks(rows, path)
    return chunks.read_chunks(t.spark, path, rows.schema).drop("batch")


@query("p12_csv_sink", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t):
    path = sinks.fresh_path(t.spark, "part-csv")
    sinks.write_csv(t.part.select("p_partkey", "p_brand", "p_size"), path)
    return read_csv(t.spark, path, "p_partkey long, p_brand string, p_size int")


@query("p13_report_sink", "SELECT p_type, count(*) AS n, max(p_size) AS largest FROM part GROUP BY 1")
def _(t):
    path = sinks.fresh_path(t.spark, "report")
    sinks.write_report(t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"),
                                                    F.max("p_size").alias("largest")), path)
    return read_csv(t.spark, path, "p_type string, n long, largest int")


@query("p14_inline_constants", """
    WITH bench AS (SELECT 'purchase' AS event_type, 180 AS seconds UNION ALL SELECT 'error', 60 UNION ALL SELECT 'view', 120)
    SELECT event_id, e.event_type, seconds FROM events e LEFT JOIN bench b ON e.event_type = b.event_type""")
def _(t):
    bench = t.spark.createDataFrame([("purchase", 180), ("error", 60), ("view", 120)],
                                    "event_type string, seconds int")
    return t.events.select("event_id", "event_type").join(F.broadcast(bench), "event_type", "left")


# projections and predicates

add("p15_projection_alias", "SELECT *, p_size * 2 AS double_size FROM part",
    lambda t: t.part.select("*", (c("p_size") * 2).alias("double_size")))
add("p16_lateral_alias", "SELECT order_id, value / 100 AS amount, value / 100 * 2 AS twice FROM ord",
    lambda t: t.ord.selectExpr("order_id", "value / 100 as amount", "amount * 2 as twice"))
add("p17_searched_case", """
    SELECT order_id, CASE WHEN status IN (9, 10) THEN 'fulfilled' WHEN status = 8 THEN 'cancelled' ELSE 'under process' END AS state FROM ord""",
    lambda t: t.ord.select("order_id", F.when(c("status").isin(9, 10), "fulfilled").when(
        c("status") == 8, "cancelled").otherwise("under process").alias("state")))
add("p18_code_map", f"""
    SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_CODES.items())} END AS code FROM events""",
    lambda t: t.events.select("event_id", lookup(EVENT_CODES, c("event_type")).alias("code")))
add("p19_nested_case", """
    SELECT order_id, CASE WHEN status = 8 THEN CASE WHEN value > 20000000 THEN 'big loss' ELSE 'small loss' END ELSE 'no loss' END AS loss FROM ord""",
    lambda t: t.ord.select("order_id", F.when(c("status") == 8, F.when(
        c("value") > 20000000, "big loss").otherwise("small loss")).otherwise("no loss").alias("loss")))
add("p20_presence_flag", """
    SELECT o.order_id, CASE WHEN r.order_id IS NOT NULL THEN 1 ELSE 0 END AS returned_flag
    FROM ord o LEFT JOIN (SELECT order_id FROM item WHERE returned = 1 GROUP BY 1) r ON o.order_id = r.order_id""",
    lambda t: t.ord.select("order_id").join(
        t.item.filter("returned = 1").select("order_id").distinct().withColumn("hit", F.lit(True)),
        "order_id", "left").select("order_id", flag(c("hit")).alias("returned_flag")))
add("p21_in_list", "SELECT order_id FROM ord WHERE status IN (8, 9) AND channel NOT IN ('1-URGENT', '5-LOW')",
    lambda t: t.ord.filter(c("status").isin(8, 9) & ~c("channel").isin("1-URGENT", "5-LOW")).select("order_id"))
add("p22_null_keeping_exclusion", """
    SELECT o.order_id, i.returned_at FROM ord o LEFT JOIN (SELECT order_id, max(returned) AS returned, max(returned_at) AS returned_at FROM item GROUP BY 1) i
    USING (order_id) WHERE i.returned NOT IN (1) OR i.returned IS NULL""",
    lambda t: t.ord.join(t.item.groupBy("order_id").agg(
        F.max("returned").alias("returned"), F.max("returned_at").alias("returned_at")), "order_id", "left")
    .filter(~c("returned").isin(1) | c("returned").isNull()).select("order_id", "returned_at"))
add("p23_between", "SELECT order_id, placed_at FROM ord WHERE placed_at::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
    lambda t: t.ord.filter((c("placed_at") >= moment("1997-01-01 00:00:00"))
                           & (c("placed_at") < moment("1998-01-01 00:00:00"))).select("order_id", "placed_at"))
add("p24_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND p_name NOT LIKE 'red_b%'",
    lambda t: t.part.filter(c("p_name").like("red%") & ~c("p_name").like("red_b%")).select("p_partkey", "p_name"))
add("p25_boolean_predicate", "SELECT item_id, deleted FROM cart_item WHERE invoiced IS TRUE AND NOT deleted",
    lambda t: t.cart_item.filter(c("invoiced") & ~c("deleted")).select("item_id", "deleted"))
add("p26_in_subquery", "SELECT order_id, customer_id FROM ord WHERE order_id IN (SELECT order_id FROM item WHERE returned = 1)",
    lambda t: t.ord.select("order_id", "customer_id").join(
        t.item.filter("returned = 1").select("order_id"), "order_id", "left_semi"))
add("p27_not_in_subquery", "SELECT order_id FROM ord WHERE customer_id NOT IN (SELECT customer_id FROM ord WHERE channel = '5-LOW')",
    lambda t: t.ord.join(t.ord.filter("channel = '5-LOW' and customer_id is not null").select("customer_id"),
                         "customer_id", "left_anti").select("order_id"))
add("p28_column_inequality", "SELECT order_id, item_id FROM ret WHERE item_id <> desired_item",
    lambda t: t.ret.filter(c("item_id") != c("desired_item")).select("order_id", "item_id"))
add("p29_month_to_date", """
    SELECT event_id, ts FROM events WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) BETWEEN 1 AND 29""",
    lambda t: t.events.filter(month_to_date("ts", F.date_sub(F.to_date(moment(EVENTS_AS_OF)), 1))).select("event_id", "ts"))
add("p30_months_back", "SELECT order_id, placed_at FROM ord WHERE placed_at::DATE >= DATE '2001-02-01'",
    lambda t: t.ord.filter(F.to_date("placed_at") >= months_back(F.to_date(moment(ORDERS_AS_OF)), 6)).select("order_id", "placed_at"))
add("p31_intraday_window", """
    SELECT event_id FROM events WHERE ts BETWEEN (ts::DATE || ' 10:00:00')::TIMESTAMP AND (ts::DATE || ' 12:00:00')::TIMESTAMP""",
    lambda t: t.events.filter(c("ts").between(at_time("ts", "10:00:00"), at_time("ts", "12:00:00"))).select("event_id"))


# joins

add("p32_inner_join", "SELECT o.order_id, g.city FROM ord o JOIN geo g ON o.customer_id = g.customer_id",
    lambda t: t.ord.join(t.geo, "customer_id").select("order_id", "city"))
add("p33_left_join", "SELECT o.order_id, i.item_id, i.qty FROM ord o LEFT JOIN item i ON o.order_id = i.order_id",
    lambda t: t.ord.select("order_id").join(t.item.select("order_id", "item_id", "qty"), "order_id", "left"))
add("p34_composite_key_join", """
    SELECT i.order_id, i.item_id, k.deleted FROM item i JOIN cart_item k ON i.order_id = k.order_id AND i.item_id = k.item_id""",
    lambda t: t.item.select("order_id", "item_id").join(
        t.cart_item.select("order_id", "item_id", "deleted"), ["order_id", "item_id"]))
add("p35_right_filter_in_on", "SELECT o.order_id, i.item_id FROM ord o LEFT JOIN item i ON o.order_id = i.order_id AND i.returned = 1",
    lambda t: t.ord.select("order_id").join(
        t.item.filter("returned = 1").select("order_id", "item_id"), "order_id", "left"))
add("p36_left_filter_in_on", "SELECT o.order_id, o.status, i.item_id FROM ord o LEFT JOIN item i ON o.order_id = i.order_id AND o.status = 8",
    lambda t: t.ord.select("order_id", "status").alias("o").join(
        t.item.select("order_id", "item_id").alias("i"),
        (c("o.order_id") == c("i.order_id")) & (c("o.status") == 8), "left").select("o.order_id", "status", "item_id"))

_SESSION = """session_day AS (SELECT entity_id, min(made_at) AS starts, max(made_at) AS ends FROM status_log
    GROUP BY entity_id, made_at::DATE)"""


def _sessions(t):
    return t.status_log.groupBy("entity_id", F.to_date("made_at").alias("d")).agg(
        F.min("made_at").alias("starts"), F.max("made_at").alias("ends")).drop("d")


add("p37_interval_join", f"""
    WITH {_SESSION} SELECT l.id, s.starts, s.ends FROM status_log l JOIN session_day s
    ON l.entity_id = s.entity_id AND l.made_at BETWEEN s.starts AND s.ends""",
    lambda t: od.asof(t.status_log.select("id", "entity_id", "made_at"), _sessions(t), ["entity_id"],
                      "made_at", "starts", ["starts", "ends"], strict=False)
    .filter(c("made_at") <= c("ends")).select("id", "starts", "ends"))

_BLOCK = """block_span AS (SELECT b.entity_id, b.made_at AS blocked_at, min(s.made_at) AS cleared_at FROM status_log b
    LEFT JOIN status_log s ON s.entity_id = b.entity_id AND s.code = 1 AND s.made_at >= b.made_at WHERE b.code = 3 GROUP BY 1, 2)"""


def _blocks(t):
    blocks = t.status_log.filter("code = 3").select("entity_id", c("made_at").alias("blocked_at"))
    clear = t.status_log.filter("code = 1").select("entity_id", c("made_at").alias("cleared_at"))
    return od.asof(blocks, clear, ["entity_id"], "blocked_at", "cleared_at", ["cleared_at"],
                   side="after", strict=False)


def _covered(t):
    # the latest block before a session clears last, so it alone decides
    met = od.asof(_sessions(t), _blocks(t), ["entity_id"], "starts", "blocked_at",
                  ["blocked_at", "cleared_at"], strict=False)
    return met.withColumn("covered", F.coalesce(c("blocked_at").isNotNull() & (
        c("cleared_at").isNull() | (c("ends") <= c("cleared_at"))), F.lit(False)))


add("p38_interval_anti_join", f"""
    WITH {_SESSION}, {_BLOCK}
    SELECT s.* FROM session_day s LEFT JOIN block_span b ON s.entity_id = b.entity_id AND s.starts >= b.blocked_at
      AND (s.ends <= b.cleared_at OR b.cleared_at IS NULL) WHERE b.entity_id IS NULL""",
    lambda t: _covered(t).filter(~c("covered")).select("entity_id", "starts", "ends"))


def _day(name):
    return F.datediff(c(name), _date("1970-01-01"))


add("p39_band_join", """
    SELECT a.order_id, b.order_id AS other_id FROM ord a JOIN ord b ON a.customer_id = b.customer_id
    AND b.placed_at::DATE BETWEEN a.placed_at::DATE - 10 AND a.placed_at::DATE + 10 AND a.status = 8 AND b.status = 9""",
    lambda t: od.band_join(
        t.ord.filter("status = 8").select("order_id", "customer_id", "placed_at"),
        t.ord.filter("status = 9").select(c("order_id").alias("other_id"), "customer_id",
                                          c("placed_at").alias("other_at")),
        ["customer_id"], _day("placed_at"), _day("other_at"), 10, 10).select("order_id", "other_id"))


def _near(t):
    log = t.status_log
    a = log.filter("code = 2").select("id", "owner", c("made_at").alias("a_at"))
    b = log.filter("code = 4").select(c("id").alias("other_id"), "owner", c("made_at").alias("b_at"))
    met = od.band_join(a, b, ["owner"], epoch("a_at"), epoch("b_at"), 0, 121)
    gap = F.unix_micros(c("b_at").cast("timestamp")) - F.unix_micros(c("a_at").cast("timestamp"))
    return met.filter(gap.between(0, 120_000_000)).select("id", "other_id")


add("p40_seconds_tolerance_join", """
    SELECT a.id, b.id AS other_id FROM status_log a JOIN status_log b ON a.owner = b.owner AND a.code = 2 AND b.code = 4
    AND b.made_at - a.made_at BETWEEN INTERVAL 0 SECOND AND INTERVAL 120 SECOND""", _near)


add("p41_later_rows_join", """
    SELECT a.order_id, count(b.order_id) AS later_orders FROM ord a LEFT JOIN ord b ON a.customer_id = b.customer_id
    AND b.placed_at > a.placed_at GROUP BY 1""",
    lambda t: od.ranks(t.ord, ["customer_id"], [c("placed_at").desc()], -od.hour_lane("placed_at"), "r")
    .select("order_id", (c("r") - 1).alias("later_orders")))
add("p42_asof_join", """
    SELECT id, prior_at, prior_code FROM (
        SELECT a.id, b.made_at AS prior_at, b.code AS prior_code, row_number() OVER (PARTITION BY a.id ORDER BY b.made_at DESC, b.id DESC) AS n
        FROM status_log a LEFT JOIN status_log b ON a.entity_id = b.entity_id AND b.code <> 4 AND b.made_at < a.made_at WHERE a.code = 4) WHERE n = 1""",
    lambda t: od.asof(t.status_log.filter("code = 4").select("id", "entity_id", "made_at"),
                      t.status_log.filter("code <> 4").select(
                          "entity_id", c("made_at").alias("prior_at"), c("code").alias("prior_code"),
                          c("id").alias("tie_id")),
                      ["entity_id"], "made_at", "prior_at", ["prior_at", "prior_code"], tie="tie_id")
    .select("id", "prior_at", "prior_code"))


def _both_sides(t):
    left = t.status_log.filter("code = 4").select("id", "entity_id", "made_at")
    other = t.status_log.filter("code = 3").select("entity_id", c("made_at").alias("o_at"))
    before = od.asof(left, other, ["entity_id"], "made_at", "o_at", ["o_at"]).select(
        "id", c("o_at").alias("before_at"))
    after = od.asof(left, other, ["entity_id"], "made_at", "o_at", ["o_at"], side="after").select(
        "id", c("o_at").alias("after_at"))
    return before.join(after, "id")


add("p43_asof_both_sides", """
    SELECT a.id, (SELECT max(b.made_at) FROM status_log b WHERE b.entity_id = a.entity_id AND b.code = 3 AND b.made_at < a.made_at) AS before_at,
           (SELECT min(b.made_at) FROM status_log b WHERE b.entity_id = a.entity_id AND b.code = 3 AND b.made_at > a.made_at) AS after_at
    FROM status_log a WHERE a.code = 4""", _both_sides)
add("p44_open_end_interval", f"""
    WITH {_SESSION}, {_BLOCK}
    SELECT DISTINCT s.entity_id, s.starts FROM session_day s JOIN block_span b ON s.entity_id = b.entity_id AND s.starts >= b.blocked_at
      AND (s.ends <= b.cleared_at OR b.cleared_at IS NULL)""",
    lambda t: _covered(t).filter("covered").select("entity_id", "starts"))


def _or_key(t):
    pair = t.ret.filter("desired_item is not null").select("order_id", "item_id", "desired_item")
    names = t.part.select(c("p_partkey").alias("k"), "p_name")
    one = pair.join(names, c("item_id") == c("k"))
    two = pair.filter(c("item_id") != c("desired_item")).join(names, c("desired_item") == c("k"))
    return one.unionByName(two).select("order_id", "item_id", "k", "p_name")


add("p45_or_key_join", """
    SELECT r.order_id, r.item_id, p.p_partkey AS k, p.p_name FROM ret r JOIN part p
    ON p.p_partkey = r.item_id OR p.p_partkey = r.desired_item WHERE r.desired_item IS NOT NULL""", _or_key)
add("p46_successor_join", "SELECT a.task_id, b.issue_flag AS next_issue FROM fact a LEFT JOIN fact b ON a.next_task_id = b.task_id",
    lambda t: od.KeyedSequence(t.fact, ["case_id"], [c("assigned_at"), c("task_id")],
                               od.hour_lane("assigned_at")).shift({"next_issue": ("issue_flag", 1)})
    .frame().select("task_id", "next_issue"))


def _months(t):
    return t.ord.groupBy("channel", (F.year("placed_at") * 12 + F.month("placed_at")).alias("m")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p46_successor_chain", """
    SELECT order_id AS node, last_value(order_id) OVER w AS root, count(*) OVER w - 1 AS steps, false AS cyclic FROM ord
    WINDOW w AS (PARTITION BY customer_id ORDER BY placed_at, order_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(t):
    """Each order's last successor and how many orders come after it, along links from an order to the next."""
    seq = od.KeyedSequence(t.ord.select("order_id", "customer_id", "placed_at"), ["customer_id"],
                           [c("placed_at"), c("order_id")], od.hour_lane("placed_at"))
    return chains.resolve(seq.shift({"next_id": ("order_id", 1)}).frame(), "order_id", "next_id")


add("p47_period_offset_join", """
    WITH per AS (SELECT channel, year(placed_at) * 12 + month(placed_at) AS m, count(*) AS n FROM ord GROUP BY 1, 2)
    SELECT a.channel, a.m, a.n, b.n AS prior_n FROM per a LEFT JOIN per b ON a.channel = b.channel AND a.m = b.m + 1""",
    lambda t: _months(t).join(_months(t).select("channel", (c("m") + 1).alias("m"), c("n").alias("prior_n")),
                              ["channel", "m"], "left"))
add("p48_constant_relation", """
    SELECT event_id, opens, closes FROM events, (SELECT '08:30:00' AS opens, '23:00:00' AS closes) h WHERE strftime(ts, '%H:%M:%S') BETWEEN opens AND closes""",
    lambda t: t.events.withColumns({"opens": F.lit("08:30:00"), "closes": F.lit("23:00:00")}).filter(
        F.date_format("ts", "HH:mm:ss").between(c("opens"), c("closes"))).select("event_id", "opens", "closes"))
add("p49_two_hop_lookup", "SELECT customer_id, city, hub FROM geo", lambda t: t.geo.select("customer_id", "city", "hub"))
add("p49_parent_chain", """
    WITH RECURSIVE up AS (
        SELECT customer_id AS node, customer_id AS root, 0::BIGINT AS steps FROM geo
        UNION ALL SELECT node, root // 3, steps + 1 FROM up WHERE root // 3 > 0)
    SELECT node, max_by(root, steps) AS root, max(steps) AS steps, false AS cyclic FROM up GROUP BY node""",
    lambda t: chains.resolve(t.geo.select("customer_id", F.nullif(F.floor(c("customer_id") / 3), F.lit(0)).alias("parent_id")),
                             "customer_id", "parent_id"))
add("p50_outer_anti_join", "SELECT o.order_id FROM ord o LEFT JOIN item i ON o.order_id = i.order_id WHERE i.order_id IS NULL",
    lambda t: t.ord.select("order_id").join(t.item.select("order_id"), "order_id", "left_anti"))
add("p51_semi_join", """
    SELECT o.order_id, o.value FROM ord o JOIN (SELECT customer_id FROM ord WHERE channel = '1-URGENT' GROUP BY 1) k ON o.customer_id = k.customer_id""",
    lambda t: t.ord.select("order_id", "value", "customer_id").join(
        t.ord.filter(c("channel") == PHONE).select("customer_id"), "customer_id", "left_semi").select("order_id", "value"))
add("p52_type_bridging_join", """
    SELECT c.call_id, o.status FROM (SELECT call_id, TRY_CAST(right(comment, 7) AS BIGINT) AS k FROM comment_log) c JOIN ord o ON c.k = o.order_id""",
    lambda t: t.comment_log.select("call_id", F.right(c("comment"), F.lit(7)).try_cast("long").alias("order_id")).join(
        t.ord.select("order_id", "status"), "order_id").select("call_id", "status"))


# aggregates

add("p53_count", "SELECT channel, count(*) AS n, count(order_id) AS ids FROM ord GROUP BY 1",
    lambda t: t.ord.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("order_id").alias("ids")))
add("p54_sum_avg_min_max", """
    SELECT channel, sum(value)::BIGINT AS total, avg(value) AS mean, min(value) AS least, max(value) AS most FROM ord GROUP BY 1""",
    lambda t: t.ord.groupBy("channel").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"),
                                           F.min("value").alias("least"), F.max("value").alias("most")))
add("p55_count_distinct", "SELECT channel, count(DISTINCT customer_id) AS customers FROM ord GROUP BY 1",
    lambda t: t.ord.groupBy("channel").agg(F.count_distinct("customer_id").alias("customers")))
add("p55_distinct_rollup", """
    SELECT status, channel, grouping(status) * 2 + grouping(channel) AS level, count(DISTINCT customer_id) AS customers,
           count(DISTINCT order_id) AS orders
    FROM ord GROUP BY GROUPING SETS ((status, channel), (status), (channel), ())""",
    lambda t: distinct.distinct_rollup(t.ord, ["status", "channel"], {"customers": "customer_id", "orders": "order_id"},
                                       [["status", "channel"], ["status"], ["channel"], []]))
add("p56_conditional_count", "SELECT channel, count(CASE WHEN status = 9 THEN order_id END) AS fulfilled FROM ord GROUP BY 1",
    lambda t: t.ord.groupBy("channel").agg(F.count(F.when(c("status") == 9, c("order_id"))).alias("fulfilled")))
add("p57_conditional_distinct_count", """
    SELECT channel, count(DISTINCT CASE WHEN status = 9 THEN customer_id END) AS buyers FROM ord GROUP BY 1""",
    lambda t: t.ord.groupBy("channel").agg(F.count_distinct(F.when(c("status") == 9, c("customer_id"))).alias("buyers")))
add("p58_conditional_min", "SELECT entity_id, min(CASE WHEN code = 4 THEN made_at END) AS first_done FROM status_log GROUP BY 1",
    lambda t: t.status_log.groupBy("entity_id").agg(F.min(F.when(c("code") == 4, c("made_at"))).alias("first_done")))
add("p59_any_all_flag", """
    SELECT order_id, max(returned) AS any_returned, bool_and(qty > 5) AS all_big FROM item GROUP BY 1""",
    lambda t: t.item.groupBy("order_id").agg(F.max("returned").alias("any_returned"), F.bool_and(c("qty") > 5).alias("all_big")))
add("p60_ratio_of_aggregates", "SELECT item_id, sum(gross)::DOUBLE / count(qty) AS per_line FROM item GROUP BY 1",
    lambda t: t.item.groupBy("item_id").agg((F.sum("gross") / F.count("qty")).alias("per_line")))
add("p61_null_safe_ratio", "SELECT item_id, count(*)::DOUBLE / nullif(sum(returned), 0) AS per_return FROM item GROUP BY 1",
    lambda t: t.item.groupBy("item_id").agg(F.try_divide(F.count(F.lit(1)), F.sum("returned")).alias("per_return")))
add("p62_having", "SELECT customer_id, count(*) AS n FROM ord GROUP BY 1 HAVING count(*) >= 12 AND max(placed_at) >= DATE '2000-01-01'",
    lambda t: t.ord.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.max("placed_at").alias("l"))
    .filter((c("n") >= 12) & (c("l") >= moment("2000-01-01 00:00:00"))).drop("l"))
add("p63_group_all_distinct", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2",
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates())
add("p64_select_distinct", "SELECT DISTINCT customer_id FROM ord", lambda t: t.ord.select("customer_id").distinct())
add("p65_multi_level_aggregate", """
    SELECT channel, avg(lines) AS mean_lines FROM (
        SELECT o.order_id, o.channel, count(i.item_id) AS lines FROM ord o LEFT JOIN item i USING (order_id) GROUP BY 1, 2) GROUP BY 1""",
    lambda t: t.ord.join(t.item, "order_id", "left").groupBy("order_id", "channel").agg(
        F.count("item_id").alias("lines")).groupBy("channel").agg(F.avg("lines").alias("mean_lines")))
add("p66_pivot", """
    SELECT entity_id, count(*) FILTER (code = 3) AS held, count(*) FILTER (code = 4) AS done FROM status_log GROUP BY 1""",
    lambda t: t.status_log.groupBy("entity_id").pivot("code", [3, 4]).agg(F.count(F.lit(1))).select(
        "entity_id", F.coalesce(c("3"), F.lit(0)).alias("held"), F.coalesce(c("4"), F.lit(0)).alias("done")))
add("p67_unpivot", """
    SELECT order_id, item_id, 'qty' AS metric, qty AS amount FROM item UNION ALL SELECT order_id, item_id, 'gross', gross FROM item""",
    lambda t: t.item.unpivot(["order_id", "item_id"], ["qty", "gross"], "metric", "amount"))
add("p68_priority_label", """
    SELECT order_id, max(CASE WHEN returned = 1 THEN 'dReturned' WHEN qty > 30 THEN 'cBulk' ELSE 'aPlain' END) AS label FROM item GROUP BY 1""",
    lambda t: t.item.groupBy("order_id").agg(F.max(F.when(c("returned") == 1, "dReturned").when(
        c("qty") > 30, "cBulk").otherwise("aPlain")).alias("label")))
add("p69_first_last_value", """
    SELECT entity_id, min(CASE WHEN a = 1 THEN code END) AS first_code, min(CASE WHEN d = 1 THEN code END) AS last_code FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS a, row_number() OVER (PARTITION BY entity_id ORDER BY id DESC) AS d FROM status_log) GROUP BY 1""",
    lambda t: t.status_log.groupBy("entity_id").agg(F.min_by("code", "id").alias("first_code"), F.max_by("code", "id").alias("last_code")))
add("p70_percentile_disc", "SELECT item_id, quantile_disc(qty, 0.98) AS p98 FROM item GROUP BY 1",
    lambda t: od.exact_percentiles(t.item, ["item_id"], "qty", {"p98": .98}, kind="disc"))
add("p71_percentile_cont", """
    SELECT channel, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median FROM ord GROUP BY 1""",
    lambda t: od.exact_percentiles(t.ord, ["channel"], "value", {"p05": .05, "p25": .25, "median": .5}))
add("p72_running_total", """
    SELECT order_id, sum(value) OVER (PARTITION BY customer_id ORDER BY placed_at, order_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM ord""",
    lambda t: od.KeyedSequence(t.ord, ["customer_id"], [c("placed_at"), c("order_id")], od.hour_lane("placed_at"))
    .running({"spent": c("value")}).frame().select("order_id", "spent"))


# windows

def _by_customer(t):
    return od.KeyedSequence(t.ord, ["customer_id"], [c("placed_at"), c("order_id")], od.hour_lane("placed_at"))


add("p73_row_number", "SELECT order_id, row_number() OVER (PARTITION BY customer_id ORDER BY placed_at, order_id) AS n FROM ord",
    lambda t: _by_customer(t).number("n").frame().select("order_id", "n"))
add("p74_rank", "SELECT l_orderkey, l_partkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem",
    lambda t: od.ranks(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"],
                       [c("l_linenumber")], c("l_linenumber"), "r"))
add("p75_percent_rank", """
    SELECT s_suppkey, n, back, percent_rank() OVER (PARTITION BY y ORDER BY n DESC, back) AS pr, y FROM (
        SELECT l_suppkey AS s_suppkey, year(l_shipdate) AS y, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2)""",
    lambda t: od.percent_ranks(
        t.lineitem.groupBy(c("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("y")).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(c("l_returnflag") == "R", 1)).alias("back")),
        ["y"], [c("n").desc(), c("back")], -c("n"), "pr"))
add("p76_lead_lag", """
    SELECT id, lead(made_at) OVER w AS next_at, lead(made_at, 2) OVER w AS next2_at, lag(code) OVER w AS prev_code
    FROM status_log WINDOW w AS (PARTITION BY entity_id ORDER BY id)""",
    lambda t: od.KeyedSequence(t.status_log, ["entity_id"], [c("id")], od.id_lane("id")).shift(
        {"next_at": ("made_at", 1), "next2_at": ("made_at", 2), "prev_code": ("code", -1)}).frame().select(
        "id", "next_at", "next2_at", "prev_code"))
add("p77_predicate_ordinal", """
    SELECT id, CASE WHEN code = 3 THEN row_number() OVER (PARTITION BY entity_id, code = 3 ORDER BY id) END AS n FROM status_log""",
    lambda t: od.KeyedSequence(t.status_log, ["entity_id"], [c("id")], od.id_lane("id")).number_where(
        {"n": c("code") == 3}).frame().select("id", "n"))
add("p78_first_last_only", """
    SELECT id, CASE WHEN a = 1 AND d = 1 THEN 'only' WHEN a = 1 THEN 'first' WHEN d = 1 THEN 'last' ELSE 'middle' END AS place FROM (
        SELECT id, row_number() OVER (PARTITION BY entity_id, made_at::DATE ORDER BY id) AS a,
               row_number() OVER (PARTITION BY entity_id, made_at::DATE ORDER BY id DESC) AS d FROM status_log)""",
    lambda t: od.KeyedSequence(t.status_log.withColumn("d", F.to_date("made_at")), ["entity_id", "d"], [c("id")], od.id_lane("id"))
    .shift({"p": ("id", -1), "n": ("id", 1)}).frame().select("id", F.when(c("p").isNull() & c("n").isNull(), "only").when(
        c("p").isNull(), "first").when(c("n").isNull(), "last").otherwise("middle").alias("place")))
add("p79_top1_per_group", """
    SELECT customer_id, order_id, value FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY value DESC, order_id) AS n FROM ord) WHERE n = 1""",
    lambda t: od.first_by(t.ord, ["customer_id"], ["order_id", "value"], [-c("value"), c("order_id")]))
add("p80_window_over_window", """
    SELECT id, lag(n) OVER (PARTITION BY entity_id ORDER BY id) AS prior_hold FROM (
        SELECT id, entity_id, CASE WHEN code = 3 THEN row_number() OVER (PARTITION BY entity_id, code = 3 ORDER BY id) END AS n FROM status_log)""",
    lambda t: od.KeyedSequence(t.status_log, ["entity_id"], [c("id")], od.id_lane("id")).number_where(
        {"n": c("code") == 3}).shift({"prior_hold": ("n", -1)}).frame().select("id", "prior_hold"))
add("p81_frame_unbounded_preceding", """
    SELECT id, count(*) FILTER (code = 4) OVER (PARTITION BY entity_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS done_so_far FROM status_log""",
    lambda t: od.KeyedSequence(t.status_log, ["entity_id"], [c("id")], od.id_lane("id")).running(
        {"done_so_far": F.when(c("code") == 4, 1).otherwise(0).cast("long")}).frame().select("id", "done_so_far"))


# order, limits and sets

add("p82_order_by", "SELECT order_id, channel, value FROM ord ORDER BY channel, value DESC, order_id",
    lambda t: t.ord.select("order_id", "channel", "value").orderBy("channel", c("value").desc(), "order_id"))
add("p83_nulls_last", """
    SELECT o.order_id, i.returned_at FROM ord o LEFT JOIN (SELECT order_id, max(returned_at) AS returned_at FROM item GROUP BY 1) i USING (order_id)
    ORDER BY i.returned_at DESC NULLS LAST, o.order_id""",
    lambda t: t.ord.select("order_id").join(t.item.groupBy("order_id").agg(F.max("returned_at").alias("returned_at")), "order_id", "left")
    .orderBy(c("returned_at").desc_nulls_last(), "order_id"))
add("p84_limit", "SELECT event_id, ts FROM events ORDER BY event_id LIMIT 100",
    lambda t: t.events.select("event_id", "ts").orderBy("event_id").limit(100))
add("p85_union_distinct", "SELECT customer_id FROM ord WHERE status = 8 UNION SELECT entity_id FROM status_log WHERE code = 3",
    lambda t: t.ord.filter("status = 8").select("customer_id").union(
        t.status_log.filter("code = 3").select("entity_id")).distinct())
add("p86_union_all", "SELECT order_id, 'order' AS kind FROM ord UNION ALL SELECT order_id, 'item' FROM item",
    lambda t: t.ord.select("order_id", F.lit("order").alias("kind")).unionByName(t.item.select("order_id", F.lit("item").alias("kind"))))


@query("p88_chained_ctes", """
    WITH lines AS (SELECT order_id, sum(gross) AS gross FROM item GROUP BY 1), wide AS (SELECT o.channel, l.gross FROM ord o JOIN lines l USING (order_id))
    SELECT channel, sum(gross)::BIGINT AS gross FROM wide GROUP BY 1""")
def _(t):
    lines = t.item.groupBy("order_id").agg(F.sum("gross").alias("gross"))
    wide = t.ord.select("order_id", "channel").join(lines, "order_id")
    return wide.groupBy("channel").agg(F.sum("gross").alias("gross"))


@query("p89_nested_subqueries", """
    SELECT n_orders, count(*) AS customers FROM (
        SELECT customer_id, count(*) AS n_orders FROM (SELECT customer_id, order_id FROM (SELECT * FROM ord WHERE status = 9)) GROUP BY 1) GROUP BY 1""")
def _(t):
    done = t.ord.filter("status = 9").select("customer_id", "order_id")
    per = done.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"))
    return per.groupBy("n_orders").agg(F.count(F.lit(1)).alias("customers"))
