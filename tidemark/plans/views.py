"""The logical inputs of the operators, laid over the test tables.

Each view exists twice with the same rows: as SQL text and as a DataFrame.
Money is kept in whole cents and discounts in hundredths of a cent, so sums
are exact in any order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.sources.tables import Tables

EVENTS_AS_OF = "2024-01-30 12:00:00"
ORDERS_AS_OF = "2001-08-01"
PHONE = "1-URGENT"
WEB = ["2-HIGH", "3-MEDIUM"]
PARTNER = ["5-LOW"]
EVENT_CODES = {"signup": 1, "view": 2, "error": 3, "purchase": 4, "click": 5}
NOTES = {"signup": "Assigned: ", "view": "Reassign ", "error": "Hold: ",
         "purchase": "Done: ", "click": "Rejected: "}

#: lines that a group of orders holds on average, where orders are counted by groups
LINE_ROWS = 1 << 16

_CODE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in EVENT_CODES.items()) + " END"
_NOTE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTES.items()) + " END"

VIEWS = {
    "status_log": f"""
        SELECT event_id AS id, user_id AS entity_id, {_CODE} AS code, ts AS made_at,
               user_id % 7 AS owner, {_NOTE} || json_extract_string(props, '$.k') AS note, props
        FROM events""",
    "task_log": """
        SELECT id, entity_id AS case_id,
               entity_id || '-' || strftime(made_at, '%Y-%m-%d') AS task_id, code, made_at, owner, note
        FROM status_log""",
    "item": """
        SELECT l_orderkey AS order_id, l_partkey AS item_id,
               sum(round(l_quantity)::BIGINT)::BIGINT AS qty,
               sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS gross,
               sum(round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT)::BIGINT AS disc,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
               min(l_shipdate) AS first_ship,
               min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS returned_at
        FROM lineitem GROUP BY 1, 2""",
    "ord": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'P' THEN 8 ELSE 1 END AS status,
               round(o_totalprice * 100)::BIGINT AS value, o_orderdate AS placed_at,
               o_orderpriority AS channel
        FROM orders""",
    "geo": """
        SELECT c_custkey AS customer_id, c_mktsegment AS segment, n_name AS city, r_name AS hub,
               n_nationkey AS city_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "inbound": """
        SELECT i.order_id * 1000000000 + i.item_id AS call_id, o.customer_id AS caller,
               i.returned_at AS made_at
        FROM item i JOIN ord o ON i.order_id = o.order_id WHERE i.returned = 1""",
    "live_order": """
        SELECT order_id, customer_id, placed_at, placed_at + INTERVAL 60 DAY AS closed_at,
               status, order_id % 2 = 0 AS in_program
        FROM ord""",
    "comment_log": """
        SELECT o.order_id AS call_id, o.placed_at AS made_at, o.customer_id AS caller,
               CASE o.order_id % 5 WHEN 0 THEN 'M' || lpad(o.order_id::VARCHAR, 7, '0')
                    WHEN 1 THEN 'm #' || lpad(o.order_id::VARCHAR, 7, '0')
                    WHEN 2 THEN 'Order #' || lpad(o.order_id::VARCHAR, 7, '0')
                    WHEN 3 THEN lpad(o.order_id::VARCHAR, 7, '0')
                    ELSE 'none' END AS comment,
               CASE WHEN o.order_id % 3 = 0 THEN o.order_id || '|called' ELSE 'x|' || o.order_id END AS ref
        FROM ord o""",
    "ret": """
        SELECT order_id, item_id, qty, returned_at AS raised_at, next_item AS desired_item,
               (order_id + item_id) % 12 AS source
        FROM (SELECT *, lead(item_id) OVER (PARTITION BY order_id ORDER BY item_id) AS next_item
              FROM item) WHERE returned = 1""",
    "task": """
        SELECT task_id, case_id, max(owner) AS owner,
               min(CASE WHEN code = 1 THEN made_at END) AS assigned_at,
               min(CASE WHEN code = 2 THEN made_at END) AS first_call_at,
               max(CASE WHEN code = 2 THEN made_at END) AS last_call_at,
               min(CASE WHEN code = 5 THEN made_at END) AS first_hangup_at,
               max(CASE WHEN code = 5 THEN made_at END) AS last_hangup_at,
               max(CASE WHEN code IN (3, 4) THEN made_at END) AS actioned_at,
               max(CASE WHEN code IN (3, 4, 5) THEN made_at END) AS detached_at,
               max(CASE WHEN code = 4 THEN 'Done' WHEN code = 3 THEN 'Hold' END) AS action,
               count(DISTINCT CASE WHEN code = 2 THEN made_at END) AS attempts,
               max(CASE WHEN code = 3 THEN 1 ELSE 0 END) AS inactive,
               min(made_at) AS opened_at, max(made_at) AS closed_at
        FROM task_log GROUP BY 1, 2""",
    "fact": """
        SELECT *, owner + 900 AS profile_id, CASE action WHEN 'Done' THEN 180 WHEN 'Hold' THEN 60 WHEN 'Reassigned' THEN 80 END::BIGINT
                  AS expected_seconds,
               lag(task_id) OVER (PARTITION BY case_id ORDER BY assigned_at) AS previous_task_id,
               lead(task_id) OVER (PARTITION BY case_id ORDER BY assigned_at) AS next_task_id
        FROM (
            SELECT task_id, case_id * 10 AS order_id, case_id, CASE WHEN case_id % 3 = 0 THEN 'Hold' ELSE 'New' END AS task_type,
                   max(CASE WHEN code = 3 THEN 'reason ' || (id % 4) END) AS reject_reason,
                   count(DISTINCT made_at) FILTER (code = 4) AS connected,
                   max(owner) AS owner, min(made_at) AS assigned_at,
                   min(made_at) FILTER (code = 2) AS first_call_at, max(made_at) FILTER (code = 2) AS last_call_at,
                   min(made_at) FILTER (code = 5) AS first_hangup_at, max(made_at) FILTER (code = 5) AS last_hangup_at,
                   max(made_at) FILTER (code IN (1, 3, 4)) AS actioned_at,
                   max(made_at) FILTER (code IN (1, 3, 4, 5)) AS detached_at,
                   max(CASE code WHEN 4 THEN 'Done' WHEN 3 THEN 'Hold' WHEN 1 THEN 'Reassigned' END) AS action,
                   count(DISTINCT made_at) FILTER (code = 2) AS attempts,
                   count(DISTINCT made_at) FILTER (code = 5) AS hangups,
                   count(DISTINCT made_at) FILTER (code = 1) AS notified,
                   max(CASE WHEN code = 1 THEN 1 ELSE 0 END) AS inactive_flag,
                   max(CASE WHEN first_done <= made_at THEN 1 ELSE 0 END) AS issue_flag
            FROM task_log LEFT JOIN (SELECT case_id AS done_case, min(made_at) AS first_done
                                     FROM task_log WHERE code = 4 GROUP BY 1) ON case_id = done_case
            GROUP BY 1, 2, 3)
        WHERE assigned_at::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-29'""",
    "line": """
        SELECT i.*, p_type = 'PROMO' AS chronic, p_size > 25 AS needs_rx, p_type AS form
        FROM item i JOIN part ON item_id = p_partkey""",
    "mark": """
        SELECT order_id, unnest([CASE WHEN qty >= 30 THEN 22 END, CASE WHEN qty <= 5 THEN 23 END,
               CASE WHEN form = 'SMALL' THEN 14 END, CASE WHEN returned = 1 THEN 17 END,
               CASE WHEN disc = 0 THEN 1 END, CASE WHEN chronic THEN 12 END,
               CASE WHEN form = 'ECONOMY' THEN 43 END, CASE WHEN form = 'LARGE' THEN 11 END]) AS flag_id
        FROM line""",
    "sub_order": """
        SELECT order_id, customer_id AS subscription_id,
               CASE WHEN status = 8 THEN order_id ELSE -1 END AS template_order_id,
               channel = '3-MEDIUM' AS clone
        FROM ord WHERE channel IN ('3-MEDIUM', '4-NOT SPECIFIED')""",
    "sub_log": """
        SELECT order_id, item_id AS original, next_item AS substitute, item_id % 20 AS agent,
               first_ship AS created_at, log_type, returned AS substitute_kind
        FROM (SELECT *, lead(item_id) OVER (PARTITION BY order_id ORDER BY item_id) AS next_item FROM item),
             (VALUES (1), (2), (3)) k(log_type)
        WHERE next_item IS NOT NULL AND (log_type = 1 OR (log_type = 2 AND qty >= 10) OR (log_type = 3 AND qty >= 25))""",
    "cart_item": """
        SELECT order_id, item_id, qty < 10 AS deleted, gross > 2000000 AS invoiced, returned,
               item_id % 8 + 1 AS return_reason FROM item""",
    "stage_log": """
        SELECT *, json_extract_string(props, '$.k')::INT AS k,
               strftime(made_at, '%m-%d %H:%M') || ' - ' ||
               CASE id % 3 WHEN 0 THEN 'Sent out' WHEN 1 THEN 'Deleted' ELSE 'Code added' END AS remark
        FROM status_log""",
    "custom_item": """
        SELECT id AS item_row, entity_id, CASE WHEN k >= 30 THEN k END AS item_code,
               k % 2 = 1 AS printed, k < 10 AS deleted, made_at AS created_at,
               made_at + INTERVAL 1 DAY AS updated_at
        FROM stage_log WHERE code = 5""",
    "code_catalog": """
        SELECT item_code, min(created_at) AS listed_at FROM custom_item
        WHERE item_code IS NOT NULL GROUP BY 1""",
    "stage_item": """
        SELECT id AS item_row, entity_id, k AS item_code, k % 3 = 0 AS deleted,
               made_at AS created_at, made_at + INTERVAL 12 HOUR AS deleted_at
        FROM stage_log WHERE code = 5""",
    "program": """
        SELECT entity_id, 5 + entity_id % 3 AS source, min(made_at) AS placed_at,
               arg_max(code, id) AS last_code
        FROM status_log GROUP BY 1""",
    "step": """
        SELECT *, lag(code) OVER w AS prev_code, lag(made_at) OVER w AS prev_at,
               lead(code) OVER w AS next_code, lead(made_at) OVER w AS next_at,
               lead(code, 2) OVER w AS next2_code, lead(made_at, 2) OVER w AS next2_at
        FROM stage_log WINDOW w AS (PARTITION BY entity_id ORDER BY id)""",
    "attempt": """
        SELECT s.id, s.entity_id AS case_id, s.made_at AS assigned_at,
               row_number() OVER (PARTITION BY s.entity_id, s.made_at::DATE ORDER BY s.id) AS attempt_number,
               CASE WHEN s.code = 4 THEN 1 ELSE 0 END AS success,
               hour(s.made_at) AS hr, g.segment, g.city, g.hub,
               (s.entity_id % 2)::VARCHAR AS parity,
               (json_extract_string(s.props, '$.k')::INT // 25)::VARCHAR AS kband,
               s.owner::VARCHAR AS owner, (s.entity_id % 3)::VARCHAR AS third,
               dayofweek(s.made_at)::VARCHAR AS weekday, (hour(s.made_at) // 6)::VARCHAR AS daypart
        FROM status_log s JOIN geo g ON s.entity_id = g.customer_id""",
}


def _cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def _labels(mapping, column):
    out = None
    for key, value in mapping.items():
        out = F.when(F.col(column) == key, F.lit(value)) if out is None else out.when(
            F.col(column) == key, F.lit(value))
    return out


class Bound(Tables):
    """The test tables plus the views above as DataFrames."""

    @property
    def status_log(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"),
            _labels(EVENT_CODES, "event_type").alias("code"), F.col("ts").alias("made_at"),
            (F.col("user_id") % 7).alias("owner"),
            F.concat(_labels(NOTES, "event_type"), F.get_json_object("props", "$.k")).alias("note"),
            "props")

    @property
    def task_log(self) -> DataFrame:
        return self.status_log.select(
            "id", F.col("entity_id").alias("case_id"),
            F.concat_ws("-", "entity_id", F.date_format("made_at", "yyyy-MM-dd")).alias("task_id"),
            "code", "made_at", "owner", "note")

    @property
    def item(self) -> DataFrame:
        return self._items(self.lineitem)

    @staticmethod
    def _items(lines: DataFrame) -> DataFrame:
        back = F.col("l_returnflag") == "R"
        return lines.groupBy(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id")).agg(
            F.sum(F.round("l_quantity").cast("long")).alias("qty"),
            F.sum(_cents("l_extendedprice")).alias("gross"),
            F.sum(_cents("l_extendedprice") * _cents("l_discount")).alias("disc"),
            F.max(F.when(back, 1).otherwise(0)).alias("returned"),
            F.min("l_shipdate").alias("first_ship"),
            F.min(F.when(back, F.col("l_shipdate"))).alias("returned_at"))

    @property
    def _item_by_order(self) -> tuple[DataFrame, DataFrame]:
        """The items of orders of few lines, dealt by order: work by order needs no further exchange; and those of the others."""
        few = self._few_lines
        return self._items(self.lineitem.filter(few).repartition("l_orderkey")), self._items(self.lineitem.filter(~few))

    @cached_property
    def _few_lines(self):
        from tidemark.operators.ordered import alone, key_buckets
        lines = self.lineitem.select("l_orderkey")
        return alone(lines, ["l_orderkey"], key_buckets(lines, lines.count(), LINE_ROWS))

    @property
    def ord(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", 9).when(F.col("o_orderstatus") == "P", 8)
            .otherwise(1).alias("status"),
            _cents("o_totalprice").alias("value"), F.col("o_orderdate").alias("placed_at"),
            F.col("o_orderpriority").alias("channel"))

    @property
    def geo(self) -> DataFrame:
        places = (self.nation.join(F.broadcast(self.region),
                                   F.col("n_regionkey") == F.col("r_regionkey")))
        return (self.customer.join(F.broadcast(places),
                                   F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("city"),
                        F.col("r_name").alias("hub"), F.col("n_nationkey").alias("city_id")))

    @property
    def inbound(self) -> DataFrame:
        # the lines that came back alone are gathered to items, not all of them
        back = self.lineitem.filter("l_returnflag = 'R'").groupBy(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id")).agg(
            F.min("l_shipdate").alias("returned_at"))
        return (back.join(self.ord, "order_id")
                .select((F.col("order_id") * 1000000000 + F.col("item_id")).alias("call_id"),
                        F.col("customer_id").alias("caller"), F.col("returned_at").alias("made_at")))

    @property
    def live_order(self) -> DataFrame:
        return self.ord.select(
            "order_id", "customer_id", "placed_at",
            F.timestamp_add("DAY", F.lit(60), "placed_at").alias("closed_at"), "status",
            (F.col("order_id") % 2 == 0).alias("in_program"))

    @property
    def comment_log(self) -> DataFrame:
        o = F.col("order_id")
        text = F.lpad(o.cast("string"), 7, "0")
        return self.ord.select(
            o.alias("call_id"), F.col("placed_at").alias("made_at"),
            F.col("customer_id").alias("caller"),
            F.when(o % 5 == 0, F.concat(F.lit("M"), text))
            .when(o % 5 == 1, F.concat(F.lit("m #"), text))
            .when(o % 5 == 2, F.concat(F.lit("Order #"), text))
            .when(o % 5 == 3, text).otherwise("none").alias("comment"),
            F.when(o % 3 == 0, F.concat(o.cast("string"), F.lit("|called")))
            .otherwise(F.concat(F.lit("x|"), o.cast("string"))).alias("ref"))

    @property
    def ret(self) -> DataFrame:
        from tidemark.operators.ordered import KeyedSequence, id_lane
        seq = KeyedSequence(self.item, ["order_id"], [F.col("item_id")], id_lane("item_id"))
        return (seq.shift({"desired_item": (F.col("item_id"), 1)}).frame().filter("returned = 1")
                .select("order_id", "item_id", "qty", F.col("returned_at").alias("raised_at"),
                        "desired_item",
                        ((F.col("order_id") + F.col("item_id")) % 12).alias("source")))

    @property
    def task(self) -> DataFrame:
        c, at = F.col("code"), F.col("made_at")
        return self.task_log.groupBy("task_id", "case_id").agg(
            F.max("owner").alias("owner"),
            F.min(F.when(c == 1, at)).alias("assigned_at"),
            F.min(F.when(c == 2, at)).alias("first_call_at"),
            F.max(F.when(c == 2, at)).alias("last_call_at"),
            F.min(F.when(c == 5, at)).alias("first_hangup_at"),
            F.max(F.when(c == 5, at)).alias("last_hangup_at"),
            F.max(F.when(c.isin(3, 4), at)).alias("actioned_at"),
            F.max(F.when(c.isin(3, 4, 5), at)).alias("detached_at"),
            F.max(F.when(c == 4, "Done").when(c == 3, "Hold")).alias("action"),
            F.count_distinct(F.when(c == 2, at)).alias("attempts"),
            F.max(F.when(c == 3, 1).otherwise(0)).alias("inactive"),
            F.min("made_at").alias("opened_at"), F.max("made_at").alias("closed_at"))

    @property
    def fact(self) -> DataFrame:
        return self.fact_of(self.task_log)

    def fact_of(self, log: DataFrame) -> DataFrame:
        """The task fact of a task log, whole or of some cases."""
        from tidemark.operators.facts import task_fact
        log = log.withColumns({
            "task_type": F.when(F.col("case_id") % 3 == 0, "Hold").otherwise("New"),
            "order_id": F.col("case_id") * 10,
            "reason": F.when(F.col("code") == 3, F.concat(F.lit("reason "), (F.col("id") % 4).cast("string")))})
        profiles = self.spark.range(7).select(F.col("id").alias("owner"), (F.col("id") + 900).alias("profile_id"))
        return task_fact(log, profiles, {4: "Done", 3: "Hold", 1: "Reassigned"}, call=2, answered=4, hangup=5,
                         inactive=1, done=4, start="2024-01-01", as_of=EVENTS_AS_OF)

    @property
    def line(self) -> DataFrame:
        parts = self.part.select(F.col("p_partkey").alias("item_id"),
                                 (F.col("p_type") == "PROMO").alias("chronic"),
                                 (F.col("p_size") > 25).alias("needs_rx"),
                                 F.col("p_type").alias("form"))
        return self.item.join(parts, "item_id")

    @property
    def mark(self) -> DataFrame:
        c = F.col
        tests = {22: c("qty") >= 30, 23: c("qty") <= 5, 14: c("form") == "SMALL",
                 17: c("returned") == 1, 1: c("disc") == 0, 12: c("chronic"),
                 43: c("form") == "ECONOMY", 11: c("form") == "LARGE"}
        codes = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
        return self.line.select("order_id", F.explode(F.array_compact(codes)).alias("flag_id"))

    @property
    def sub_order(self) -> DataFrame:
        return self.ord.filter(F.col("channel").isin("3-MEDIUM", "4-NOT SPECIFIED")).select(
            "order_id", F.col("customer_id").alias("subscription_id"),
            F.when(F.col("status") == 8, F.col("order_id")).otherwise(-1).alias("template_order_id"),
            (F.col("channel") == "3-MEDIUM").alias("clone"))

    @property
    def sub_log(self) -> DataFrame:
        return self._sub_log(self._next_items(self.item))

    @property
    def sub_log_by_order(self) -> DataFrame:
        """The log dealt by order, but for orders of many lines."""
        few, many = self._item_by_order
        along = Window.partitionBy("order_id").orderBy("item_id")
        return self._sub_log(few.withColumn("substitute", F.lead("item_id").over(along)).unionByName(self._next_items(many)))

    @staticmethod
    def _next_items(item: DataFrame) -> DataFrame:
        from tidemark.operators.ordered import KeyedSequence, id_lane
        seq = KeyedSequence(item, ["order_id"], [F.col("item_id")], id_lane("item_id"))
        return seq.shift({"substitute": ("item_id", 1)}).frame()

    @staticmethod
    def _sub_log(pairs: DataFrame) -> DataFrame:
        kinds = F.array_compact(F.array(F.lit(1), F.when(F.col("qty") >= 10, 2),
                                        F.when(F.col("qty") >= 25, 3)))
        return pairs.filter("substitute is not null").select(
            "order_id", F.col("item_id").alias("original"), "substitute",
            (F.col("item_id") % 20).alias("agent"), F.col("first_ship").alias("created_at"),
            F.explode(kinds).alias("log_type"), F.col("returned").alias("substitute_kind"))

    @property
    def cart_item(self) -> DataFrame:
        return self._cart_item(self.item)

    @property
    def cart_item_by_order(self) -> DataFrame:
        """The lines of the cart dealt by order, but for orders of many lines."""
        few, many = self._item_by_order
        return self._cart_item(few.unionByName(many))

    @staticmethod
    def _cart_item(item: DataFrame) -> DataFrame:
        return item.select(
            "order_id", "item_id", (F.col("qty") < 10).alias("deleted"),
            (F.col("gross") > 2000000).alias("invoiced"), "returned",
            (F.col("item_id") % 8 + 1).alias("return_reason"))

    @property
    def stage_log(self) -> DataFrame:
        mark = F.when(F.col("id") % 3 == 0, "Sent out").when(
            F.col("id") % 3 == 1, "Deleted").otherwise("Code added")
        return self.status_log.withColumns({
            "k": F.get_json_object("props", "$.k").cast("int"),
            "remark": F.concat(F.date_format("made_at", "MM-dd HH:mm"), F.lit(" - "), mark)})

    @property
    def custom_item(self) -> DataFrame:
        return self.stage_log.filter("code = 5").select(
            F.col("id").alias("item_row"), "entity_id",
            F.when(F.col("k") >= 30, F.col("k")).alias("item_code"),
            (F.col("k") % 2 == 1).alias("printed"), (F.col("k") < 10).alias("deleted"),
            F.col("made_at").alias("created_at"),
            F.timestamp_add("DAY", F.lit(1), "made_at").alias("updated_at"))

    @property
    def code_catalog(self) -> DataFrame:
        return (self.custom_item.filter("item_code is not null").groupBy("item_code")
                .agg(F.min("created_at").alias("created_at")))

    @property
    def stage_item(self) -> DataFrame:
        return self.stage_log.filter("code = 5").select(
            F.col("id").alias("item_row"), "entity_id", F.col("k").alias("item_code"),
            (F.col("k") % 3 == 0).alias("deleted"), F.col("made_at").alias("created_at"),
            F.timestamp_add("HOUR", F.lit(12), "made_at").alias("deleted_at"))

    @property
    def program(self) -> DataFrame:
        return self.status_log.groupBy("entity_id").agg(
            (5 + F.col("entity_id") % 3).alias("source"), F.min("made_at").alias("placed_at"),
            F.max_by("code", "id").alias("last_code"))

    @property
    def attempt(self) -> DataFrame:
        from tidemark.operators.ordered import id_lane, row_numbers
        keyed = self.status_log.withColumn("day", F.to_date("made_at"))
        numbered = row_numbers(keyed, ["entity_id", "day"], [F.col("id")], id_lane("id"),
                               "attempt_number")
        geo = self.geo.withColumnRenamed("customer_id", "entity_id")
        return numbered.join(geo, "entity_id").select(
            "id", F.col("entity_id").alias("case_id"), F.col("made_at").alias("assigned_at"),
            "attempt_number", F.when(F.col("code") == 4, 1).otherwise(0).alias("success"),
            F.hour("made_at").alias("hr"), "segment", "city", "hub",
            (F.col("entity_id") % 2).cast("string").alias("parity"),
            F.expr("cast(get_json_object(props, '$.k') as int) div 25").cast("string").alias("kband"),
            F.col("owner").cast("string").alias("owner"),
            (F.col("entity_id") % 3).cast("string").alias("third"),
            (F.dayofweek("made_at") - 1).cast("string").alias("weekday"),
            F.floor(F.hour("made_at") / 6).cast("string").alias("daypart"))
