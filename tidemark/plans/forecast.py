"""Retention cohorts by month and the forecast of the next month."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.plans.registry import query
from tidemark.session import checkpointed
from tidemark.sources import sinks

MONTHS = ["2001-03-01", "2001-04-01", "2001-05-01", "2001-06-01"]
NEXT = "2001-07-01"
HUBS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
# cohorts of the test tables are small: this parameter stands for the operator's 75 in the queries below
LEAST = 3
_SOURCE = {"AUTOMOBILE": "Organic", "BUILDING": "Affiliates", "FURNITURE": "Google",
           "HOUSEHOLD": "Facebook"}


def _orders(t):
    place = t.geo.select("customer_id", F.when(F.col("hub") == "MIDDLE EAST", "ASIA").otherwise(
        F.col("hub")).alias("hub"), (F.col("city_id") % 2).alias("courier"))
    return t.ord.join(place, "customer_id").withColumns({
        "chronic": F.when(F.col("value") > 25000000, 1).otherwise(0),
        "discounted": F.when(F.col("channel") < "3", 1).otherwise(0)})


def _profile(t):
    named = F.create_map(*[F.lit(x) for pair in _SOURCE.items() for x in pair])
    return t.geo.select("customer_id", F.coalesce(named[F.col("segment")], F.lit("Others")).alias("source"))


def _age(at):
    d = f"date_diff('month', {at}, m.month)"
    return f"CASE WHEN {d} BETWEEN 1 AND 6 THEN 'M' || {d} ELSE 'M6+' END"


def _cohort_sql(months):
    values = ", ".join(f"(DATE '{m}')" for m in months)
    return f"""
    months AS (SELECT * FROM (VALUES {values}) v(month)),
    fat AS (
        SELECT o.*, CASE WHEN g.hub = 'MIDDLE EAST' THEN 'ASIA' ELSE g.hub END AS hub, g.city_id % 2 AS courier,
               CASE WHEN value > 25000000 THEN 1 ELSE 0 END AS chronic, CASE WHEN channel < '3' THEN 1 ELSE 0 END AS discounted,
               CASE g.segment {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SOURCE.items())} ELSE 'Others' END AS source,
               min(placed_at) FILTER (status IN (9, 10)) OVER (PARTITION BY customer_id) AS first_at
        FROM ord o JOIN geo g USING (customer_id)),
    latest AS (
        SELECT m.month, f.*, row_number() OVER (PARTITION BY m.month, customer_id ORDER BY order_id DESC) AS r
        FROM fat f JOIN months m ON f.placed_at::DATE < m.month AND f.status IN (9, 10)),
    back AS (
        SELECT m.month, customer_id, day(min(placed_at)) AS next_day FROM ord JOIN months m
          ON placed_at::DATE >= m.month AND placed_at::DATE < m.month + INTERVAL 1 MONTH GROUP BY 1, 2),
    people AS (
        SELECT m.month, m.customer_id, b.next_day, {_age('m.first_at::DATE')} AS acquired, {_age('m.placed_at::DATE')} AS latest,
               m.chronic, m.discounted, m.hub, m.courier, m.source
        FROM latest m LEFT JOIN back b ON b.month = m.month AND b.customer_id = m.customer_id WHERE m.r = 1),
    sizes AS (SELECT month, {", ".join(fc.DIMS)}, count(*) AS customers FROM people GROUP BY ALL),
    daily AS (
        SELECT *, sum(customers) OVER (PARTITION BY month, {", ".join(fc.DIMS)} ORDER BY next_day ROWS UNBOUNDED PRECEDING)::BIGINT AS running
        FROM (SELECT month, {", ".join(fc.DIMS)}, next_day, count(*) AS customers FROM people WHERE next_day IS NOT NULL GROUP BY ALL)),
    curve AS (
        SELECT month, {", ".join(fc.DIMS)},
               {", ".join(f"coalesce(max(running) FILTER (next_day <= {m}), 0) AS retained_{m}" for m in fc.MILESTONES)}, max(running) AS retained
        FROM daily GROUP BY ALL),
    pct AS (
        SELECT month, {", ".join(fc.DIMS)}, s.customers,
               {", ".join(f"retained_{m} * 100 / s.customers AS retention_{m}" for m in fc.MILESTONES)}, retained * 100 / s.customers AS retention
        FROM curve JOIN sizes s USING (month, {", ".join(fc.DIMS)}))"""


_ONE, _FOUR, _NEXT = (_cohort_sql(m) for m in ([MONTHS[-1]], MONTHS, [NEXT]))


def _people(t, months):
    return fc.cohort_customers(_orders(t), _profile(t), months)


@query("a108_cohort_size", f"WITH {_ONE} SELECT * FROM sizes")
def _(t):
    return fc.cohort_size(_people(t, [MONTHS[-1]]))


@query("a109_cohort_curve_daily", f"WITH {_ONE} SELECT * FROM daily")
def _(t):
    return fc.cohort_curve_daily(_people(t, [MONTHS[-1]]))


@query("a110_cohort_size_next", f"WITH {_NEXT} SELECT * FROM sizes")
def _(t):
    return fc.cohort_size(_people(t, [NEXT]))


def _training(t):
    return fc.training_set(_orders(t), _profile(t), MONTHS)


@query("m01_training_set", f"WITH {_FOUR} SELECT * FROM pct")
def _(t):
    return _training(t)


@query("m02_cohort_curve", f"WITH {_ONE} SELECT * FROM curve")
def _(t):
    return fc.cohort_curve(fc.cohort_curve_daily(_people(t, [MONTHS[-1]])))


@query("m03_retention_pct", f"WITH {_ONE} SELECT * FROM pct")
def _(t):
    return fc.training_set(_orders(t), _profile(t), [MONTHS[-1]])


def _fence(d, target="retention"):
    return f"""SELECT p.* FROM pct p JOIN (SELECT {d}, quantile_cont({target}, 0.25) AS q1, quantile_cont({target}, 0.75) AS q3
               FROM pct GROUP BY 1) q USING ({d}) WHERE {target} < q1 - 1.5 * (q3 - q1) OR {target} > q3 + 1.5 * (q3 - q1)"""


def _outliers(target="retention"):
    return " UNION ".join(_fence(d, target) for d in ("source", "chronic", "discounted"))


_OUT = f"{_FOUR}, outliers AS ({_outliers()})"


@query("m04_iqr_outliers", f"""
    WITH {_OUT} SELECT p.* FROM pct p
    WHERE NOT EXISTS (SELECT 1 FROM outliers o WHERE {" AND ".join(f"o.{d} = p.{d}" for d in fc.DIMS)})""")
def _(t):
    return fc.drop_outliers(checkpointed(_training(t)), "retention")


def _hot_sql():
    groups = (("acquired", "am", fc.AGES), ("latest", "lom", fc.AGES), ("hub", "sc", HUBS),
              ("source", "is", fc.SOURCES))
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {fc.feature_name(p, v)}"
                     for c, p, values in groups for v in values)


@query("m05_one_hot", f"WITH {_FOUR} SELECT *, {_hot_sql()} FROM pct")
def _(t):
    return fc.one_hot(_training(t), HUBS)


@query("m06_min_cohort", f"WITH {_FOUR} SELECT * FROM pct WHERE customers >= 3")
def _(t):
    return fc.min_cohort(_training(t), least=3)


def _hot(t):
    return checkpointed(fc.one_hot(_training(t), HUBS))


_FEATURES = fc.feature_columns(HUBS)


_KEY = ", ".join(f"{c}::VARCHAR" for c in ("month", *fc.DIMS))
_HELD = f"('0x' || substr(md5(concat_ws('|', {_KEY})), 1, 4))::BIGINT % 100 >= 70"


def _held_sql(target):
    """The cohorts that the target's forest is judged on."""
    return f"""SELECT p.* FROM pct p WHERE customers >= {LEAST} AND {_HELD} AND NOT EXISTS (
        SELECT 1 FROM ({_outliers(target)}) o WHERE {" AND ".join(f"o.{d} = p.{d}" for d in fc.DIMS)})"""


def _clean(t, target="retention"):
    return checkpointed(fc.drop_outliers(_hot(t), target))


@query("m07_fit_retention_model", f"""
    WITH {_FOUR} SELECT month, {", ".join(fc.DIMS)}, customers, retention, true AS in_training_range
    FROM ({_held_sql("retention")})""")
def _(t):
    """The forest's own figures differ between engines; that they lie among those it was fitted on does not."""
    clean = _clean(t)
    _, predicted = fc.fit_retention_model(clean, "retention", _FEATURES, LEAST)
    low, high = fc.min_cohort(clean, LEAST).filter(fc.split_rule()).agg(F.min("retention"), F.max("retention")).first()
    inside = F.col("retention_predicted").between(low - 1e-9, high + 1e-9)
    return predicted.select("month", *fc.DIMS, "customers", "retention", inside.alias("in_training_range"))


@query("m07_predictions")
def _(t):
    """What the forest predicts for the cohorts it is judged on."""
    _, predicted = fc.fit_retention_model(_clean(t), "retention", _FEATURES, LEAST)
    return predicted.select("month", *fc.DIMS, "customers", "retention", "retention_predicted")


_GATE = "target string, n long, k int, r2 double, adjusted_r2 double, accepted boolean"


def _gates(t, gates):
    return t.spark.createDataFrame([tuple(g[x] for x in ("target", "n", "k", "r2", "adjusted_r2", "accepted")) for g in gates],
                                   _GATE)


@query("m08_gate")
def _(t):
    _, predicted = fc.fit_retention_model(_clean(t), "retention", _FEATURES, LEAST)
    return _gates(t, [fc.quality_gate(predicted, "retention", len(_FEATURES))])


@query("m09_gates")
def _(t):
    """The figures of every target, accepted or not."""
    return _gates(t, fc.fit_all(_hot(t), _FEATURES, sinks.fresh_path(t.spark, "models"), least=LEAST)[1])


def _gate_rows(t, gates):
    """Each gate's size, and whether its figures follow from its R squared."""
    rows = []
    for g in gates:
        spare = g["n"] - g["k"] - 1  # without rows to spare there is no adjusted value
        follows = (abs(1 - (1 - g["r2"]) * (g["n"] - 1) / spare - g["adjusted_r2"]) < 1e-9 if spare > 0
                   else math.isnan(g["adjusted_r2"]))
        rows.append((g["target"], g["n"], g["k"], follows,
                     g["accepted"] == (g["adjusted_r2"] >= 0.85)))
    return t.spark.createDataFrame(
        rows, "target string, n long, k int, adjusted_follows boolean, accepted_follows boolean")


def _gate_sql(target):
    return f"""SELECT '{target}' AS target, count(*) AS n, {len(_FEATURES)} AS k, true AS adjusted_follows,
        true AS accepted_follows FROM ({_held_sql(target)})"""


@query("m08_quality_gate", f"WITH {_FOUR} {_gate_sql('retention')}")
def _(t):
    _, predicted = fc.fit_retention_model(_clean(t), "retention", _FEATURES, LEAST)
    return _gate_rows(t, [fc.quality_gate(predicted, "retention", len(_FEATURES))])


@query("m09_all_targets", f"WITH {_FOUR} {' UNION ALL '.join(map(_gate_sql, fc.TARGETS))}")
def _(t):
    _, gates = fc.fit_all(_hot(t), _FEATURES, sinks.fresh_path(t.spark, "models"), least=LEAST)
    return _gate_rows(t, gates)


def _predicted(t):
    paths, _ = fc.fit_all(_hot(t), _FEATURES, sinks.fresh_path(t.spark, "models"), least=LEAST)
    coming = fc.one_hot(fc.cohort_size(_people(t, [NEXT])), HUBS)
    return fc.predict_next_month(coming, paths, NEXT, LEAST)


def _percent(df, *more):
    """A forecast of every target for every cohort: each a share in percent."""
    flags = [F.col(f"{x}_predicted").between(0, 100).alias(f"{x}_is_percent") for x in fc.TARGETS]
    return df.select("month", *fc.DIMS, "customers", "prediction_month", *flags, *more)


_COMING = f"""SELECT month, {", ".join(fc.DIMS)}, customers, '{NEXT}' AS prediction_month,
    {", ".join(f"true AS {x}_is_percent" for x in fc.TARGETS)}"""


@query("m10_predict_next_month", f"WITH {_NEXT} {_COMING} FROM sizes WHERE customers >= {LEAST}")
def _(t):
    return _percent(_predicted(t))


_FORECAST = [f"{x}_predicted" for x in fc.TARGETS]


@query("m10_forecast")
def _(t):
    """The forecast itself: a percentage per target for each cohort of the coming month."""
    return _predicted(t).select("month", *fc.DIMS, "customers", "prediction_month", *_FORECAST)


@query("m11_unhot", f"""
    WITH {_FOUR} SELECT month, acquired, latest, hub, source, chronic, discounted, courier, acquired AS acquired_label,
           latest AS latest_label, hub AS hub_label, source AS source_label FROM pct""")
def _(t):
    rows = fc.unhot(fc.one_hot(_training(t), HUBS), HUBS)
    return rows.select("month", "acquired", "latest", "hub", "source", "chronic", "discounted",
                       "courier", "acquired_label", "latest_label", "hub_label", "source_label")


def _appended(t):
    path = sinks.fresh_path(t.spark, "predictions")
    rows = _predicted(t).select("month", *fc.DIMS, "customers", "prediction_month", *_FORECAST)
    sinks.append(rows.withColumn("created_at", F.lit("2001-07-01 06:00:00").cast("timestamp_ntz")), path)
    return t.spark.read.parquet(path)


@query("m12_append_predictions", f"""
    WITH {_NEXT} {_COMING}, TIMESTAMP '2001-07-01 06:00:00' AS created_at FROM sizes WHERE customers >= {LEAST}""")
def _(t):
    return _percent(_appended(t), "created_at")


@query("m12_forecast_table")
def _(t):
    """The appended table as a reader finds it."""
    return _appended(t)
