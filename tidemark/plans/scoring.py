"""Success probabilities by hour and the back-test of the top shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.operators.timeline import snapshot_attempts
from tidemark.plans.registry import query

FEATURES = ["segment", "city", "hub", "parity", "kband", "owner", "third", "weekday", "daypart",
            "attempt_number"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_PREP = "prep AS MATERIALIZED (SELECT * FROM attempt WHERE attempt_number >= 2)"
_CLAMP = "CASE WHEN r = 0 THEN 0.2::DOUBLE WHEN r = 1 THEN 0.5::DOUBLE ELSE r END"


def _table(f):
    return (f"SELECT '{f}' AS feature, {f}::VARCHAR AS value, hr, sum(success)::DOUBLE / count(*) AS r "
            f"FROM prep GROUP BY 2, 3")


_TABLES = f"""
    {_PREP},
    rates AS ({" UNION ALL ".join(_table(f) for f in FEATURES)}),
    tables AS MATERIALIZED (SELECT feature, value, hr, {_CLAMP} AS p FROM rates)"""


def _prep(t):
    return sc.prep_attempts(t.attempt)


@query("m13_prep_attempts", f"WITH {_PREP} SELECT * FROM prep")
def _(t):
    return _prep(t)


@query("m14_prob_table", f"WITH {_TABLES} SELECT value, hr, p FROM tables WHERE feature = 'segment'")
def _(t):
    return sc.prob_table(_prep(t), "segment")


@query("m15_prob_tables", f"WITH {_TABLES} SELECT * FROM tables")
def _(t):
    return sc.prob_tables(_prep(t), FEATURES)


_CAPPED = """capped AS MATERIALIZED (SELECT * REPLACE (CASE WHEN attempt_number >= 7 THEN 6 ELSE attempt_number END AS attempt_number),
                        attempt_number AS attempt_original, assigned_at::DATE AS assigned_on FROM prep)"""


def _capped(t):
    return sc.cap_attempts(_prep(t)).withColumn("assigned_on", F.to_date("assigned_at"))


@query("m16_cap_attempts", f"WITH {_PREP}, {_CAPPED} SELECT * FROM capped")
def _(t):
    return _capped(t)


_JOINS = "LEFT JOIN maps ON maps.hr = c.hr"
_MAPS = ", ".join(f"map_from_entries(list({{'k': value, 'v': p}}) FILTER (feature = '{f}')) AS m_{f}" for f in FEATURES)
_PROBS = ", ".join(f"coalesce(maps.m_{f}[c.{f}::VARCHAR], 0.2::DOUBLE) AS prob_{f}" for f in FEATURES)
_PRODUCT = " * ".join(f"prob_{f}" for f in FEATURES)
_SCORED = f"""{_TABLES}, {_CAPPED},
    maps AS MATERIALIZED (SELECT hr, {_MAPS} FROM tables WHERE value IS NOT NULL GROUP BY hr),
    looked AS MATERIALIZED (SELECT c.*, {_PROBS} FROM capped c {_JOINS}),
    scored AS (SELECT *, {_PRODUCT} AS score FROM looked)"""


def _looked(t):
    return sc.prob_values(_capped(t), sc.prob_tables(_prep(t), FEATURES), FEATURES)


def _scored(t):
    return sc.total_score(_looked(t), FEATURES)


@query("m17_prob_values", f"WITH {_SCORED} SELECT * FROM looked")
def _(t):
    return _looked(t)


@query("m18_total_score", f"WITH {_SCORED} SELECT id, score FROM scored")
def _(t):
    return _scored(t).select("id", "score")


_Q = ", ".join(f"quantile_cont(score, {q}) AS threshold_top{k}" for k, q in sc.TOPS.items())
_MARKED = f"""{_SCORED},
    cuts AS (SELECT assigned_on, hr, {_Q} FROM scored GROUP BY 1, 2),
    marked AS (SELECT s.id, s.assigned_on, s.hr, s.success, s.score,
                      {", ".join(f"threshold_top{k}, CASE WHEN score >= threshold_top{k} THEN 1 ELSE 0 END AS pred_top{k}" for k in sc.TOPS)}
               FROM scored s JOIN cuts c ON s.assigned_on = c.assigned_on AND s.hr = c.hr),
    hits AS (SELECT *, {", ".join(f"pred_top{k} * success AS tp_top{k}" for k in sc.TOPS)} FROM marked)"""
_DIMS = ["assigned_on", "hr"]
# interpolated thresholds are tiny numbers, given to fifteen places
_ROUNDED = ", ".join(f"round(threshold_top{k}, 15) AS threshold_top{k}" for k in sc.TOPS)


def _rounded(df):
    return df.withColumns({f"threshold_top{k}": F.round(f"threshold_top{k}", 15) for k in sc.TOPS})


def _slim(t):
    return _scored(t).select("id", "assigned_on", "hr", "success", "score")


@query("m19_group_quantiles", f"WITH {_MARKED} SELECT * REPLACE ({_ROUNDED}) FROM cuts")
def _(t):
    return _rounded(sc.group_quantiles(_slim(t), _DIMS))


@query("m20_topk_flags", f"WITH {_MARKED} SELECT * REPLACE ({_ROUNDED}) FROM marked")
def _(t):
    return _rounded(sc.topk_flags(_slim(t), _DIMS))


@query("m21_tp_flags", f"WITH {_MARKED} SELECT * REPLACE ({_ROUNDED}) FROM hits")
def _(t):
    return _rounded(sc.tp_flags(sc.topk_flags(_slim(t), _DIMS)))


@query("m22_null_check", f"""WITH {_MARKED}
    SELECT count(*) AS rows_seen, count(*) FILTER (tp_top60 IS NULL) AS nulls FROM hits""")
def _(t):
    return sc.null_count(sc.tp_flags(sc.topk_flags(_slim(t), _DIMS)), "tp_top60")


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(prob_{a}, prob_{b}), 6) AS corr FROM looked"
    for a in FEATURES for b in FEATURES if a <= b)


@query("m23_feature_corr", f"WITH {_SCORED} {_PAIRS}")
def _(t):
    return sc.feature_corr(_looked(t), FEATURES)


def _wide(feature, values, how):
    cell = {"avg": "sum(success)::DOUBLE / count(*)", "sum": "sum(success)::BIGINT"}[how]
    zero = "0::DOUBLE" if how == "avg" else "0"
    cols = ", ".join(f"coalesce({cell.replace('sum(success)', f'sum(success) FILTER ({feature} = {v!r})').replace('count(*)', f'nullif(count(*) FILTER ({feature} = {v!r}), 0)')}, {zero}) AS \"{v}\""
                     for v in values)
    return f"WITH {_PREP} SELECT hr, {cols} FROM prep GROUP BY 1"


@query("m24_success_by_hour", _wide("segment", SEGMENTS, "avg"))
def _(t):
    return sc.success_by_hour(_prep(t), "segment", SEGMENTS)


@query("m25_success_by_attempt", f"""
    WITH {_PREP} SELECT attempt_number, sum(success)::DOUBLE / count(*) AS rate FROM prep GROUP BY 1""")
def _(t):
    return sc.success_by_attempt(_prep(t))


@query("m26_success_sum", _wide("kband", ["0", "1", "2", "3"], "sum"))
def _(t):
    return sc.success_by_hour(_prep(t), "kband", ["0", "1", "2", "3"], how="sum")


SNAP = ["segment", "city", "hub", "parity", "third", "attempt_number"]
_SNAP_JOINS = " ".join(f"LEFT JOIN tables t_{f} ON t_{f}.feature = '{f}' AND t_{f}.value = c.{f}::VARCHAR AND t_{f}.hr = 11"
                       for f in SNAP)


@query("m27_score_snapshot", f"""
    WITH {_TABLES},
    stay AS (SELECT entity_id, code, made_at, lead(made_at) OVER (PARTITION BY entity_id ORDER BY id) AS next_at FROM status_log),
    snap AS (SELECT entity_id, min(made_at) AS in_at, max(next_at) AS out_at FROM stay
             WHERE code = 3 AND TIMESTAMP '2024-01-15 11:00:00' BETWEEN made_at AND next_at GROUP BY 1),
    tried AS (
        SELECT s.entity_id, s.in_at, s.out_at, count(l.id) AS total_attempts,
               count(CASE WHEN l.code = 3 THEN 1 END) AS unsuccessful_attempts,
               count(CASE WHEN l.code = 4 AND l.made_at >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 END) AS successful_attempts
        FROM snap s LEFT JOIN status_log l ON l.entity_id = s.entity_id AND l.made_at < TIMESTAMP '2024-01-15 11:00:00' GROUP BY 1, 2, 3),
    base AS (
        SELECT t.*, CASE WHEN g.segment = 'BUILDING' THEN 1 ELSE 0 END AS issue_flag, g.segment, g.city, g.hub,
               (t.entity_id % 2)::VARCHAR AS parity, (t.entity_id % 3)::VARCHAR AS third
        FROM tried t JOIN geo g ON g.customer_id = t.entity_id),
    c AS (SELECT *, 11 AS hr, total_attempts + 1 AS attempt_original,
                 CASE WHEN total_attempts + 1 >= 7 THEN 6 ELSE total_attempts + 1 END AS attempt_number
          FROM base WHERE total_attempts >= 1 AND successful_attempts = 0 AND issue_flag = 0),
    looked AS (SELECT c.*, {", ".join(f"coalesce(t_{f}.p, 0.2::DOUBLE) AS prob_{f}" for f in SNAP)} FROM c {_SNAP_JOINS}),
    scored AS (SELECT *, {" * ".join(f"prob_{f}" for f in SNAP)} AS score FROM looked),
    cuts AS (SELECT {_Q} FROM scored)
    SELECT s.*, {_ROUNDED}, {", ".join(f"CASE WHEN score >= threshold_top{k} THEN 1 ELSE 0 END AS pred_top{k}" for k in sc.TOPS)}
    FROM scored s, cuts""")
def _(t):
    log = t.status_log
    tasks = log.select(
        F.col("id").alias("task_id"), F.col("entity_id").alias("case_id"),
        F.col("made_at").alias("assigned_at"),
        F.when(F.col("code") == 3, "Hold").when(
            (F.col("code") == 4) & (F.col("made_at") >= F.lit("2024-01-15").cast("timestamp_ntz")),
            "Done").otherwise("Other").alias("action"))
    flags = log.select(F.col("id").alias("task_id"), F.lit(1).alias("call_started"))
    snap = snapshot_attempts(log, tasks, flags, 3, "2024-01-15 11:00:00", {"Hold": 0, "Done": 1})
    place = t.geo.select(F.col("customer_id").alias("entity_id"), "segment", "city", "hub")
    base = snap.join(place, "entity_id").withColumns({
        "issue_flag": F.when(F.col("segment") == "BUILDING", 1).otherwise(0),
        "parity": (F.col("entity_id") % 2).cast("string"),
        "third": (F.col("entity_id") % 3).cast("string")})
    return _rounded(sc.score_snapshot(base, sc.prob_tables(_prep(t), FEATURES), SNAP, 11))
