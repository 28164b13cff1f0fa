"""Hour-of-day success probabilities of attempts and the ranking made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import exact_percentiles
from tidemark.session import checkpointed

FLOOR, SURE = 0.2, 0.5
TOPS = {60: .4, 50: .5, 40: .6, 30: .7, 20: .8, 10: .9}


def prep_attempts(attempts: DataFrame, least: int = 2) -> DataFrame:
    """Attempts from the second on, with their hour."""
    return attempts.filter(F.col("attempt_number") >= least).withColumn("hr", F.hour("assigned_at"))


def cap_attempts(df: DataFrame, limit: int = 7, to: int = 6) -> DataFrame:
    n = F.col("attempt_number")
    return df.withColumn("attempt_original", n).withColumn(
        "attempt_number", F.when(n >= limit, to).otherwise(n))


def _clamped(p):
    """Rates of zero and one say little: they become a low and a middling probability."""
    return F.when(p == 0, FLOOR).when(p == 1, SURE).otherwise(p)


def prob_tables(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Success rate by feature value and hour, all features in one grouping."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"))
                        for f in features])
    long = df.select("hr", "success", F.inline(entries))
    return long.groupBy("feature", "value", "hr").agg(
        _clamped(F.sum("success") / F.count(F.lit(1))).alias("p"))


def prob_table(df: DataFrame, feature: str) -> DataFrame:
    return prob_tables(df, [feature]).drop("feature")


def prob_values(df: DataFrame, tables: DataFrame, features: Sequence[str]) -> DataFrame:
    """Looks up each feature's probability at the row's hour; unseen pairs get the floor.

    Nothing is gathered by hour: each feature is a join on its value and the hour. The tables are read once for all
    of them (checkpointed: they are an aggregate, a row for each value and hour), and the engine broadcasts a
    feature's table where its measured size allows it, so features of few values cost no shuffle, and a feature of
    many values is an ordinary join whose large keys are split.
    """
    known = checkpointed(tables.filter(F.col("value").isNotNull()))
    out = df
    for f in features:
        table = known.filter(F.col("feature") == f).select(
            F.col("value").alias("_v_" + f), F.col("hr").alias("_h_" + f), F.col("p").alias("_p_" + f))
        met = (F.col(f).cast("string") == F.col("_v_" + f)) & (F.col("hr") == F.col("_h_" + f))
        out = out.join(table, met, "left")
    return out.withColumns({"prob_" + f: F.coalesce("_p_" + f, F.lit(FLOOR)) for f in features}).drop(
        *[x + f for f in features for x in ("_v_", "_h_", "_p_")])


def total_score(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("score", reduce(lambda a, b: a * b, [F.col("prob_" + f) for f in features]))


def group_quantiles(df: DataFrame, dims: Sequence[str], tops: Mapping[int, float] = TOPS) -> DataFrame:
    """Score thresholds per group, exact, one column per top share."""
    return exact_percentiles(df, dims, "score", {f"threshold_top{k}": q for k, q in tops.items()})


def topk_flags(df: DataFrame, dims: Sequence[str], tops: Mapping[int, float] = TOPS) -> DataFrame:
    """Marks rows at or over each threshold of their group."""
    df = checkpointed(df)  # the thresholds and the marks both read the scores
    marked = df.join(group_quantiles(df, dims, tops), list(dims))
    return marked.withColumns({f"pred_top{k}": F.when(F.col("score") >= F.col(f"threshold_top{k}"), 1)
                               .otherwise(0) for k in tops})


def tp_flags(df: DataFrame, tops: Mapping[int, float] = TOPS) -> DataFrame:
    """Predicted and successful."""
    return df.withColumns({f"tp_top{k}": F.col(f"pred_top{k}") * F.col("success") for k in tops})


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(F.col(column).isNull()).alias("nulls"))


def feature_corr(df: DataFrame, features: Sequence[str], digits: int = 6) -> DataFrame:
    """Correlations of all pairs of probabilities, from one pass over the rows."""
    pairs = [(a, b) for a in features for b in features if a <= b]
    wide = df.agg(*[F.round(F.corr("prob_" + a, "prob_" + b), digits).alias(f"{a}~{b}")
                    for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                 F.col(f"`{a}~{b}`").alias("corr")) for a, b in pairs])
    return wide.select(F.inline(entries))


def success_by_hour(df: DataFrame, feature: str, values: Sequence[str], how: str = "avg") -> DataFrame:
    """Success per hour with one column per value; missing cells are zero."""
    rate = F.sum("success") / F.count(F.lit(1)) if how == "avg" else F.sum("success")
    return df.groupBy("hr").pivot(feature, list(values)).agg(rate).fillna(0)


def success_by_attempt(df: DataFrame) -> DataFrame:
    return df.groupBy("attempt_number").agg((F.sum("success") / F.count(F.lit(1))).alias("rate"))


def score_snapshot(snapshot: DataFrame, tables: DataFrame, features: Sequence[str], hour: int,
                   tops: Mapping[int, float] = TOPS) -> DataFrame:
    """Scores the next attempt of open entities at a fixed hour."""
    rows = (snapshot.filter((F.col("total_attempts") >= 1) & (F.col("successful_attempts") == 0)
                            & (F.col("issue_flag") == 0))
            .withColumns({"hr": F.lit(hour), "attempt_number": F.col("total_attempts") + 1}))
    scored = total_score(prob_values(cap_attempts(rows), tables, features), features)
    return topk_flags(scored, ["hr"], tops)
